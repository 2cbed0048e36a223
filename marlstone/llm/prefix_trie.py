"""Prefix trie of conversations from partial tries that are merged by node.

A node is a sequence of turns; its id is its depth and two 64-bit sums (exclusive or) over the hashes of its turns with
their depths, so that ids are running values along a conversation and a long one is no single task's work. Every
group of conversations (by a hash of the id) gives a partial trie: its nodes with member count and smallest member,
combined where the rows are read. Partial tries merge in rounds, some at a time, by node, until one is left; so no
node, the root with all members included, meets more than a few rows. Conversations that end at a node are sorted
into blocks of ids, which are the pieces of its end list; the list is hashed block by block.

The rollup runs bottom-up along conversations. The smallest members of the nodes on a path only rise with depth, so
from some depth on a conversation is the smallest of its nodes. What it carries from its end to each node above is the
bytes of those turns where it is not, which others have already, and one leaf if it is the smallest of a leaf. These
parts add up, and so they merge as members do.

One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
saved_tokens, ends_sha256. Nulls: a null role or text is empty; turns without number come first, ties go by role and
text; rows without conversation id belong to no conversation. Repeated rows are turns of their own. Texts of any
length are hashed where they are read and not moved again. An empty table gives no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import in_order, running
from .shared import Scratch

#: Groups of conversations with a partial trie each, and how many of them a merge makes one.
PARTIALS, FAN = 64, 8
#: Turns of a conversation in a bucket of its running values.
BUCKET = 1024
#: Ids in a block of an end list.
BLOCK = 4096
#: Most turns that a rebuilt conversation takes over, plus one, and conversations of a family.
TAKEN, FAMILY = 9, 5

NODE = ["depth", "p1", "p2"]


def steps(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, rank (from 1), t1 and t2 (hashes of role and text), bytes (of the text)."""
    filled = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    placed = in_order(filled, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], keep=["conv_id", *hashes, F.octet_length("text").cast("long").alias("bytes")])
    placed = scratch.save(placed, "placed")
    ranked = running(placed, ["conv_id"], "bucket", ["place"], {"rank": ("count", F.lit(1))})
    return ranked.select("conv_id", F.col("rank").cast("long").alias("rank"), "t1", "t2", "bytes")


def rebuilt(ranked: DataFrame, family: int = FAMILY, taken: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """Steps (with depth) and ids of rebuilt conversations: each takes over the first h turns of its family's first one,
    h = crc32(id) % ``taken``, before its own turns after its first h."""
    behind = F.pmod(F.col("conv_id"), F.lit(family))
    n = ranked.groupBy("conv_id").agg(F.max("rank").alias("n"))
    c = n.select("conv_id", (F.col("conv_id") - behind).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % taken).alias("h"))
    info = c.join(n.select(F.col("conv_id").alias("base"), "n"), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("m"))
    own = ranked.join(info, "conv_id").where("rank > h").select("conv_id", (F.col("m") + F.col("rank") - F.col("h")).alias("depth"), "t1", "t2", "bytes")
    near = F.sequence(F.col("conv_id"), F.col("conv_id") + (family - 1))
    shared = ranked.where((behind == 0) & (F.col("rank") < taken)).select(F.col("conv_id").alias("base"), F.explode(near).alias("conv_id"), F.col("rank").alias("depth"), "t1", "t2", "bytes")
    shared = shared.join(info, ["conv_id", "base"]).where("depth <= h").select("conv_id", "depth", "t1", "t2", "bytes")
    return own.unionByName(shared), n.select("conv_id")


def merged(parts: DataFrame, node: list[str], values: dict[str, Column], partials: int = PARTIALS, fan: int = FAN) -> DataFrame:
    """Rows with conv_id as partial tables of nodes, merged round by round until a node is one row; ``values`` must be
    aggregates that combine with themselves, named as their column."""
    rows, part = parts.withColumn("_part", F.pmod(F.xxhash64("conv_id"), F.lit(partials))), partials
    while True:
        rows = rows.groupBy(*node, "_part").agg(*(v.alias(n) for n, v in values.items()))
        if part == 1:
            return rows.drop("_part")
        part = -(-part // fan)
        rows = rows.withColumn("_part", F.floor(F.col("_part") / fan))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation as blocks of ids, written with commas."""
    names = ["depth", "p1", "p2", "first", "ids"]
    for b in batches:
        columns = [b.column(c).to_pylist() for c in (*NODE, "conv_id")]
        out, key, ids = [], None, []
        for *node, conv in zip(*columns):
            if node != key or len(ids) == BLOCK:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = node, []
            ids.append(conv)
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks, which come in order."""
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    key, digest = None, None
    for b in batches:
        out = []
        for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
            if node != key:
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, digest.hexdigest()), schema)], schema=schema)


def trie(turns: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """The node table of conversations ``members`` (conv_id) whose turns are conv_id, depth (from 1), t1, t2, bytes."""
    own = [F.xxhash64(F.lit(k), "depth", "t1", "t2").alias(f"s{k}") for k in (1, 2)]
    turns = scratch.save(turns.select("conv_id", "depth", "bytes", *own, F.floor((F.col("depth") - 1) / BUCKET).alias("bucket")), "turns")
    paths = running(turns, ["conv_id"], "bucket", ["depth"], {"p1": ("xor", F.col("s1")), "p2": ("xor", F.col("s2")), "to_here": ("sum", F.col("bytes"))})
    zero = F.lit(0).cast("long")
    roots = members.select("conv_id", *(zero.alias(c) for c in (*NODE, "bytes", "to_here")), *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")))
    paths = paths.select("conv_id", *NODE, "bytes", "to_here", *(F.col(f"p{k}").bitwiseXOR(F.col(f"s{k}")).alias(f"q{k}") for k in (1, 2)))
    paths = scratch.save(paths.unionByName(roots), "paths")

    parts = paths.select("conv_id", *NODE, "bytes", "q1", "q2", F.lit(1).cast("long").alias("n_convs"), F.col("conv_id").alias("least"))
    nodes = scratch.save(merged(parts, NODE, {"n_convs": F.sum("n_convs"), "least": F.min("least"), "bytes": F.min("bytes"), "q1": F.min("q1"), "q2": F.min("q2")}), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = scratch.save(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "children")

    # what each conversation carries up: from depth ``top`` on it is the smallest member of its nodes
    smallest = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.min("depth").alias("top"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    carrier = paths.join(smallest, "conv_id", "left").select("conv_id", *NODE, "bytes", "to_here", (F.col("depth") < F.coalesce("top", F.lit(2**62))).alias("has"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    total = paths.join(smallest, "conv_id", "left").where("depth < coalesce(top, depth + 1)").groupBy("conv_id").agg(F.sum("bytes").alias("total"))
    carried = carrier.where("has or leaf = 1").join(total, "conv_id", "left").select(
        "conv_id", *NODE, F.when(F.col("has"), F.col("total") - F.col("to_here") + F.col("bytes")).otherwise(0).alias("saved_tokens"), F.col("leaf").cast("long").alias("n_leaves"))
    rolled = merged(carried, NODE, {"saved_tokens": F.sum("saved_tokens"), "n_leaves": F.sum("n_leaves")})

    last = paths.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("e")).select("conv_id", "e.*")
    blocks = last.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_blocks, "depth long, p1 long, p2 long, first long, ids string")
    ends = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hash_blocks, "depth long, p1 long, p2 long, ends_sha256 string")

    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("above"))
    root = nodes.where("depth = 0").select(F.col("least").alias("_root"))  # one row
    out = nodes.join(rolled, NODE, "left").join(ends, NODE, "left").join(above, ["depth", "q1", "q2"], "left").crossJoin(F.broadcast(root))
    return out.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.col("_root")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def of_messages(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """The node table of conversations as they are."""
    ranked = scratch.save(steps(messages, scratch), "ranked")
    return trie(ranked.withColumnRenamed("rank", "depth"), ranked.select("conv_id").distinct(), scratch)


def of_rebuilt(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """The node table of rebuilt conversations."""
    turns, members = rebuilt(scratch.save(steps(messages, scratch), "ranked"))
    return trie(turns, scratch.save(members, "members"), scratch)
