"""Removal of repeated byte strings by refining suffix buckets.

A position is repeated if the ``LENGTH`` bytes from it on also start elsewhere, in any text. Suffixes are put into
buckets by their first ``GRAM`` bytes, and buckets are refined by the bucket identifiers of later offsets; an
identifier of twice the length is made of two of the length before, so those are reused up to ``LENGTH``, and
buckets of one suffix leave at every step.

Only some suffixes are bucketed. Of the grams inside a window of ``LENGTH`` bytes the one of least identifier, the
leftmost of equal ones, is the window's anchor, so equal windows have equal anchors at the same offset. Windows that
follow one another mostly share an anchor; there is one for each 71 bytes or so. Then, all exact:

1. Anchors go by gram and by context (the bytes of all windows that have the anchor). A context that occurs twice is
   repeated as a whole, and of its occurrences one stands for all from here on. A gram with one context is done.
2. Contexts that share a gram with others are refined to both sides: round by round, at 50, 100 and 150 more bytes,
   those leave whose identifier is theirs alone. How far a context got bounds which of its windows can be repeated.
3. Those windows meet by gram and window identifier. As the windows of an anchor overlap, the bytes that they cover
   are those from the first to the last repeated one.
4. Spans go back to their texts, which are read again and hashed without them.

Identifiers are 64 bits; contexts and windows are compared by two of them, the gram's and their own. Texts are
read in blocks, three times, and moved twice; all tables between hold anchors, not bytes, but for the contexts of
step 2. No step gathers a bucket: counts are combined before they move, and counted rows meet theirs in joins that
Spark can split.

Nulls: a null text is empty. Equal ids and repeated rows are texts of their own, so a row that stands twice is
repeated. Texts shorter than ``LENGTH`` are kept as they are. Anchors of texts of any length are found block by
block; contexts are cut from a whole text, with some 50 bytes for each byte of one that is very long, and a text's spans
are held with it. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

LENGTH, GRAM = 200, 25
#: Further bytes to each side at which contexts are refined.
LEVELS = (50, 100, 150)
#: The name of a text.
KEY = ["k1", "k2"]
#: Window starts looked at together; less than 2 ** 20.
BLOCK = 1 << 16

ANCHORS = "k1 long, k2 long, at long, low int, high int, gram long, context long"
CONTEXTS = "k1 long, k2 long, at long, single boolean, gram long, left int, right int, bytes binary, " + ", ".join(f"{side}{n} long" for side in "lr" for n in LEVELS)

_A, _B, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 256, dtype=np.uint64)
_FACTORS = np.random.Generator(np.random.PCG64(8)).integers(0, 2**62, 5, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of what has identifier a and then identifier b."""
    x = a * _A
    x += b
    x ^= x >> _HALF
    x *= _B
    x ^= x >> _HALF
    return x


def grams(data: np.ndarray) -> np.ndarray:
    """Identifier of the GRAM bytes from each position on."""
    x = _BYTES[data]
    for step, factor in zip((1, 2, 4, 8, 9), _FACTORS):  # 2, 4, 8, 16 and 25 bytes
        y = x[:-step] * factor
        y += x[step:]
        x = y
    x ^= x >> _HALF
    x *= _B
    x ^= x >> _HALF
    return x


def windows(g: np.ndarray) -> np.ndarray:
    """Identifier of the LENGTH bytes from each position on."""
    for step in (25, 50, 100):
        g = pair(g[:-step], g[step:])
    return g


def windows_at(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for some positions only."""
    x = g[at[:, None] + np.arange(0, LENGTH, GRAM)]
    while x.shape[1] > 1:
        x = pair(x[:, 0::2], x[:, 1::2])
    return x[:, 0]


def anchors(g: np.ndarray) -> np.ndarray:
    """The anchor of the window from each position on."""
    x = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, 64, 48):  # 176 grams in a window
        x = np.minimum(x[:-step], x[step:])
    return (x & _PLACE).astype(np.int64)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and where each begins (one more than rows)."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _find_anchors(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    for batch in batches:
        data, ends = _strings(batch.column("text"))
        k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
        for a in range(0, max(int(ends[-1]) - LENGTH + 1, 0), block):
            g = grams(data[a : a + block + LENGTH - 1])
            of = anchors(g)
            p = np.arange(a, a + len(of))
            row = np.searchsorted(ends, p, "right") - 1
            ok = np.flatnonzero(p + LENGTH <= ends[row + 1])
            if not len(ok):
                continue
            new = np.flatnonzero(np.r_[True, (np.diff(of[ok]) != 0) | (np.diff(ok) > 1)])
            low, high = ok[new], ok[np.r_[new[1:], len(ok)] - 1]
            at = of[low]
            shape = ((high - low) * 256 + (at - low)).astype(np.uint64)
            context = pair(pair(windows_at(g, low), windows_at(g, high)), shape)
            r = row[low]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[r]), pa.array(k2[r]), pa.array(a + at - ends[r]), pa.array((at - low).astype(np.int32)), pa.array((high - at).astype(np.int32)), pa.array(g[at].view(np.int64)), pa.array(context.view(np.int64))], names
            )


def _find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes and the identifiers at each level of marked anchors, some texts at a time."""
    names = [c.split()[0] for c in CONTEXTS.split(", ")]
    for batch in batches:
        lengths = np.diff(_strings(batch.column("text"))[1])
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // (4 << 20), prepend=0)).tolist()
        for first, last in zip([0, *cuts], [*cuts, batch.num_rows]):
            if first == last:
                continue
            part = batch.slice(first, last - first)
            data, ends = _strings(part.column("text"))
            marks = part.column("marks")
            row = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy())
            m = {f: c.to_numpy(zero_copy_only=False) for f, c in zip(("at", "low", "high", "gram", "single"), marks.flatten().flatten())}
            at = ends[row] + m["at"]
            a, b = at - m["low"], at + m["high"] + LENGTH
            g, levels = grams(data) if len(data) >= GRAM else np.zeros(0, np.uint64), []
            for sign, room in ((-1, m["low"]), (1, m["high"] + LENGTH - GRAM)):
                x = g[at]
                for k in range(1, LEVELS[-1] // GRAM + 1):
                    ok = room >= GRAM * k
                    x = pair(x, g[np.where(ok, at + sign * GRAM * k, 0)])
                    if GRAM * k in LEVELS:
                        levels.append(pa.array(x.view(np.int64), mask=~ok))
            whole = data.tobytes()
            held = [whole[i:j] for i, j in zip(a.tolist(), b.tolist())]
            k1, k2 = (part.column(c).to_numpy()[row] for c in KEY)
            single = pa.array(m["single"].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(m["at"]), single, pa.array(m["gram"]), pa.array(m["low"]), pa.array(m["high"]), pa.array(held, pa.binary()), *levels], names)


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers of the windows whose anchor lies ``first`` to ``last`` bytes behind their start."""
    names = ["rid", "gram", "ahead", "window"]
    for batch in batches:
        rid, gram, left, first, last = (batch.column(c).to_numpy() for c in ("rid", "gram", "left", "first", "last"))
        data, ends = _strings(batch.column("bytes"))
        ids, count = [], last - first + 1
        for i in range(batch.num_rows):
            a = int(ends[i]) + int(left[i] - last[i])
            ids.append(windows(grams(data[a : a + int(count[i]) + LENGTH - 1])))
        if ids:
            ahead = np.concatenate([np.arange(b, a - 1, -1, dtype=np.int32) for a, b in zip(first.tolist(), last.tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid, count)), pa.array(np.repeat(gram, count)), pa.array(ahead), pa.array(np.concatenate(ids).view(np.int64))], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with a name of 128 bits made of id and text, the same in every reading; equal rows share it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", F.length(text)).alias("k1"), F.xxhash64(text).alias("k2"))


def _refined(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, n_l, n_r: below how many more bytes to each side a context can agree with another."""
    reach = {}
    for side in "lr":
        ids = [f"{side}{n}" for n in LEVELS]
        alive, survivors = contexts.select("rid", *ids), None
        for k, id_ in enumerate(ids):
            twice = scratch.save(alive.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.count("*").alias("n")).where("n > 1").select(id_), f"twice-{side}")
            alive = scratch.save(alive.join(twice.hint("shuffle_hash"), id_).select("rid", *ids[k + 1 :]), f"level-{side}")
            got = alive.select("rid", F.lit(k + 1).alias("n"))
            survivors = got if survivors is None else survivors.unionByName(got)
        reach[side] = survivors.groupBy("rid").agg(F.max("n").alias(f"n_{side}"))
    bound = lambda n: F.element_at(F.array(*map(F.lit, (*LEVELS, 1 << 20))), F.coalesce(n, F.lit(0)) + 1)
    both = reach["l"].join(reach["r"], "rid", "full_outer")
    return both.select("rid", bound(F.col("n_l")).alias("n_l"), bound(F.col("n_r")).alias("n_r"))


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # of one text


def repeated_spans(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """k1, k2 (a text's name), spans: where repeated bytes begin and end, one span per anchor, not yet joined."""
    texts = _keyed(docs)
    long = texts.where(F.octet_length("text") >= LENGTH).select("text", *KEY)
    found = scratch.save(long.mapInArrow(lambda batches: _find_anchors(batches, block), ANCHORS), "anchors")

    # grams that occur twice, and whether in different contexts; all other anchors leave
    ends = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    grams_ = scratch.save(ends.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("shared")), "grams")  # written, so that Spark can split the join
    live = scratch.save(found.join(grams_.hint("shuffle_hash"), "gram"), "live")
    scratch.drop(found)
    one = F.struct(*KEY, "at", "low", "high")
    classes = live.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(one).alias("one"), F.first("shared").alias("shared"))
    classes = scratch.save(classes.where("n > 1 or shared"), "classes")
    often = classes.where("n > 1").select("gram", "context").hint("shuffle_hash")
    whole = live.join(often, ["gram", "context"]).select(*KEY, (F.col("at") - F.col("low")).alias("begin"), (F.col("at") + F.col("high") + LENGTH).alias("end"))
    whole = scratch.save(_gathered(whole), "whole")
    scratch.drop(live)

    # contexts that share their gram with others: one occurrence of each, with its bytes
    marked = classes.where("shared").select("one.*", "gram", (F.col("n") == 1).alias("single"))
    marks = marked.groupBy(*KEY).agg(F.collect_list(F.struct("at", "low", "high", "gram", "single")).alias("marks"))  # of one text
    once = texts.select("text", *KEY).join(marks.hint("shuffle_hash"), KEY).mapInArrow(_find_contexts, CONTEXTS)
    contexts = scratch.save(once.withColumn("rid", F.monotonically_increasing_id()), "contexts")
    scratch.drop(classes)

    # the windows that can be repeated, and which are
    reach = _refined(contexts.select("rid", *(f"{side}{n}" for side in "lr" for n in LEVELS)), scratch)
    room, least = LENGTH - GRAM, F.lit(LEVELS[0])
    far = contexts.select("rid", *KEY, "at", "single", "gram", "left", "right", "bytes").join(reach, "rid", "left")
    first = F.greatest(-F.col("right"), F.lit(room + 1) - F.coalesce("n_r", least)).cast("int")
    last = F.least(F.col("left"), F.coalesce("n_l", least) - 1).cast("int")
    open_ = scratch.save(far.withColumns({"first": first, "last": last}).where("first <= last"), "open")
    scratch.drop(contexts)
    starts = open_.select("rid", "gram", "left", "first", "last", "bytes").mapInArrow(_find_windows, "rid long, gram long, ahead int, window long")
    twice = scratch.save(starts.groupBy("gram", "window").agg(F.count("*").alias("n")).where("n > 1").select("gram", "window"), "twice")
    covered = starts.join(twice.hint("shuffle_hash"), ["gram", "window"]).groupBy("rid").agg(F.min("ahead").alias("first"), F.max("ahead").alias("last"))
    own = open_.where("single").select("rid", *KEY, "at").join(covered, "rid")
    parts = own.select(*KEY, (F.col("at") - F.col("last")).alias("begin"), (F.col("at") - F.col("first") + LENGTH).alias("end"))
    both = _gathered(parts).unionByName(whole).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = scratch.save(both, "spans")
    for t in (open_, twice, whole):
        scratch.drop(t)
    return spans


def joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, with those that touch made one."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            data, at, digest, cut = text.as_buffer(), 0, hashlib.sha256(), joined(spans)
            view = memoryview(data)
            for begin, end in [*cut, (len(view), len(view))]:
                digest.update(view[at:begin])
                at = end
            rows.append((len(view), sum(b - a for a, b in cut), len(cut), digest.hexdigest()))
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return _keyed(docs).join(spans.hint("shuffle_hash"), KEY, "left")


def remove(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """doc_id and what is left of each text, as bytes: cuts may fall inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                data, at, kept = text.as_buffer().to_pybytes(), 0, []
                for begin, end in [*joined(spans), (len(data), len(data))]:
                    kept.append(data[at:begin])
                    at = end
                left.append(b"".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(left, pa.binary())], ["doc_id", "kept"])

    met = _with_spans(docs, repeated_spans(docs, scratch, block))
    return met.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary")


def digest(docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    met = _with_spans(docs, repeated_spans(docs, scratch, block))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.select("doc_id", "text", "spans").mapInArrow(_digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
