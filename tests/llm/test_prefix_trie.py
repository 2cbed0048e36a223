"""The trie's node table against dictionaries of prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import prefix_trie
from marlstone.llm.queries import queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    convs = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    if rebuild:
        old, convs = convs, {}
        for c, own in old.items():
            h = zlib.crc32(str(c).encode()) % 9
            convs[c] = old.get(c - c % 5, [])[:h] + own[h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path] if len(nodes) < 700 else None
        ends = [c for c in sorted(members) if len(convs[c]) == len(path)]
        out.append([path, min(members), len(members), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(), below])
    children, saved, leaves = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        saved[path] = saved.get(path, 0) + (len(nodes[path]) - 1) * len(path[-1][1].encode() if path else b"")
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            up = path[:-1]
            children[up] = children.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[path]
            leaves[up] = leaves.get(up, 0) + leaves[path]
    return sorted((c, len(p), min(nodes[p[:-1]]) if p else -1, n, children.get(p, 0), leaves[p], saved[p], sha) for p, c, n, sha, _ in out)


def same(df, rows, rebuild=True):
    assert df.columns == NAMES and all(kind == "bigint" for c, kind in df.dtypes[:-1])
    got = sorted(tuple(-1 if r[c] is None else r[c] for c in NAMES) for r in df.collect())
    assert got == plain(rows, rebuild)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_is_the_plain_version(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM read_parquet('/root/testdata/sf{sf}/conversations.parquet')").fetchall()
    same(queries()["op11_prefix_trie"](spark, f"/root/testdata/sf{sf}"), rows)


def odd(seed):
    rng = random.Random(seed)
    rows = [(c if c < 48 else None, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "ü" * 50_000])) for c in range(-20, 50) if c % 7 for _ in range(rng.randrange(1, 14))]
    return rows + [(60, 1, "user", "a")] * 5 + [(61, 1, "user", "a")] * 5


def test_odd_rows(spark, scratch):
    rows = odd(2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("p1", F.lit(1))
    same(prefix_trie.of_rebuilt(df, scratch), rows)
    same(prefix_trie.of_messages(df, scratch), rows, rebuild=False)
    assert prefix_trie.of_rebuilt(df.limit(0), scratch).count() == 0


def test_long_conversation_and_many_copies(spark, scratch, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BUCKET", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(1, t, "user", f"t{t % 40}") for t in range(100)] + [(c, t, "user", f"t{t}") for c in range(2, 80) for t in range(3)] + [(90, t, "user", f"t{t}" if t < 60 else "x") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(prefix_trie.of_messages(df, scratch), rows, rebuild=False)
