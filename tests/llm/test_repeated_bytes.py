"""Repeated byte strings against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import repeated_bytes
from marlstone.llm.queries import queries

N = 200


def plain(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + N] for _, t in texts for i in range(len(t) - N + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - N + 1):
            if count[t[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def same(df, rows):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert df.columns == names and [k for _, k in df.dtypes] == ["bigint"] * 4 + ["string"]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = [r[:5] for r in plain(rows)]
    assert got == want
    return sum(r[2] for r in want)


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_is_the_plain_version(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('/root/testdata/sf{sf}/documents.parquet')").fetchall()
    assert same(queries()["op13_repeated_bytes"](spark, f"/root/testdata/sf{sf}"), rows) > 0


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeü ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randrange(20, 160)) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [text(rng.randrange(1, 60)) for _ in range(rng.randrange(4))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a, b = sorted(rng.randrange(len(s)) for _ in range(2))
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([s, s[a:b], s[a:], s[:b], s[:a] + "#" + s[a:]]))
        rows.append((d, "".join(parts)))
    return rows


@pytest.mark.parametrize("block", [1 << 18, 331])
def test_planted_passages_of_any_cut(spark, scratch, block):
    rows = planted(block)
    rows += [(500, "x" * 700), (501, "ab" * 150), (502, "ab" * 90), (503, rows[0][1] * 3), (504, "y" * 199), (505, "z" * 200), (506, "z" * 200), (507, "ü" * 101), (508, "q" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert same(repeated_bytes.digest(df, scratch, block), rows) > 10_000
    kept = sorted(((r["doc_id"], bytes(r["kept"])) for r in repeated_bytes.remove(df, scratch, block).collect()), key=repr)
    assert kept == sorted(((r[0], r[5]) for r in plain(rows)), key=repr)


def test_odd_rows(spark, scratch):
    text = "The same line of text that stands here, and here, and in other rows too. " * 5
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (None, "short"), (None, None), (4, text[:250]), (4, "other " + text[100:]), (5, "no repeat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("spans", F.lit(0)).withColumn("gram", F.lit(1))
    same(repeated_bytes.digest(df, scratch), rows)
    assert repeated_bytes.digest(df.limit(0), scratch).count() == 0


def test_anchors_are_those_of_the_window():
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    g = repeated_bytes.grams(data)
    of = repeated_bytes.anchors(g)
    assert len(of) == 3000 - N + 1
    order = (g >> np.uint64(20)).tolist()
    assert all(of[p] == min(range(p, p + 176), key=lambda i: (order[i], i)) for p in range(len(of)))
