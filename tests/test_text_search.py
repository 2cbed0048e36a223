"""Searches of many questions: what is moved for them, and their passages against a plain version."""

import random
import re

import pyarrow as pa
import pytest

from marlstone.functions.german import STOP_WORDS, stem
from marlstone.operators import text_index
from marlstone.scratch import Tables

WORDS = ["konzert", "abend", "garten", "hamburg", "musik", "stadt", "licht", "wasser", "der", "und"]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice((0, 4, 12, 40))))) for i in range(n)] + [(900, None), (901, "garten " * 30 + "licht")]


def opened(spark, rows):
    tables = Tables(spark, "index")
    text_index.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text", tables)
    return text_index.TextIndex(spark, tables.base)


def density(text, terms):
    at = [(i, t) for i, w in enumerate(re.findall(r"\w+", text or "")) if w not in STOP_WORDS and (t := stem(w)) in terms]
    last, before, out = {}, None, 0.0
    for i, (pos, t) in enumerate(at):
        last[t] = (pos, i)
        if len(last) == len(terms):
            first = min(last.values())
            if before is None or first > before:
                out += 0.1 / (1 + (pos - first[0]) - (i - first[1]))
            before = first
    return round(out, 6) if before else None


@pytest.mark.parametrize("small", [False, True])
def test_many_questions_as_one_by_one(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(text_index, "_SETS", 3)
        monkeypatch.setattr(text_index, "_ROWS", 20)  # in forked workers where they see it; the function itself is tried below
    rows = texts()
    rng = random.Random(5)
    stems = [stem(w) for w in WORDS[:8]]
    asked = {q: tuple(rng.sample(stems, rng.choice((1, 2, 3, 4)))) for q in range(12)} | {12: ("nirgend", stems[0]), 13: (stems[0], stems[1]), 14: (stems[1], stems[0])}
    questions = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    got = {(r["query_id"], r["rank"]): (r["key"], r["density"]) for r in opened(spark, rows).all_of(questions, 4).collect()}
    want = {}
    for q, ts in asked.items():
        best = sorted((-d, i) for i, t in rows if (d := density(t, set(ts))) is not None)[:4]
        want |= {(q, n): (i, -d) for n, (d, i) in enumerate(best, 1)}
    assert got == want and len(got) > 40


def test_passages_in_small_slices(monkeypatch):
    import numpy as np

    class Given:
        value = (np.array([7, 8]), np.array([[0, 1, *[-1] * 10], [1, *[-1] * 11]]), ["abend", "konzert"])

    batch = pa.RecordBatch.from_pylist([{"key": k, "t": (t or "").split()} for k, t in texts()], pa.schema([("key", pa.int64()), ("t", pa.list_(pa.string()))]))
    rows = list(text_index._rows_of_texts(iter([batch])))

    def found():
        return sorted(tuple(r.values()) for b in text_index._passages(Given)(iter(rows)) for r in b.to_pylist())

    whole = found()
    monkeypatch.setattr(text_index, "_ROWS", 7)
    assert found() == whole and {s for s, _, _ in whole} == {7, 8}


def test_no_posting_is_moved(spark, monkeypatch):
    moved = {}
    plain = Tables.save

    def save(self, df, name, *more):
        out = plain(self, df, name, *more)
        moved[name] = re.findall(r"Exchange .*", df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(Tables, "save", save)
    index = opened(spark, texts())
    assert "postings" not in moved and moved["texts"] == [x for x in moved["texts"] if "repartition" in x.lower()]
    index.all_of(spark.createDataFrame([(1, "konzert"), (1, "abend")], "query_id long, term string"), 4)
    assert index.postings.count() and moved["postings"] == []
    assert len(moved["best"]) == 1 and "hashpartitioning(set" in moved["best"][0]  # the first rows of each task, no positions


def test_rows_with_one_key_stay_apart(spark):
    index = opened(spark, [(1, "Konzert Konzert"), (1, "Abend"), (None, "Abend")])
    assert sorted((r["term"], r["df"]) for r in index.terms.collect()) == [("abend", 2), ("konzert", 1)]
    assert tuple(index.corpus.first()) == (3, 4)


def test_hybrids_move_no_positions(spark, data, monkeypatch):
    from marlstone.plans import retrieval

    plans = {}
    plain = Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name, *more: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and plain(self, df, name, *more))
    retrieval.archive_quota_hybrid_whole(spark, data)
    assert "postings" not in plans and "hashpartitioning(set" in plans["best"] and "hashpartitioning(term" not in plans["best"]
