"""The stored index of stems: what it finds, what it reads, and when it is built anew."""

import re
import time

from marlstone.operators import text_index
from marlstone.scratch import Tables

TEXTS = [
    (1, "Die Konzerte in Hamburg: ein Konzert am Abend."), (2, "Das Konzert. Der Abend war lang, das Konzert auch; Hamburgs Abende."), (3, "Kein Wort davon"),
    (4, None), (5, ""), (6, "hamburg " + "wort " * 30 + "konzerten"), (7, "KONZERTE HAMBURG"),
]


def opened(spark, rows=TEXTS):
    tables = Tables(spark, "index")
    text_index.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", tables)
    return text_index.TextIndex(spark, tables.base)


def asked(spark, *questions):
    return spark.createDataFrame([(i, t) for i, q in enumerate(questions) for t in q], "query_id long, term string")


def test_stems_are_found_and_ranked_by_cover(spark):
    index = opened(spark)
    got = [(r["query_id"], r["rank"], r["key"], r["density"]) for r in index.all_of(asked(spark, ("konzert", "hamburg"), ("konzert", "nirgend"), ("wort",)), 10).collect()]
    assert sorted(x[:3] for x in got if x[0] == 0) == [(0, 1, 1), (0, 2, 7), (0, 3, 2), (0, 4, 6)]
    by_key = {k: d for q, _, k, d in got if q == 0}
    assert by_key[7] == 0.1 and by_key[6] == round(0.1 / 31, 6)
    assert by_key[1] == round(0.1 / 2 + 0.1 / 2, 6)  # konzerte in hamburg; hamburg ein konzert
    assert not [x for x in got if x[0] == 1]
    assert sorted(x[2] for x in got if x[0] == 2) == [3, 6]


def test_any_of_by_bm25(spark):
    import math

    index = opened(spark)
    got = {r["key"]: r["bm25"] for r in index.any_of(("abend", "hamburg"), 10).collect()}
    lengths = {i: len(re.findall(r"\w+", t or "")) for i, t in TEXTS}
    tf = {1: {"abend": 1, "hamburg": 1}, 2: {"abend": 2, "hamburg": 1}, 6: {"hamburg": 1}, 7: {"hamburg": 1}}
    df, avg = {"abend": 2, "hamburg": 4}, sum(lengths.values()) / len(TEXTS)
    idf = {t: max(math.log((len(TEXTS) - n + 0.5) / (n + 0.5)), 1e-6) for t, n in df.items()}
    want = {d: round(-sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[d] / avg)) for t, f in x.items()), 6) for d, x in tf.items()}
    assert got == want


def test_search_reads_no_text_and_few_folders(spark):
    index = opened(spark)
    plan = index.all_of(asked(spark, ("konzert",)), 5)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in str(re.findall(r"ReadSchema: .*", plan)) and "regexp_extract_all" not in plan
    narrow = index.of_terms(("konzert",))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in narrow or "PartitionFilters: [(bucket" in narrow
    assert "PushedFilters" in narrow and "term" in narrow


def test_empty_table(spark):
    index = opened(spark, [])
    assert index.all_of(asked(spark, ("konzert",)), 5).count() == 0 and index.any_of(("konzert",), 5).count() == 0
    assert text_index.first_terms(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_kept_until_files_change(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(path)
    first = text_index.open_index(spark.read.parquet(path))
    again = text_index.open_index(spark.read.parquet(path))
    assert first.postings.inputFiles() == again.postings.inputFiles()
    time.sleep(0.01)
    spark.createDataFrame([(9, "Neue Konzerte")], "doc_id long, text string").write.mode("append").parquet(path)
    later = text_index.open_index(spark.read.parquet(path))
    assert later.postings.inputFiles() != first.postings.inputFiles()
    assert 9 in [r["key"] for r in later.any_of(("konzert",), 10).collect()]


def test_first_terms_are_questions(spark):
    df = spark.createDataFrame([(1, "Eine Freundliche Straße, freundlich und weiter Häuser Konzerte"), (2, "in der")], "doc_id long, text string")
    assert sorted((r["query_id"], r["term"]) for r in text_index.first_terms(df, "doc_id", "text").collect()) == [(1, "freundlich"), (1, "haus"), (1, "strass")]


def test_words_of_an_earlier_task_are_not_stemmed_again(monkeypatch):
    import pyarrow as pa

    from marlstone.operators import text_index

    asked = []
    monkeypatch.setattr(text_index, "_stemmed", {"der": ""})
    monkeypatch.setattr(text_index, "stem", lambda w: asked.append(w) or w[:4])
    batch = pa.RecordBatch.from_pylist([{"key": 1, "t": ["der", "garten", "gartens"]}, {"key": 2, "t": ["garten"]}])
    rows = [[r for b in text_index._postings(iter([batch])) for r in b.to_pylist()] for _ in range(2)]
    assert rows[0] == rows[1] and [(r["key"], r["positions"]) for r in rows[0]] == [(1, [2, 3]), (2, [1])]
    assert sorted(asked) == ["garten", "gartens"]
