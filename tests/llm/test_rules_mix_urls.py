import re
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm import mixing, quality_rules, url_graph


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_rows(spark, odd_docs):
    got = quality_rules.apply_rules(odd_docs).collect()
    assert len(got) == odd_docs.count() and "size" in got[0].asDict()
    for r in got:
        want = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["kept"] and r["base_failed"])
    assert quality_rules.apply_rules(odd_docs.limit(0)).count() == 0


def test_mix_hits_targets_and_caps(spark, scratch):
    rows = [(i, "w " * (i % 13 + 1), "big" if i % 3 else f"s{i % 4}") for i in range(3000)] + [(9001, None, None), (9002, "x y", None), (9002, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs, scratch)
    got = mixing.taken(plan).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    sources = {s: (n, t) for s, n, t in ((r["source"], r["source_size"], r["target"]) for r in plan.collect())}
    total = sum(r["size"] for r in got)
    assert abs(sum(t for _, t in sources.values()) - total) < 1e-6 * total
    # water-filling by hand
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    want, left = {}, set(sources)
    while left:
        share = (total - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share > 3 * sources[s][0] + 1e-9}
        want |= {s: 3 * sources[s][0] for s in over} if over else {s: weight[s] * share for s in left}
        left = left - over if over else set()
    for s, (n, t) in sources.items():
        assert abs(t - want[s]) < 1e-6
        took = sum(r["size"] * r["passes"] for r in plan.where(F.col("source").eqNullSafe(s)).collect())
        assert abs(took - t) <= 13
    assert sorted(mixing.taken(mixing.plan_mix(docs, scratch)).collect()) == sorted(got)


def test_training_order(spark, scratch, odd_docs):
    out = mixing.mixed_documents(odd_docs, scratch)
    assert out.columns == odd_docs.columns
    order = mixing.training_order(mixing.plan_mix(odd_docs, scratch)).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and all(0 <= r["position"] <= 1 for r in order)
    assert out.count() == len(order)
    assert mixing.mixed_documents(odd_docs.limit(0), scratch).count() == 0


def test_url_rules_and_links(spark, scratch):
    rows = [
        (1, "http://A.Example.org/es/1?x", None), (2, "https://example.org/en/12", ""), (3, "http://x.com/de/", '<a href="http://bad.net/">'),
        (4, "http://bad.net/x", '<a href="//X.com/de/9">'), (5, "http://good.net/x", '<a href="http://good.com/fr/">'), (6, None, None), (7, "no scheme", "<a>"),
        (8, "http://good.com/fr/a#b", '<a href="http://good.net/">'), (9, "http://notorg/", None), (10, "ftp://h.org?q=/es/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_graph.judge(df, scratch).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/de/", "block") and got[4] == ("bad.net", "/x", None, "block")
    assert got[5][3] == "allow" and got[8] == ("good.com", "/fr/a", "com/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[9][2] is None and got[10] == ("h.org", "", None, "allow")
    assert url_graph.judge(df.limit(0), scratch).count() == 0
