"""The digest of op6 comes from the rows of the training order."""

from collections import Counter

from marlstone.llm import mixing, queries
from oracle import rows_of


def test_taken_sums_the_training_order(spark, scratch):
    rows = [(i % 700, "w " * (i % 13), f"s{i % 4}" if i % 5 else None) for i in range(2000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch)
    got = mixing.taken(plan, scratch)
    order = mixing.training_order(plan).collect()
    want = Counter((r["doc_id"], r["size"] * r["passes"]) for r in plan.collect())
    assert Counter((r["doc_id"], r["taken"]) for r in got.collect()) == want
    assert any(n == 0 for _, n in want) and sum(r["size"] for r in order) == sum(n * k for (_, n), k in want.items())
    assert rows_of(mixing.taken(plan)) == rows_of(got)


def test_op6_runs_the_training_order(spark, data, monkeypatch):
    written, save = {}, queries.Scratch.save
    monkeypatch.setattr(queries.Scratch, "save", lambda self, df, name: written.setdefault(name, save(self, df, name)))
    whole = mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda plan: whole(plan).where("pass = 0"))
    got = queries.queries()["op6_source_mix"](spark, data).collect()
    assert all(r["taken"] in (0, r["size"]) for r in got)
    places = [r["position"] for r in written["order"].collect()]
    assert places and sum(a > b for a, b in zip(places, places[1:])) == 0 and len(set(places)) > 10
