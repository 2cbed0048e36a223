import json

import corpus_pipeline
from marlstone.llm import jaccard_join, mixing, quality_model, quality_rules, tool_calls
from marlstone.llm.shared import Scratch


def call(key, name, args):
    return {"id": key, "name": name, "arguments": args}


def test_tool_calls(spark, scratch):
    say = lambda *calls: json.dumps({"content": None, "tool_calls": list(calls)})
    answer = lambda key: json.dumps({"tool_call_id": key, "content": "é"}, ensure_ascii=True)
    rows = [
        (1, 0, "user", "hi \"there\""), (1, 1, "assistant", say(call("b", "fetch", {"url": {"$ref": "a"}}), call("a", "search", {"query": "x", "limit": 3}))),
        (1, 2, "tool", answer("a")), (1, 3, "tool", answer("b")), (1, 4, "tool", answer("zz")),
        (2, 0, "assistant", say(call("a", "search", {"limit": True}))), (2, 1, "tool", answer("a")),
        (3, 0, "assistant", say(call("p", "any", {"x": {"$ref": "q"}}), call("q", "any", {"x": {"$ref": "p"}}))), (3, 1, "tool", answer("p")), (3, 2, "tool", answer("q")),
        (4, 0, None, None), (4, 1, "assistant", "{not json"), (None, None, "user", ""), (5, 0, "assistant", say(call(None, "any", {}), call("r", "any", '{"k": 1}'))), (5, 1, "tool", answer("r")),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["n_calls"], r["n_linked"], r["level"], r["valid"]) for r in tool_calls.format_chats(df, scratch).collect()}
    assert got[1, 0] == (0, 0, None, True) and got[1, 1] == (2, 2, 1, True) and got[1, 2] == (0, 1, None, True) and got[1, 4] == (0, 0, None, False)
    assert got[2, 0] == (1, 1, 0, False) and got[2, 1] == (0, 1, None, True)
    assert got[3, 0] == (2, 2, None, False) and got[5, 0][:2] == (2, 1) and not got[5, 0][3]
    assert got[4, 0] == got[4, 1] == got[None, None] == (0, 0, None, True)
    text = {(r["conv_id"], r["turn"]): r["message"] for r in tool_calls.format_chats(df, scratch).collect()}
    assert text[1, 2] == '{"content":"é","role":"tool","tool_call_id":"a"}' and text[1, 0] == '{"content":"hi \\"there\\"","role":"user"}'
    assert tool_calls.format_chats(df.limit(0), scratch).count() == 0


def test_pipeline_is_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scratch = Scratch(spark, "test")
    model = quality_model.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r["doc_id"] for r in quality_model.score(docs, model).where(f"score >= {quality_model.CUT}").collect()}
    kept = {r["doc_id"] for r in quality_rules.apply_rules(docs).where("kept").collect()} & good
    left = docs.where(docs["doc_id"].isin(*kept))
    first = {r["component_id"] for r in jaccard_join.join(left, scratch, width=5, num=8, den=10).collect()}
    mixed = mixing.mixed_documents(left.where(left["doc_id"].isin(*first)), scratch)
    want = sorted(r["doc_id"] for r in mixed.select("doc_id").collect())
    got = corpus_pipeline.run(spark, data).collect()
    assert sorted(r["doc_id"] for r in got if r["piece"] == 0) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "source_mix", "best_fit_packing"]


def test_stages_on_odd_rows(spark, data, odd_docs):
    for rows in (odd_docs, odd_docs.limit(0)):
        df = rows.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, data).columns == list(corpus_pipeline.COLUMNS)
        assert corpus_pipeline.deduplicate(spark, df, data).count() <= df.count()
        corpus_pipeline.pack(spark, df, data).count()
