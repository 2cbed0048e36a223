"""Hostile messages, topological order and the linked query."""

import json

from pyspark.sql import functions as F

from marlstone.llm import tool_calls


def test_hostile_messages(spark, scratch):
    deep = '{"tool_calls":[{"id":"a","name":"any","arguments":' + '{"x":' * 3000 + "1" + "}" * 3000 + "}]}"
    text_deep = json.dumps({"tool_calls": [{"id": "a", "name": "any", "arguments": "[" * 200_000}]})
    rows = [
        (1, 0, "assistant", deep), (2, 0, "assistant", text_deep), (3, 0, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"any","arguments":{"k":"\\udfff"}}]}'),
        (3, 1, "tool", '{"tool_call_id":"\\ud800","content":1e999}'), (4, 0, "assistant", '{"tool_calls":[{"id":"a","name":"any","arguments":{"x":NaN}}]}'),
        (5, 0, "user", "x" * 1_000_000), (6, 0, "assistant", '{"tool_calls":[]}'), (6, 1, "tool", "[1]"), (7, 0, "assistant", '{"tool_calls":[null, 3]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash")).withColumn("level", F.lit(9))
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.format_chats(df, scratch).collect()}
    assert len(got) == len(rows)
    assert all(json.loads(r["message"])["role"] in ("assistant", "tool", "user") for r in got.values())
    assert [got[k]["n_calls"] for k in ((1, 0), (2, 0), (3, 0), (4, 0), (6, 0), (7, 0))] == [1, 1, 1, 0, 0, 2]
    assert got[3, 0]["message"].count("�") == 2 and got[3, 0]["n_linked"] == 0 and got[5, 0]["valid"]
    assert not got[7, 0]["valid"] and got[7, 0]["level"] is None


def test_calls_are_written_in_topological_order(spark, scratch):
    call = lambda key, ref=None: {"id": key, "name": "any", "arguments": {"x": {"$ref": ref}} if ref else {}}
    text = json.dumps({"content": "", "tool_calls": [call("d", "c"), call("z", "none"), call("c", "b"), call("a"), call("b", "a")]})
    rows = [(1, 0, "assistant", text), (1, 1, "tool", '{"tool_call_id":"b"}'), (1, 2, "tool", '{"tool_call_id":"d"}'), (1, 3, "tool", '{"tool_call_id":"d"}')]
    got = {r["turn"]: r for r in tool_calls.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), scratch).collect()}
    assert [c["id"] for c in json.loads(got[0]["message"])["tool_calls"]] == ["a", "b", "c", "d", "z"]
    assert got[0]["result_turns"] == [None, 1, None, 2, None] and got[0]["level"] == 3 and got[0]["n_linked"] == 2
    assert [got[t]["valid"] for t in range(4)] == [False, True, True, False]


def test_query_links_calls(spark):
    from marlstone.llm.queries import queries

    rows = queries()["op9_tool_calls"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n_calls"] for r in rows) > 50 and any(r["level"] == 3 for r in rows) and any(not r["valid"] for r in rows) and sum(r["n_linked"] for r in rows) > 50


def test_texts_of_any_depth():
    import random

    rng = random.Random(1)
    for depth in (5, 60_000):
        text = "".join(rng.choice(['{"b":[1,"x",{}],"a":', "[null,"]) for _ in range(depth))
        text += "-1.5e3" + "".join("}" if c == "{" else "]" for c in reversed([c for c in __import__("re").sub(r'\[1,"x",\{\}\]', "", text) if c in "{["]))
        value = tool_calls.load(text)
        again = tool_calls.canonical(value)
        assert again == "".join(tool_calls._written(tool_calls._read(text)))
        assert len(again) > depth and (depth > 1000 or again == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")))
    for bad in ("", "[", "[1,]", '{"a"}', "{'a':1}", "[1 2]", "nul", "[1]]", '{"a":1,}'):
        for read in (tool_calls._read, json.loads):
            try:
                read(bad)
                raise AssertionError(bad)
            except ValueError:
                pass
    deep = "[" * 200 + "]" * 200
    assert tool_calls.load(deep, 200) and tool_calls.parse("assistant", '{"tool_calls":[' + deep + "]}", {}, 100)[2] == []


def chats(spark, calls):
    """One message per call: (conv, id, refs)."""
    rows = [(c, t, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "any", "arguments": [{"$ref": r} for r in refs]}]})) for t, (c, i, refs) in enumerate(calls)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_levels_of_chains_trees_and_cycles(spark, scratch):
    calls = [(1, f"n{i}", [f"n{i - 1}"] if i else []) for i in range(2000)]
    calls += [(2, "a", []), (2, "b", ["a"]), (2, "c", ["b"]), (2, "d", ["c", "a"]), (2, "e", ["d"]), (2, "f", ["e", "c", "b"]), (2, "g", ["f", "none"]), (2, "h", ["g"]), (2, "i", ["none"]), (2, "j", ["i"])]
    calls += [(3, "x", ["y"]), (3, "y", ["x"]), (3, "z", ["x"]), (3, "w", ["w"]), (3, "v", ["z", "u"]), (3, "u", []), (3, "p", ["q", "u"]), (3, "q", ["p", "u"]), (3, "r", ["u"])]
    before = scratch.n
    got = {(r["conv_id"], r["turn"]): r["level"] for r in tool_calls.format_chats(chats(spark, calls), scratch).collect()}
    assert scratch.n - before < 40
    by = {(c, i): got[c, t] for t, (c, i, _) in enumerate(calls)}
    assert [by[1, f"n{i}"] for i in range(2000)] == list(range(2000))
    assert [by[2, i] for i in "abcdefghij"] == [0, 1, 2, 3, 4, 5, None, None, None, None]
    assert [by[3, i] for i in "xyzwvupqr"] == [None] * 5 + [0, None, None, 1]


def test_result_without_turn_comes_last(spark, scratch):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "any", "arguments": {}}]})
    rows = [(1, 0, "assistant", call), (1, None, "tool", '{"tool_call_id":"a","content":1}'), (1, 5, "tool", '{"tool_call_id":"a","content":3}'), (1, 5, "tool", '{"tool_call_id":"a","content":2}')]
    got = tool_calls.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), scratch).collect()
    assert {r["message"][11]: r["n_linked"] for r in got if r["role"] == "tool"} == {"1": 0, "2": 1, "3": 0}
    assert [r["result_turns"] for r in got if r["role"] == "assistant"] == [[5]]
