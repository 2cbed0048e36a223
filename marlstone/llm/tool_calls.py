"""Chat formatting: tool calls are linked to results, ordered, checked against schemas and written as JSON.

A message's text is plain, or a JSON object: an assistant's ``{"content": ..., "tool_calls": [{"id", "name",
"arguments"}]}``, or a tool's ``{"tool_call_id": ..., "content": ...}``. Calls and results meet in a hash
join on conversation and call id. Arguments that name another call as ``{"$ref": id}`` put a call behind it;
levels come from repeated joins until nothing changes, and calls on a cycle, or behind a missing call, have no level. Calls of a message are written in topological order, by level and place, those without level
last. Arguments are validated against the tool's schema (types and required names). JSON is canonical:
sorted keys, no spaces, text as it is.

One row per message: conv_id, turn, role, n_calls, n_linked (calls with a result, or 1 for a linked
result), level (the deepest of its calls), valid (all calls and results are linked, ordered and follow
their schema; plain messages are), result_turns (of each call in written order the turn of its result, null
without), message (canonical JSON). Nulls: a null text is an empty message, a null role an empty role, null
ids never link. Text that is no such object is plain, and so is one that
holds numbers that JSON has not (NaN, infinities) or nests deeper than ``max_depth``, if that is given; arguments given
as such a text stay text. Texts may nest and be as long as they like: what the interpreter's stack does not bear is read and
written by loops. Of repeated keys the last counts. Lone surrogates become U+FFFD. Of results that repeat an id the first
by turn is linked, those without turn last and ties by message; repeated calls share it. Conversations of any length are
never gathered. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .tokens import slices

#: Tool name: {argument: (JSON type, required)}; tools not listed may take any object.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "precision": ("integer", False)},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}

PARSED = """conv_id long, turn long, mid long, role string, message string, result_id string,
calls array<struct<id: string, valid: boolean, refs: array<string>, place: int, json: string>>"""
_CALL = pa.struct([("id", pa.string()), ("valid", pa.bool_()), ("refs", pa.list_(pa.string())), ("place", pa.int32()), ("json", pa.string())])
_SURROGATES = re.compile("[\ud800-\udfff]")


def clean(text: str | None) -> str | None:
    return text if text is None else _SURROGATES.sub("\ufffd", text)


def canonical(value) -> str:
    try:
        text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        text = "".join(_written(value))
    return clean(text)


def _written(value) -> Iterator[str]:
    """The same text, with the open lists and objects on a stack of its own."""
    todo: list = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Raw):
            yield v
        elif isinstance(v, dict) and v:
            parts: list = [_Raw("{")]
            for i, k in enumerate(sorted(v)):
                parts += [_Raw("," * (i > 0) + json.dumps(k, ensure_ascii=False) + ":"), v[k]]
            todo += reversed([*parts, _Raw("}")])
        elif isinstance(v, list) and v:
            parts = [_Raw("[")]
            for i, x in enumerate(v):
                parts += [_Raw("," * (i > 0)), x]
            todo += reversed([*parts, _Raw("]")])
        else:
            yield json.dumps(v, ensure_ascii=False, separators=(",", ":"))


class _Raw(str):
    """Text of the result, not a value."""


def _no_constant(name: str):
    raise ValueError(name)


_SPACE, _PLAIN = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _read(text: str):
    """``json.loads`` as a loop: open lists and objects are on a stack, with the key that waits for its value."""
    space = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple] = []
    i = space(0)

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("key")
        key, i = json.decoder.scanstring(text, i + 1, True)
        i = space(i)
        if text[i : i + 1] != ":":
            raise ValueError("colon")
        return key, space(i + 1)

    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            i = space(i + 1)
            value: object = {} if c == "{" else []
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, i = key_at(i)
                stack.append((value, key))
                continue
            i += 1
        elif c == '"':
            value, i = json.decoder.scanstring(text, i + 1, True)
        else:
            m = _PLAIN.match(text, i)
            if not m:
                raise ValueError("value")
            value, i = json.loads(m[0]), m.end()
        while stack:
            holder, key = stack.pop()
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            i = space(i)
            if text[i : i + 1] == ",":
                i = space(i + 1)
                if isinstance(holder, dict):
                    key, i = key_at(i)
                stack.append((holder, key))
                break
            if text[i : i + 1] != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("end")
            i, value = i + 1, holder
        else:
            if space(i) != len(text):
                raise ValueError("more")
            return value


def load(text: str, max_depth: int | None = None):
    """The value of a JSON text; ValueError for what is none, nests deeper than ``max_depth`` or holds numbers beyond JSON's."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        value = _read(text)
    level, depth = [value], 0
    while level:
        depth += 1
        if max_depth is not None and depth > max_depth or any(isinstance(v, float) and not math.isfinite(v) for v in level):
            raise ValueError("not a message")
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return value


def follows(arguments, schema: dict | None) -> bool:
    """Required names are there, all names are known, and values have their type; a reference fits any type."""
    if not isinstance(arguments, dict):
        return False
    if schema is None:
        return True
    for name, value in arguments.items():
        if name not in schema:
            return False
        if isinstance(value, dict) and set(value) == {"$ref"}:
            continue
        kind = schema[name][0]
        if not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind != "boolean"):
            return False
    return all(name in arguments for name, (_, needed) in schema.items() if needed)


def references(value) -> list[str]:
    found, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str):
                found.append(v["$ref"])
            else:
                todo += v.values()
        elif isinstance(v, list):
            todo += v
    return found


def parse(role: str, text: str, schemas: dict, max_depth: int | None = None) -> tuple[str, str | None, list[dict]]:
    """Canonical message (of one with calls the part before them), the call id that it answers, and its calls."""
    body = None
    if text[:1] == "{":
        try:
            body = load(text, max_depth)
        except ValueError:
            body = None
    if isinstance(body, dict) and isinstance(body.get("tool_calls"), list) and body["tool_calls"]:
        calls = []
        for place, c in enumerate(body["tool_calls"]):
            c = c if isinstance(c, dict) else {}
            arguments = c.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = load(arguments, max_depth)
                except ValueError:
                    pass
            name, key = c.get("name"), c.get("id")
            key = clean(key) if isinstance(key, str) else None
            ok = isinstance(name, str) and follows(arguments, schemas.get(name))
            refs = sorted({clean(r) for r in references(arguments)})
            calls.append({"id": key, "valid": ok, "refs": refs, "place": place, "json": canonical({"id": key, "name": name, "arguments": arguments})})
        return canonical({"role": role, "content": body.get("content")})[:-1] + ',"tool_calls":[', None, calls
    if isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
        answers = clean(body["tool_call_id"])
        return canonical({"role": role, "tool_call_id": answers, "content": body.get("content")}), answers, []
    return canonical({"role": role, "content": text}), None, []


def _parser(schemas: dict, max_depth: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                roles = [r or "" for r in b.column("role").to_pylist()]
                found = [parse(r, t or "", schemas, max_depth) for r, t in zip(roles, b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("conv_id", "turn", "mid")), pa.array(roles, pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(_CALL))],
                    ["conv_id", "turn", "mid", "role", "message", "result_id", "calls"],
                )

    return run


def _levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, id, level): 0 for calls that refer to none, else one more than the deepest they refer to."""
    node = ["conv_id", "id"]
    ids = scratch.save(calls.select(*node).distinct(), "ids")
    arcs = scratch.save(calls.select(*node, F.explode("refs").alias("ref")).distinct(), "arcs")
    if arcs.isEmpty():
        return ids.withColumn("level", F.lit(0))
    there = arcs.join(ids.select("conv_id", F.col("id").alias("ref"), F.lit(1).alias("_is")), ["conv_id", "ref"], "left")
    degrees = scratch.save(there.groupBy(*node).agg(F.count("*").alias("n"), F.count("_is").alias("n_there")), "degrees")

    # chains: a call with one reference points at the next call that has none or several, and knows how far that is
    ends = scratch.save(arcs.join(degrees.where("n = 1"), node).select(*node, F.col("ref").alias("to"), F.lit(1).alias("far")), "chain")
    total = ends.count()
    for _ in range(max(1, total).bit_length() + 1):
        over = ends.select("conv_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        moved = ends.join(over, ["conv_id", "to"], "left")
        if moved.where("_to is not null").isEmpty():
            break
        ends = scratch.save(moved.select(*node, F.coalesce("_to", "to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).cast("int").alias("far")), "chain")

    # calls with several references, by rounds over those whose level is new
    jump = ends.select("conv_id", F.col("id").alias("ref"), "to", "far")
    several = arcs.join(degrees.where("n > 1 and n = n_there").select(*node), node)
    open_ = several.join(jump, ["conv_id", "ref"], "left").select(*node, F.coalesce("to", "ref").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    open_ = scratch.save(open_.withColumn("level", F.lit(None).cast("int")), "several")
    done = new = scratch.save(ids.join(degrees.select(*node), node, "left_anti").withColumn("level", F.lit(0)), "level")
    while not open_.isEmpty() and not new.isEmpty():
        got = open_.join(new.select("conv_id", F.col("id").alias("to"), F.col("level").alias("_l")), ["conv_id", "to"], "left")
        last, open_ = open_, scratch.save(got.select(*node, "to", "far", F.coalesce("level", F.col("_l") + F.col("far")).cast("int").alias("level")), "several")
        scratch.drop(last)
        new = scratch.save(open_.groupBy(*node).agg(F.max("level").alias("level"), F.count_if(F.col("level").isNull()).alias("_open")).where("_open = 0").drop("_open"), "level")
        done, last = done.unionByName(new), open_
        open_ = scratch.save(open_.join(new.select(*node), node, "left_anti"), "several")
        scratch.drop(last)
    chained = ends.join(done.select("conv_id", F.col("id").alias("to"), "level"), ["conv_id", "to"]).select(*node, (F.col("level") + F.col("far")).cast("int").alias("level"))
    return done.unionByName(chained)


def format_chats(messages: DataFrame, scratch: Scratch, schemas: dict = SCHEMAS, max_depth: int | None = None) -> DataFrame:
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("mid"), "role", "text")
    parsed = scratch.save(rows.mapInArrow(_parser(schemas, max_depth), PARSED), "parsed")
    calls = parsed.where(F.size("calls") > 0).select("mid", "conv_id", F.explode("calls").alias("c")).select("mid", "conv_id", "c.*")
    calls = scratch.save(calls, "calls")
    results = parsed.where("result_id is not null").groupBy("conv_id", F.col("result_id").alias("id")).agg(F.min(F.struct(F.col("turn").isNull().alias("_none"), "turn", "message", "mid")).alias("_result"))
    levels = _levels(calls.where("id is not null").select("conv_id", "id", "refs"), scratch)
    linked = calls.join(results, ["conv_id", "id"], "left").join(levels, ["conv_id", "id"], "left")
    written = F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("l"), "place", F.col("_result.turn").alias("turn"), "json")))
    per_message = linked.groupBy("mid").agg(  # the calls of one message, which came in one text
        F.count("_result").cast("int").alias("_linked"), F.max("level").alias("level"),
        F.min(F.col("valid") & F.col("level").isNotNull() & F.col("_result").isNotNull()).alias("_calls_ok"), written.alias("_written"),
    )
    answered = results.join(calls.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_semi").select(F.col("_result.mid").alias("mid"), F.lit(True).alias("_answers"))
    plain = parsed.select("mid", "conv_id", "turn", "role", "message", "result_id", F.size("calls").alias("n_calls"))
    out = plain.join(per_message, "mid", "left").join(answered, "mid", "left")
    is_result = F.col("result_id").isNotNull()
    return out.select(
        "conv_id", "turn", "role", "n_calls",
        F.when(is_result, F.coalesce("_answers", F.lit(False)).cast("int")).otherwise(F.coalesce("_linked", F.lit(0))).alias("n_linked"),
        "level",
        F.when(is_result, F.coalesce("_answers", F.lit(False))).otherwise(F.coalesce("_calls_ok", F.lit(True))).alias("valid"),
        F.coalesce(F.transform("_written", lambda c: c["turn"]), F.array().cast("array<bigint>")).alias("result_turns"),
        F.when(F.col("n_calls") > 0, F.concat("message", F.array_join(F.transform("_written", lambda c: c["json"]), ","), F.lit("]}"))).otherwise(F.col("message")).alias("message"),
    )


def with_calls(messages: DataFrame) -> DataFrame:
    """Plain conversations as tool conversations: each assistant turn calls a tool, and a user's turn after the first answers the call before it.

    By turn the call is a search with the turn's text, then calls of other tools that refer to the call two
    turns before, one of them with an argument of the wrong type. Other turns stay plain.
    """
    kind = F.pmod(F.floor(F.col("turn") / 2), F.lit(4))
    before = F.struct(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string")).alias("$ref"))
    arguments = (
        F.when(kind == 0, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("query"), F.col("turn").alias("limit"))))
        .when(kind == 1, F.to_json(F.struct(before.alias("url"))))
        .when(kind == 2, F.to_json(F.struct(before.alias("expression"), F.lit("2").alias("precision"))))
        .otherwise(F.to_json(F.struct(before.alias("about"))))
    )
    name = F.element_at(F.array(F.lit("search"), F.lit("fetch"), F.lit("calculate"), F.lit("note")), (kind + 1).cast("int"))
    call = F.array(F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), name.alias("name"), arguments.alias("arguments")))
    asks = F.to_json(F.struct(F.lit("").alias("content"), call.alias("tool_calls")))
    answers = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    text = F.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), asks).when((F.col("role") == "user") & (F.col("turn") > 1), answers).otherwise(F.col("text"))
    return messages.select("conv_id", "turn", "role", text.alias("text"))
