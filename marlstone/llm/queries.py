"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import jaccard_join, mixing, packing, prefix_trie, quality_model, quality_rules, repeated_bytes, token_files, tool_calls, toxicity, turn_repair, url_graph, vector_dedup
from .shared import Scratch, held_out, ship

OPS = {}


def _op(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir, Scratch(spark, f.__name__))

    OPS[f.__name__] = run
    return run


@_op
def op1_quality_rules(spark, sf_dir, scratch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_op
def op2_bin_slack(spark, sf_dir, scratch):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)


@_op
def op3_toxicity(spark, sf_dir, scratch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), scratch)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@_op
def op4_token_files(spark, sf_dir, scratch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read_digests(token_files.write_files(docs, scratch))


@_op
def op5_projection_dedup(spark, sf_dir, scratch):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), scratch)


@_op
def op6_source_mix(spark, sf_dir, scratch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken(mixing.plan_mix(docs, scratch), scratch)


@_op
def op7_quality_trees(spark, sf_dir, scratch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.digest(quality_model.score(docs, model), quality_model.CUT)


@_op
def op8_jaccard_join(spark, sf_dir, scratch):
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch, width=3, num=9, den=10)


@_op
def op9_tool_calls(spark, sf_dir, scratch):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return tool_calls.format_chats(tool_calls.with_calls(chats), scratch)


@_op
def op10_url_graph(spark, sf_dir, scratch):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_graph.judge(pages, scratch).select("page_id", "host", "path", "rule", "verdict")


@_op
def op11_prefix_trie(spark, sf_dir, scratch):
    return prefix_trie.of_rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), scratch)


@_op
def op12_turn_repair(spark, sf_dir, scratch):
    return turn_repair.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), scratch)


@_op
def op13_repeated_bytes(spark, sf_dir, scratch):
    return repeated_bytes.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)


def queries():
    return dict(OPS)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _op1_sql() -> str:
    tests = ["NOT base_failed"]
    for r in quality_rules.RULES:
        tests += [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, rid, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(regexp_extract_all(t, '!'))::BIGINT AS bangs,
        len(list_filter(ws, lambda x: lower(x) IN ({_quoted(quality_rules.STOP_WORDS)})))::BIGINT AS stops,
        len(string_split(t, chr(10)))::BIGINT AS n_lines,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM w),
r AS (SELECT m.*, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        word_chars::DOUBLE / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols::DOUBLE / greatest(n_words, 1)::DOUBLE AS symbols_per_word,
        bangs::DOUBLE / greatest(n_words, 1)::DOUBLE AS bangs_per_word, stops::DOUBLE / greatest(n_words, 1)::DOUBLE AS stop_word_ratio,
        (len(ls) - len(list_distinct(ls)))::DOUBLE / n_lines::DOUBLE AS dup_line_ratio
      FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {" AND ".join(tests)} AS kept FROM b"""


def _op6_sql() -> str:
    w = ", ".join(map(str, mixing.WEIGHTS))
    ramps = ", ".join(f"{r}::DOUBLE" for r in mixing.RAMPS)
    k, n = len(mixing.WEIGHTS), mixing.MAX_PASSES
    fits = " + ".join(f"(middle + source_size * {i} <= target)::INT" for i in range(n))
    return f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
b AS (SELECT *, ('0x' || substr(h, 1, 6))::BIGINT % {mixing.BUCKETS} AS bucket FROM sized),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, ([{w}])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {k} + 1]::BIGINT AS weight,
        ([{ramps}])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.RAMPS)} + 1] AS ramp, source_size * {n} AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
s3 AS (SELECT *, cap * rest <= weight * (total - before) AS capped FROM s2),
s4 AS (SELECT source, source_size, ramp, CASE WHEN capped THEN cap::DOUBLE ELSE
        (weight * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM s3),
p AS (SELECT b.*, s4.source_size, s4.target, s4.ramp,
        sum(size) OVER (PARTITION BY b.source ORDER BY bucket, h, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE - size / 2.0::DOUBLE AS middle
      FROM b JOIN s4 ON b.source IS NOT DISTINCT FROM s4.source),
q AS (SELECT *, ({fits}) AS passes, CASE WHEN target > 0 THEN middle / target ELSE 0.0::DOUBLE END AS reached, 1.0::DOUBLE - ramp AS b FROM p)
SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken, CASE WHEN passes > 0 THEN
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN ramp = 0 THEN reached ELSE (sqrt(b * b + 4.0::DOUBLE * ramp * reached) - b) / (2.0::DOUBLE * ramp) END)) END AS first_position FROM q"""


def _op9_sql() -> str:
    """Texts of this table hold no control characters but line feeds."""
    q = lambda c: f"""'"' || replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""
    return f"""
WITH m AS (SELECT conv_id, turn, role, text, (turn // 2) % 4 AS kind, role = 'assistant' AS asks, role = 'user' AND turn > 1 AS answers FROM conversations),
a AS (SELECT conv_id, turn FROM m WHERE asks), r AS (SELECT conv_id, turn FROM m WHERE answers),
j AS (SELECT m.*, a1.turn IS NOT NULL AS e1, a2.turn IS NOT NULL AS e2, a3.turn IS NOT NULL AS e3, r.turn AS result, b.turn IS NOT NULL AS answered FROM m
  LEFT JOIN a a1 ON a1.conv_id = m.conv_id AND a1.turn = m.turn - 2 LEFT JOIN a a2 ON a2.conv_id = m.conv_id AND a2.turn = m.turn - 4
  LEFT JOIN a a3 ON a3.conv_id = m.conv_id AND a3.turn = m.turn - 6 LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn + 1
  LEFT JOIN a b ON b.conv_id = m.conv_id AND b.turn = m.turn - 1),
l AS (SELECT *, CASE WHEN NOT asks THEN NULL WHEN kind = 0 THEN 0 WHEN NOT e1 THEN NULL WHEN kind = 1 THEN 1 WHEN NOT e2 THEN NULL WHEN kind = 2 THEN 2 WHEN NOT e3 THEN NULL ELSE 3 END AS level,
  '{{"$ref":"c' || (turn - 2)::VARCHAR || '"}}' AS ref FROM j)
SELECT conv_id, turn, role, asks::INT AS n_calls, CASE WHEN asks THEN (result IS NOT NULL)::INT WHEN answers THEN answered::INT ELSE 0 END AS n_linked, level::INT AS level,
  CASE WHEN asks THEN level IS NOT NULL AND kind <> 2 AND result IS NOT NULL WHEN answers THEN answered ELSE true END AS valid,
  CASE WHEN asks THEN [result::BIGINT] ELSE []::BIGINT[] END AS result_turns,
  CASE WHEN asks THEN '{{"content":"","role":"assistant","tool_calls":[{{"arguments":' || CASE kind WHEN 0 THEN '{{"limit":' || turn::VARCHAR || ',"query":' || {q("text")} || '}}'
      WHEN 1 THEN '{{"url":' || ref || '}}' WHEN 2 THEN '{{"expression":' || ref || ',"precision":"2"}}' ELSE '{{"about":' || ref || '}}' END
      || ',"id":"c' || turn::VARCHAR || '","name":"' || ['search', 'fetch', 'calculate', 'note'][kind + 1] || '"}}]}}'
    WHEN answers THEN '{{"content":' || {q("text")} || ',"role":"user","tool_call_id":"c' || (turn - 1)::VARCHAR || '"}}'
    ELSE '{{"content":' || {q("text")} || ',"role":' || {q("role")} || '}}' END AS message FROM l"""


def _op10_sql() -> str:
    rules = url_graph.RULES
    by_length = sorted(rules, key=lambda r: (-len(r.spec), r.spec))
    case = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.spec}'" for r in by_length)
    allowed = _quoted(r.spec for r in rules if r.allow)
    link = url_graph.LINK.replace("'", "''")
    up = url_graph.UPPER, url_graph.LOWER
    steps = ["score0 AS MATERIALIZED (SELECT side, host, score FROM start)"]
    for i in range(url_graph.ROUNDS):
        steps.append(f"""score{i + 1} AS MATERIALIZED (SELECT side, host, sum(score) AS score FROM (
            SELECT a.side, a.dst AS host, s.score * a.share * {url_graph.DAMPING} AS score FROM score{i} s JOIN arcs a ON s.side = a.side AND s.host = a.src
            UNION ALL SELECT side, host, score FROM start) GROUP BY side, host)""")
    return f"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{up[0]}', '{up[1]}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {case} END AS rule FROM u),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{up[0]}', '{up[1]}') AS dst FROM r WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
a0 AS (SELECT 1 AS side, src, dst, n FROM e UNION ALL SELECT 0, dst, src, n FROM e),
arcs AS MATERIALIZED (SELECT side, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY side, src) AS share FROM a0),
start AS MATERIALIZED (SELECT DISTINCT (rule IN ({allowed}))::INT AS side, host, {1.0 - url_graph.DAMPING}::DOUBLE AS score FROM r WHERE rule IS NOT NULL AND host <> ''),
{", ".join(steps)},
h AS (SELECT host, round(sum(CASE WHEN side = 1 THEN score ELSE 0 END), 9) AS trust, round(sum(CASE WHEN side = 0 THEN score ELSE 0 END), 9) AS distrust FROM score{url_graph.ROUNDS} GROUP BY host),
bad AS (SELECT host FROM h WHERE distrust >= {url_graph.THRESHOLD} AND distrust > trust)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op6_source_mix": _op6_sql(), "op9_tool_calls": _op9_sql(), "op10_url_graph": _op10_sql()}
