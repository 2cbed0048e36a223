"""Catalogue answers and facets, missing fields, title search, context lengths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .registry import query

HITS = 8
SHOWN = 120

_ID = "CASE p_partkey % 7 WHEN 0 THEN '~' ELSE '' END || replace(p_name, ' ', '-') || '-' || p_partkey || CASE p_partkey % 7 WHEN 1 THEN ':batch' WHEN 2 THEN ':free' ELSE '' END"


@query(f"""WITH p AS (SELECT *, {_ID} AS id, p_partkey // 25 AS page FROM part)
SELECT id, p_name AS name, CAST(p_size * 1000 AS BIGINT) AS context_length, p_size > 25 AS eu FROM p
WHERE page % 11 <> 3 AND page % 13 <> 5 AND NOT starts_with(id, '~') AND NOT contains(id, ':batch') AND NOT contains(id, ':free')""")
def model_catalog(spark, sf_dir):
    """Entries of catalogue answers without helper entries, flagged by membership in a second catalogue.

    An answer that is no JSON, or without data, gives no entries."""
    p = table(spark, sf_dir, "part").withColumn("id", F.expr(_ID))
    page = F.floor(F.col("p_partkey") / 25)
    entry = F.struct("id", F.col("p_name").alias("name"), (F.col("p_size") * 1000).alias("context_length"))
    answers = p.groupBy(page.alias("page")).agg(F.collect_list(entry).alias("data"))
    body = F.when(F.col("page") % 11 == 3, "<html>bad gateway</html>").when(F.col("page") % 13 == 5, '{"data": null}').otherwise(F.to_json(F.struct("data")))
    found = answers.select(F.explode(F.from_json(body, "data array<struct<id: string, name: string, context_length: long>>")["data"]).alias("m")).select("m.*")
    chat = found.where(~(F.col("id").startswith("~") | F.col("id").contains(":batch") | F.col("id").contains(":free")))
    eu = p.where("p_size > 25").select("id", F.lit(True).alias("eu")).distinct()
    return chat.join(eu, "id", "left").withColumn("eu", F.coalesce("eu", F.lit(False)))


@query(f"""WITH m AS (SELECT p_partkey AS id, p_name AS name, p_retailprice > 950 AS unstored, p_partkey % 3 = 0 AS images, p_partkey % 5 = 0 AS files, p_size > 20 AS tools FROM part),
r AS (SELECT 1 AS request, id FROM m WHERE unstored
UNION ALL SELECT 2, id FROM m WHERE (images OR files) AND contains(lower(name), 'widget')
UNION ALL SELECT 3, id FROM m WHERE unstored AND (images OR files) AND tools AND contains(lower(name), 'cold'))
SELECT request, id, CAST(row_number() OVER (PARTITION BY request ORDER BY id) AS INTEGER) AS place FROM r QUALIFY place <= {SHOWN}""")
def model_facets(spark, sf_dir):
    """P20: for each request all its flags, where images or files stand for "images", the retention lock and a part of the name; 120 are shown."""
    m = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), (F.col("p_retailprice") > 950).alias("unstored"),
        F.create_map(F.lit("images"), (F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") % 5 == 0), F.lit("tools"), F.col("p_size") > 20).alias("flags"),
    )
    asks = [(1, True, [], ""), (2, False, ["images"], "widget"), (3, True, ["images", "tools"], "cold")]
    ask = F.array(*(F.struct(F.lit(n).alias("request"), F.lit(lock).alias("lock"), F.array(*map(F.lit, need)).cast("array<string>").alias("need"), F.lit(term).alias("term")) for n, lock, need, term in asks))
    fits = (~F.col("lock") | F.col("unstored")) & F.forall("need", lambda f: F.element_at("flags", f)) & F.col("name").contains(F.col("term"))
    hits = m.withColumn("ask", F.explode(ask)).select("*", "ask.*").where(fits)
    return hits.select("request", "id", F.row_number().over(Window.partitionBy("request").orderBy("id")).alias("place")).where(F.col("place") <= SHOWN)


@query("""WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Stage ' || c_nationkey END AS stage, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '18:30' END AS start, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS day FROM customer)
SELECT * FROM s WHERE stage IS NULL OR stage = '' OR start IS NULL OR start = '' OR day IS NULL OR day = ''""")
def missing_slots(spark, sf_dir):
    """Acts without stage, start or day, null and empty alike."""
    key = F.col("c_custkey")
    stage = F.when(key % 4 == 1, "").when(key % 4 > 1, F.concat(F.lit("Stage "), F.col("c_nationkey").cast("string")))
    s = table(spark, sf_dir, "customer").select(key.alias("id"), stage.alias("stage"), F.when(key % 6 == 0, "").otherwise("18:30").alias("start"), F.when(key % 7 != 0, F.col("c_mktsegment")).alias("day"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return s.where(empty("stage") | empty("start") | empty("day"))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Hamburg' ELSE o_orderpriority END AS venue FROM orders)
SELECT id FROM v WHERE coalesce(venue, 'Hamburg') = 'Hamburg'""")
def unknown_venues(spark, sf_dir):
    """Shows whose venue is the default, or missing."""
    key = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 5 == 1, "Hamburg").when(key % 5 > 1, F.col("o_orderpriority")).alias("venue"))
    return v.where(F.coalesce("venue", F.lit("Hamburg")) == "Hamburg").select("id")


@query(f"""WITH t AS (SELECT p_partkey AS track, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title, split_part(p_name, ' ', 1) AS word, p_brand AS artist FROM part),
q AS (SELECT track AS query, word, CASE WHEN track % 40 = 0 THEN artist ELSE 'nobody' END AS artist FROM t WHERE track % 20 = 0),
s AS (SELECT query, track, title, true AS strict FROM q JOIN t USING (word, artist) QUALIFY row_number() OVER (PARTITION BY query ORDER BY track) <= {HITS}),
l AS (SELECT query, track, title, false AS strict FROM q JOIN t USING (word) WHERE query NOT IN (SELECT query FROM s) QUALIFY row_number() OVER (PARTITION BY query ORDER BY track) <= {HITS})
SELECT query, strict, min(track) AS track, arg_min(title, track) AS title FROM (SELECT * FROM s UNION ALL SELECT * FROM l) GROUP BY query, strict, lower(title)""")
def title_search(spark, sf_dir):
    """Eight tracks of title and artist, or of the title alone where there are none; one for each title in any case.

    Tracks are cut to the first eight of each key before queries meet them, so a query brings eight rows at most."""
    key = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(key.alias("track"), F.when(key % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"), F.substring_index("p_name", " ", 1).alias("word"), F.col("p_brand").alias("artist"))
    q = t.where("track % 20 = 0").select(F.col("track").alias("query"), "word", F.when(F.col("track") % 40 == 0, F.col("artist")).otherwise("nobody").alias("artist"))
    first = lambda *by: t.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("track"))).where(F.col("_n") <= HITS)
    strict = q.join(first("word", "artist"), ["word", "artist"]).select("query", "track", "title", F.lit(True).alias("strict"))
    rest = q.join(t.select("word", "artist").distinct(), ["word", "artist"], "left_anti")
    loose = rest.join(first("word").drop("artist"), "word").select("query", "track", "title", F.lit(False).alias("strict"))
    return strict.union(loose).groupBy("query", "strict", F.lower("title").alias("_t")).agg(F.min("track").alias("track"), F.min_by("title", "track").alias("title")).drop("_t")


@query("""WITH c AS (SELECT conv_id, CAST(round(coalesce(sum(length(text)), 0) / 3.0) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)
SELECT conv_id, tokens, context_length, context_length > 0 AND tokens * 10 > context_length * 7 AS too_long FROM c, (VALUES (0), (250), (1000), (8000)) v(context_length)""")
def context_fill(spark, sf_dir):
    """Estimated tokens of a conversation against 70 % of context lengths; 0 is an unknown length."""
    tokens = F.round(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 3).cast("long")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tokens.alias("tokens"))
    n = F.col("context_length")
    return c.withColumn("context_length", F.explode(F.array(*map(F.lit, (0, 250, 1000, 8000))))).withColumn("too_long", (n > 0) & (F.col("tokens") * 10 > n * 7))
