"""Snapshots, edits of lists and nested answers, provider lookups, sort orders and integrity checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators.running import places
from ..scratch import Tables
from ..session import table
from .registry import query

#: The fields of an order that a snapshot may overlay.
SNAPSHOT_FIELDS = ("status", "priority")


@query("""WITH s AS (SELECT o_custkey AS artist, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey),
c AS (SELECT c_custkey AS artist, 'none' AS status, c_mktsegment AS segment FROM customer)
SELECT c.artist, coalesce(s.status, c.status) AS status, s.priority, c.segment, s.artist IS NOT NULL AS restored FROM c LEFT JOIN s ON s.artist = c.artist""")
def snapshot_restore(spark, sf_dir):
    """The allowed fields of a stored payload overlay an artist's entry; other payload keys are ignored."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    payload = F.create_map(F.lit("status"), F.max_by("o_orderstatus", "o_orderkey"), F.lit("priority"), F.max_by("o_orderpriority", "o_orderkey"), F.lit("clerk"), F.lit("x"))
    stored = o.groupBy(F.col("o_custkey").alias("artist")).agg(F.map_filter(payload, lambda k, v: k.isin(*SNAPSHOT_FIELDS)).alias("new"))
    entry = F.create_map(F.lit("status"), F.lit("none"), F.lit("segment"), F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artist"), entry.alias("old")).join(stored, "artist", "left")
    new = F.coalesce("new", F.create_map().cast("map<string,string>"))
    whole = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(new, k)), new)
    return c.withColumn("m", whole).select("artist", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("status", "priority", "segment")), F.col("new").isNotNull().alias("restored"))


@query("""WITH a AS (SELECT l_orderkey AS id, list_sort(array_agg(DISTINCT l_suppkey)) AS songs FROM lineitem GROUP BY l_orderkey)
SELECT id, len(songs) AS n, CASE WHEN list_contains(songs, 7) THEN list_filter(songs, lambda x: x <> 7) ELSE list_sort(list_concat(songs, [7])) END AS toggled,
 list_sort(list_distinct(list_concat(songs, [7]))) AS added, list_filter(songs, lambda x: x <> 7) AS removed FROM a""")
def toggled_songs(spark, sf_dir):
    """Toggling, adding (once only) and removing one entry of a list."""
    seven = F.lit(7).cast("long")
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("long"))).alias("songs"))
    without, with_ = F.array_remove("songs", 7), F.array_sort(F.array_union("songs", F.array(seven)))
    return a.select("id", F.size("songs").cast("long").alias("n"), F.when(F.array_contains("songs", seven), without).otherwise(with_).alias("toggled"), with_.alias("added"), without.alias("removed"))


@query("""WITH q AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS frage, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS antwort,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END NULLS FIRST) AS i FROM lineitem)
SELECT id, count(*) AS questions, count(CASE WHEN antwort IS NULL THEN 1 END) AS open_before, count(CASE WHEN antwort IS NULL AND i <> 2 THEN 1 END) AS open_after,
  count(*) >= 2 AS accepted, count(*) + 1 AS log_entries FROM q GROUP BY id""")
def order_questions(spark, sf_dir):
    """Open questions; the second is answered if there is one; a status line is appended."""
    line = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("antwort"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("q"))
    answered = F.transform("q", lambda x, i: F.when(i == 1, x.withField("antwort", F.lit("ja"))).otherwise(x))
    open_ = lambda a: F.size(F.filter(a, lambda x: x["antwort"].isNull())).cast("long")
    log = F.array_append(F.transform("q", lambda x: x["l_linenumber"].cast("string")), F.lit("fertig"))
    return g.select("id", F.size("q").cast("long").alias("questions"), open_("q").alias("open_before"), open_(answered).alias("open_after"), (F.size("q") >= 2).alias("accepted"), F.size(log).cast("long").alias("log_entries"))


@query("""WITH k AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE 'nobody' END AS asked FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT n_name AS name, lower(n_name) AS slug, n_nationkey AS provider FROM nation)
SELECT k.id, coalesce(a.provider, b.provider) AS provider, CASE WHEN a.provider IS NOT NULL THEN 'name' WHEN b.provider IS NOT NULL THEN 'slug' ELSE 'unknown' END AS found_by
FROM k LEFT JOIN p a ON a.name = k.asked LEFT JOIN p b ON b.slug = k.asked""")
def provider_lookup(spark, sf_dir):
    """A provider by its display name, else by its slug."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey") % 3
    asked = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.when(key == 0, F.col("n_name")).when(key == 1, F.lower("n_name")).otherwise("nobody").alias("asked"))
    by = lambda name, as_: n.select(name.alias("asked"), F.col("n_nationkey").alias(as_))
    j = asked.join(by(F.col("n_name"), "_a"), "asked", "left").join(by(F.lower("n_name"), "_b"), "asked", "left")
    return j.select("id", F.coalesce("_a", "_b").alias("provider"), F.when(F.col("_a").isNotNull(), "name").when(F.col("_b").isNotNull(), "slug").otherwise("unknown").alias("found_by"))


@query("""WITH p AS (SELECT s_nationkey AS model, s_name AS name, s_acctbal >= 0 AS reachable, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 3 = 1 END AS keeps, s_suppkey AS seq FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY model, reachable, keeps ORDER BY seq) AS n, row_number() OVER (PARTITION BY model, reachable ORDER BY seq) AS b FROM p)
SELECT model, count(CASE WHEN reachable THEN 1 END) AS reachable, count(CASE WHEN reachable AND keeps THEN 1 END) AS keeping, count(CASE WHEN reachable AND keeps IS NULL THEN 1 END) AS unknown,
 string_agg(CASE WHEN reachable AND keeps AND n <= 6 THEN name END, ', ' ORDER BY seq) AS keeping_names, string_agg(CASE WHEN NOT reachable AND b <= 8 THEN name END, ', ' ORDER BY seq) AS blocked_names FROM r GROUP BY model""")
def provider_partition(spark, sf_dir):
    """Providers of a model by reach and retention; unknown is a state of its own; the first six keeping and eight blocked ones are named."""
    third = F.col("s_suppkey") % 3
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("model"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("reachable"), F.when(third != 0, third == 1).alias("keeps"), F.col("s_suppkey").alias("seq"))
    nth = lambda *by: F.row_number().over(Window.partitionBy("model", *by).orderBy("seq"))
    r = p.withColumns({"n": nth("reachable", "keeps"), "b": nth("reachable")})
    named = lambda which: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("seq", "name")))), lambda x: x["name"]), ", "), F.lit(""))
    return r.groupBy("model").agg(
        F.count_if("reachable").alias("reachable"), F.count_if(F.col("reachable") & F.col("keeps")).alias("keeping"), F.count_if(F.col("reachable") & F.col("keeps").isNull()).alias("unknown"),
        named(F.col("reachable") & F.col("keeps") & (F.col("n") <= 6)).alias("keeping_names"), named(~F.col("reachable") & (F.col("b") <= 8)).alias("blocked_names"),
    )


@query("SELECT user_id, sum(round(abs(value) * 100)::BIGINT) / 16000.0::DOUBLE AS seconds, count(*) AS frames FROM events GROUP BY user_id")
def recording_seconds(spark, sf_dir):
    """How long a recording is, from the lengths of its frames at 16,000 a second."""
    frames = F.round(F.abs("value") * 100).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(frames).cast("double") / F.lit(16000.0)).alias("seconds"), F.count("*").alias("frames"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS model, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS day, s_name, s_acctbal, s_acctbal >= 0 AS reachable FROM supplier)
SELECT id, CAST(row_number() OVER (PARTITION BY model ORDER BY day = '', day, id) AS INTEGER) AS empty_last, CAST(row_number() OVER (PARTITION BY model ORDER BY length(day) DESC, day, id) AS INTEGER) AS longest_first,
CAST(row_number() OVER (PARTITION BY model ORDER BY s_acctbal DESC, id DESC) AS INTEGER) AS newest_first, CAST(row_number() OVER (PARTITION BY model ORDER BY reachable DESC, id) AS INTEGER) AS reachable_first FROM s""")
def sort_orders(spark, sf_dir):
    """Places under four orders: empty last, longest first, two keys descending, reachable first in given order."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("model"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("day"), "s_acctbal", (F.col("s_acctbal") >= 0).alias("reachable"))
    tables, out = Tables(spark, "orders"), None
    orders = {
        "empty_last": ["_empty", "day", "id"], "longest_first": [F.desc("_long"), "day", "id"], "newest_first": [F.desc("s_acctbal"), F.desc("id")], "reachable_first": [F.desc("reachable"), "id"],
    }
    s = s.withColumns({"_empty": F.col("day") == "", "_long": F.length("day")})
    for name, order in orders.items():  # places by ranges of a model's rows
        found = places(s, ["model"], order, name, tables).select("id", name)
        out = found if out is None else out.join(found, "id")
    return out


@query("SELECT name, host, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS name, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) GROUP BY name, host")
def answer_sources(spark, sf_dir):
    """U8: sources of an answer, once per name and address."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("name"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return p.groupBy("name", "host").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT o_orderkey AS id, 'Show ' || CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END || ' live' AS title FROM orders)
SELECT id, CASE WHEN regexp_matches(title, '\d{2}\.\d{2}\.\d{4}') THEN regexp_extract(title, '(\d{2})\.(\d{2})\.(\d{4})', 3) || '-' || regexp_extract(title, '(\d{2})\.(\d{2})\.(\d{4})', 2) || '-' || regexp_extract(title, '(\d{2})\.(\d{2})\.(\d{4})', 1)
 WHEN regexp_matches(title, '\d{2}/\d{2}/\d{4}') THEN regexp_extract(title, '(\d{2})/(\d{2})/(\d{4})', 3) || '-' || regexp_extract(title, '(\d{2})/(\d{2})/(\d{4})', 2) || '-' || regexp_extract(title, '(\d{2})/(\d{2})/(\d{4})', 1)
 ELSE regexp_extract(title, '\d{4}-\d{2}-\d{2}') END AS day FROM t""")
def title_dates(spark, sf_dir):
    """a date in a title, in three formats, as ISO; empty without one."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(key == 0, F.date_format(d, "dd.MM.yyyy")).when(key == 1, F.date_format(d, "dd/MM/yyyy")).when(key == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Show "), raw, F.lit(" live")).alias("title"))
    turned = lambda mark: F.nullif(F.regexp_replace(F.regexp_extract("title", rf"\d{{2}}{mark}\d{{2}}{mark}\d{{4}}", 0), rf"(\d+){mark}(\d+){mark}(\d+)", "$3-$2-$1"), F.lit(""))
    return t.select("id", F.coalesce(turned(r"\."), turned("/"), F.regexp_extract("title", r"\d{4}-\d{2}-\d{2}", 0)).alias("day"))


@query("SELECT o_orderkey AS id, list_contains(['1-URGENT', '2-HIGH'], o_orderpriority) AS exact, contains(lower(o_orderpriority), 'high') AS part FROM orders")
def tour_filters(spark, sf_dir):
    """A tour in a list of names parted by bars, and a name within a tour's, in lower case."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.array_contains(F.split(F.lit("1-URGENT|2-HIGH"), r"\|"), F.col("o_orderpriority")).alias("exact"), F.lower("o_orderpriority").contains("high").alias("part"))


@query("""WITH v AS (SELECT c_custkey AS id, trim(CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'a. ' || c_name ELSE c_name END) AS venue FROM customer)
SELECT id, venue <> '' AND lower(venue) NOT IN ('unbekannt', 'unknown', 'hamburg') AND length(venue) < 80 AND NOT contains(substr(venue, 1, 3), '.') AS plausible FROM v""")
def venue_answers(spark, sf_dir):
    """Whether an answer can be a venue: not empty, not unknown, short, no sentence."""
    key = F.col("c_custkey") % 5
    v = F.trim(F.when(key == 0, "").when(key == 1, "Unknown").when(key == 2, F.concat(F.lit("a. "), "c_name")).otherwise(F.col("c_name")))
    fine = (F.col("venue") != "") & ~F.lower("venue").isin("unbekannt", "unknown", "hamburg") & (F.length("venue") < 80) & ~F.substring("venue", 1, 3).contains(".")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), v.alias("venue")).select("id", fine.alias("plausible"))


@query("""SELECT d.doc_id, e.vec_id IS NULL OR len(e.embedding) = 0 AS missing, e.vec_id IS NOT NULL AND len(list_filter(e.embedding, lambda x: x <> 0)) = 0 AS silent
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def vector_backfill(spark, sf_dir):
    """Documents whose vector is missing, and vectors that are zero throughout."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.size("embedding") == 0).alias("none"), (~F.exists("embedding", lambda x: x != 0)).alias("zero"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left")
    return d.select("doc_id", F.coalesce("none", F.lit(True)).alias("missing"), F.coalesce("zero", F.lit(False)).alias("silent"))


@query("""SELECT l_orderkey AS id, count(*) AS lines, count(*) - count(DISTINCT l_partkey) AS repeated_titles, count(*) = count(DISTINCT l_partkey) AS unique_titles,
min(l_quantity) >= 1 AND max(l_quantity) <= 50 AS in_bounds, count(CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 1 END) = 0 AS known_kind FROM lineitem GROUP BY l_orderkey""")
def integrity_checks(spark, sf_dir):
    """V1, V2, V4: titles unique in a list, kinds of an enumeration, values within bounds."""
    li = table(spark, sf_dir, "lineitem")
    titles = F.count_distinct("l_partkey")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("lines"), (F.count("*") - titles).alias("repeated_titles"), (F.count("*") == titles).alias("unique_titles"),
        ((F.min("l_quantity") >= 1) & (F.max("l_quantity") <= 50)).alias("in_bounds"), (F.count_if(~F.col("l_returnflag").isin("A", "N", "R")) == 0).alias("known_kind"),
    )


@query("""SELECT substr(CAST(o_orderkey AS VARCHAR), 1, 2) AS prefix, min(o_orderkey) AS id, count(*) AS n FROM orders GROUP BY 1""")
def prefix_lookup(spark, sf_dir):
    """For each prefix of two digits the first record whose id begins with it."""
    return table(spark, sf_dir, "orders").groupBy(F.substring(F.col("o_orderkey").cast("string"), 1, 2).alias("prefix")).agg(F.min("o_orderkey").alias("id"), F.count("*").alias("n"))


@query("""WITH i AS (SELECT l_suppkey AS artist, l_partkey AS image, CASE WHEN l_returnflag = 'R' AND l_quantity >= 25 THEN 1 WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 3 END AS tier FROM lineitem),
t AS (SELECT artist, image, min(tier) AS tier FROM i WHERE tier IS NOT NULL GROUP BY artist, image), n AS (SELECT artist, count(CASE WHEN tier = 1 THEN 1 END) AS a, count(CASE WHEN tier <= 2 THEN 1 END) AS b FROM t GROUP BY artist),
k AS (SELECT t.*, row_number() OVER (PARTITION BY t.artist ORDER BY tier, image) AS place FROM t JOIN n ON n.artist = t.artist WHERE tier = 1 OR (tier = 2 AND a < 4) OR (tier = 3 AND CASE WHEN a < 4 THEN b ELSE a END < 4))
SELECT artist, image, tier, CAST(place AS INTEGER) AS place FROM k WHERE place <= 8""")
def image_tiers(spark, sf_dir):
    """Images by source; a later source only counts while there are fewer than four; the first eight are shown."""
    flag = F.col("l_returnflag")
    tier = F.when((flag == "R") & (F.col("l_quantity") >= 25), 1).when(flag == "A", 2).when(flag == "N", 3)
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("artist"), F.col("l_partkey").alias("image"), tier.alias("tier")).where("tier is not null").groupBy("artist", "image").agg(F.min("tier").alias("tier"))
    n = t.groupBy("artist").agg(F.count_if(F.col("tier") == 1).alias("a"), F.count_if(F.col("tier") <= 2).alias("b"))
    used = (F.col("tier") == 1) | ((F.col("tier") == 2) & (F.col("a") < 4)) | ((F.col("tier") == 3) & (F.when(F.col("a") < 4, F.col("b")).otherwise(F.col("a")) < 4))
    return t.join(n, "artist").where(used).withColumn("place", F.row_number().over(Window.partitionBy("artist").orderBy("tier", "image"))).where("place <= 8").select("artist", "image", "tier", "place")


@query("""SELECT conv_id, turn, '[' || role || '] ' || CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || ' …[gekürzt]' ELSE text END AS line FROM conversations""")
def context_lines(spark, sf_dir):
    """Messages as lines of a model's context, long ones cut at 1,200 characters with a mark."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), "role", F.lit("] "), F.when(F.length(t) > 1200, F.concat(F.substring(t, 1, 1200), F.lit(" …[gekürzt]"))).otherwise(t)).alias("line"))


@query(r"""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Error 429: Retry will occur after: ' || (event_id % 900) || ' s' WHEN 1 THEN 'retry in ' || (event_id % 60) || 's' ELSE 'failed' END AS err FROM events)
SELECT event_id, coalesce(CAST(nullif(regexp_extract(err, '[Rr]etry.*?(\d+)\s*s', 1), '') AS INTEGER), 0) AS seconds FROM e""")
def retry_seconds(spark, sf_dir):
    """the seconds to wait that an error text names, else 0."""
    key = F.col("event_id")
    err = F.when(key % 3 == 0, F.concat(F.lit("Error 429: Retry will occur after: "), (key % 900).cast("string"), F.lit(" s"))).when(key % 3 == 1, F.concat(F.lit("retry in "), (key % 60).cast("string"), F.lit("s"))).otherwise("failed")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(F.regexp_extract(err, r"[Rr]etry.*?(\d+)\s*s", 1), F.lit("")).cast("int"), F.lit(0)).alias("seconds"))


@query("""WITH a AS (SELECT p_partkey AS id, contains(lower(p_type), 'promo') AS other, trim(lower(p_name)) AS k FROM part)
SELECT id, CAST(row_number() OVER (PARTITION BY k ORDER BY other, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY k) AS of_name FROM a WHERE k <> ''""")
def candidate_ranking(spark, sf_dir):
    """Entries of exactly one normalised name in given order, those that are marked as something else last."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_type").contains("promo").alias("other"), name_key(F.col("p_name")).alias("k")).where("k <> ''")
    return a.select("id", F.row_number().over(Window.partitionBy("k").orderBy("other", "id")).alias("place"), F.count("*").over(Window.partitionBy("k")).alias("of_name"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w),
k AS (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS place FROM c QUALIFY place <= 40), d AS (SELECT *, row_number() OVER (PARTITION BY lower(w) ORDER BY place) AS r FROM k)
SELECT w, n, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS place FROM d WHERE r = 1 QUALIFY row_number() OVER (ORDER BY place) <= 20""")
def most_common_names(spark, sf_dir):
    """The forty most frequent words, one of each spelling apart from case, the first twenty of these."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    k = w.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(40)
    d = k.withColumn("r", F.row_number().over(Window.partitionBy(F.lower("w")).orderBy(F.desc("n"), "w"))).where("r = 1")
    top = d.orderBy(F.desc("n"), "w").limit(20)  # twenty rows at most
    return top.select("w", "n", F.row_number().over(Window.orderBy(F.desc("n"), "w")).alias("place"))


@query("""SELECT c_custkey AS id, coalesce(nullif(c_mktsegment, ''), c_name) || ', ' || n_name AS place FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def display_locations(spark, sf_dir):
    """Festival or else venue, and the city."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), F.concat(F.coalesce(F.nullif("c_mktsegment", F.lit("")), "c_name"), F.lit(", "), "n_name").alias("place"))


@query("""WITH a AS (SELECT l_orderkey AS id, list_sort(array_agg(DISTINCT CASE WHEN l_linenumber > 4 THEN l_suppkey END)) AS s, list_sort(array_agg(DISTINCT CASE WHEN l_linenumber <= 4 THEN l_suppkey END)) AS m FROM lineitem GROUP BY l_orderkey)
SELECT id, list_concat(list_filter(s, lambda x: x IS NOT NULL), list_filter(m, lambda x: x IS NOT NULL)) AS artists FROM a""")
def support_first(spark, sf_dir):
    """All artists of a list, support acts first."""
    some = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("l_suppkey"))))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(some(F.col("l_linenumber") > 4), some(F.col("l_linenumber") <= 4)).alias("artists"))
