"""Extraction queries: acts, names, timetables, dates with places, answers, tasks and terminal boxes.

The tables hold no announcements, so most queries write them from columns, by the same rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extraction as X
from ..functions import rules
from ..session import table, tasks_for
from .registry import query

_L = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ACTS = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '(?i:{lead})[\\s:\\-–]+({X.ACT_NAME.replace(chr(39), chr(39) * 2)})', 1)" + (")" if n == 1 else "") for n, lead in enumerate(X.ACT_LEADS)) + ")"


@query(f"""WITH t AS (SELECT c_custkey AS id, c_mktsegment AS main, CASE c_custkey % 4 WHEN 0 THEN 'Live. Support Act: ' || n_name || ' Kings. Special guests – ' || c_mktsegment || ', supported by ' || n_name || ' kings'
 WHEN 1 THEN 'support acts - Tickets Now; Special Guest: The Rest' WHEN 2 THEN 'Supported by R&B Sons of ' || n_name || ' and support act ' || n_name ELSE c_name END AS text FROM customer JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT id, main, {_ACTS} AS a FROM t)
SELECT id, list_filter(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), lambda x: lower(x) <> lower(main) AND split_part(regexp_replace(lower(x), '\\s', ' ', 'g'), ' ', 1) NOT IN {_L(X.NO_ACTS)}) AS acts FROM f""")
def support_act_names(spark, sf_dir):
    """F16: support acts in announcements, in the order of their leads."""
    c, n, key = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), F.col("c_custkey") % 4
    first = F.concat(F.lit("Live. Support Act: "), "n_name", F.lit(" Kings. Special guests – "), "c_mktsegment", F.lit(", supported by "), "n_name", F.lit(" kings"))
    third = F.concat(F.lit("Supported by R&B Sons of "), "n_name", F.lit(" and support act "), "n_name")
    text = F.when(key == 0, first).when(key == 1, "support acts - Tickets Now; Special Guest: The Rest").when(key == 2, third).otherwise(F.col("c_name"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("id"), X.support_acts(text, F.col("c_mktsegment")).alias("acts"))


_BARE = r"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(x, '[ \t\r\n\f\v]+', ' ', 'g')), '[.!?]+\z', '')), '\A(?i:and|und|feat\.?|ft\.?)\s+', ''))"


@query(rf"""WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '#{{1,4}}\s+', chr(10), 'g'), '[,|\n•·/]'), lambda x: {_BARE}) AS a FROM documents),
n AS (SELECT doc_id, list_filter(a, lambda x: length(x) BETWEEN 2 AND 50 AND len(regexp_split_to_array(trim(x), '\s+')) <= 5 AND regexp_matches(x, '\p{{L}}') AND NOT regexp_matches(x, '[0-9]{{4}}')) AS a FROM p)
SELECT doc_id, len(a) AS n_names, md5(array_to_string(a, '|')) AS names FROM n""")
def names_in_texts(spark, sf_dir):
    """plausible names between separators."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.names_in(F.col("text"), rules.plausible_name).alias("a"))
    return d.select("doc_id", F.size("a").cast("long").alias("n_names"), F.md5(F.array_join("a", "|").cast("binary")).alias("names"))


@query("""WITH t AS (SELECT c_custkey AS id, ['BUILDING', 'MACHINERY', 'HOUSEHOLD'][c_custkey % 3 + 1] AS festival, 'lineup of ' || lower(c_mktsegment) || ' and ' || n_name AS text FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id, festival, text FROM t WHERE len(list_filter(['BUILDING', 'MACHINERY', 'HOUSEHOLD'], lambda f: f <> festival AND contains(lower(text), lower(f)))) = 0""")
def other_festivals_dropped(spark, sf_dir):
    """Texts of a festival that name none of the other known ones."""
    known = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "HOUSEHOLD")))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    t = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("id"), F.element_at(known, (F.col("c_custkey") % 3 + 1).cast("int")).alias("festival"), F.concat(F.lit("lineup of "), F.lower("c_mktsegment"), F.lit(" and "), "n_name").alias("text"),
    )
    return t.where(~F.exists(known, lambda f: (f != F.col("festival")) & F.lower("text").contains(F.lower(f))))


_DAY = lambda t: "CASE " + " ".join(f"WHEN contains(lower({t}), '{m}') THEN '{d}'" for m, d in X.DAYS.items()) + " END"
_RE = lambda t, p, g: f"nullif(regexp_extract({t}, '{p}', {g}), '')"


@query(f"""WITH l AS (SELECT l_orderkey AS page, l_suppkey AS artist, l_linenumber AS n, l_partkey, l_quantity::BIGINT AS q FROM lineitem),
t AS (SELECT page, artist, row_number() OVER (PARTITION BY page ORDER BY n, artist, l_partkey, q) AS i, CASE WHEN n % 4 = 3 THEN ['Freitag', 'SATURDAY', 'am Sonntag'][page % 3 + 1]
 ELSE 'Supplier ' || artist || CASE q % 4 WHEN 0 THEN ' 18:30 - 19:45 Utopia Stage' WHEN 1 THEN ' ab 20:15' WHEN 2 THEN ' parkstage' ELSE '' END END AS line, n % 4 = 3 AS head FROM l),
w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ctx,
 last_value({_DAY("line")} IGNORE NULLS) OVER (PARTITION BY page ORDER BY i ROWS UNBOUNDED PRECEDING) AS running FROM t),
s AS (SELECT page, artist, i, coalesce(running, {_DAY("ctx")}) AS day, {_RE("ctx", X.STAGE, 1)} AS stage, coalesce({_RE("ctx", X.TIME_RANGE, 1)}, {_RE("ctx", r"\b(\d{1,2}:\d{2})\b", 1)}) AS start_time, {_RE("ctx", X.TIME_RANGE, 2)} AS end_time FROM w WHERE NOT head)
SELECT page, artist, day, stage, start_time, end_time FROM s WHERE coalesce(day, stage, start_time) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, artist ORDER BY i) = 1""")
def timetable_from_text(spark, sf_dir):
    """An artist's first line with a day, stage or time; the day holds for the lines below it, stage and
    times may stand up to four lines later."""
    q, n, page = F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_orderkey")
    head = F.element_at(F.array(*map(F.lit, ("Freitag", "SATURDAY", "am Sonntag"))), (page % 3 + 1).cast("int"))
    slot = F.when(q % 4 == 0, " 18:30 - 19:45 Utopia Stage").when(q % 4 == 1, " ab 20:15").when(q % 4 == 2, " parkstage").otherwise("")
    line = F.when(n % 4 == 3, head).otherwise(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"), slot))
    t = table(spark, sf_dir, "lineitem").select(page.alias("page"), F.col("l_suppkey").alias("artist"), n.alias("n"), "l_partkey", q.alias("q"), line.alias("line"))
    lines = Window.partitionBy("page").orderBy("n", "artist", "l_partkey", "q")
    w = t.select(
        "page", "artist", "n", F.row_number().over(lines).alias("i"), F.array_join(F.collect_list("line").over(lines.rowsBetween(0, 4)), "\n").alias("ctx"),
        F.last(X.day_in(F.col("line")), True).over(lines.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
    )
    found = lambda p, g: F.nullif(F.regexp_extract("ctx", p, g), F.lit(""))
    s = w.where("n % 4 <> 3").select(
        "page", "artist", "i", F.coalesce("running", X.day_in(F.col("ctx"))).alias("day"), found(X.STAGE, 1).alias("stage"),
        F.coalesce(found(X.TIME_RANGE, 1), found(r"\b(\d{1,2}:\d{2})\b", 1)).alias("start_time"), found(X.TIME_RANGE, 2).alias("end_time"),
    )
    some = s.where(F.coalesce("day", "stage", "start_time").isNotNull())
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("page", "artist").orderBy("i"))).where("_n = 1").drop("_n", "i")


_VENUE = lambda t: "CASE " + " ".join(f"WHEN contains(lower({t}), '{w}') THEN '{X.VENUES[w]}'" for w in X.longest_first(X.VENUES)) + " END"
CITIES = ("Berlin", "Köln", "Hamburg", "Nürnberg")
_CITY = r"(?i)(" + "|".join(CITIES) + ")"


@query(f"""WITH t AS (SELECT c_custkey AS id, repeat(c_name || ' ', c_custkey % 11) || (1 + c_custkey % 28) || '.6.2026 ' || ['Barclays Arena', 'Grosse Freiheit', 'Mehr! Theater Logo'][c_custkey % 3 + 1] || ' ' || repeat('x ', c_custkey % 97)
 || ['berlin', 'Köln', 'nirgends', 'Nürnberg'][c_custkey % 4 + 1] || ' 2026-07-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || ' end' AS text FROM customer),
s AS (SELECT id, text, regexp_split_to_array(text, '{X.DATE}') AS parts, regexp_extract_all(text, '{X.DATE}') AS dates FROM t),
p AS (SELECT id, text, dates[i] AS raw, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(dates[1:i - 1], lambda x: length(x))), 0) AS before FROM s, unnest(range(1, len(dates) + 1)) r(i)),
n AS (SELECT id, raw, substr(text, greatest(before - 140, 0)::BIGINT + 1, (before - greatest(before - 140, 0) + length(raw) + 140)::BIGINT) AS snip FROM p)
SELECT id, CASE WHEN raw LIKE '20__-%' THEN raw ELSE split_part(raw, '.', 3) || '-' || lpad(split_part(raw, '.', 2), 2, '0') || '-' || lpad(split_part(raw, '.', 1), 2, '0') END AS day,
coalesce({_VENUE("snip")}, nullif(regexp_extract(snip, '{_CITY}', 1), ''), '') AS place, length(snip) AS width FROM n""")
def date_snippet_places(spark, sf_dir):
    """Dates with the venue, else the city, that stands within 140 characters."""
    key = F.col("c_custkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))
    day = (key % 28 + 1).cast("string")
    text = F.concat(
        F.repeat(F.concat("c_name", F.lit(" ")), (key % 11).cast("int")), day, F.lit(".6.2026 "), pick(("Barclays Arena", "Grosse Freiheit", "Mehr! Theater Logo")), F.lit(" "), F.repeat(F.lit("x "), (key % 97).cast("int")),
        pick(("berlin", "Köln", "nirgends", "Nürnberg")), F.lit(" 2026-07-"), F.lpad(day, 2, "0"), F.lit(" end"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = c.repartition(tasks_for(c, 20_000), "c_custkey").select(key.alias("id"), F.inline(X.date_snippets(text)))
    snip = F.concat("before", "date", "after")
    city = F.regexp_extract(snip, _CITY, 1)
    return s.select("id", X.iso_date(F.col("date")).alias("day"), X.venue_in(snip, city).alias("place"), F.length(snip).cast("long").alias("width"))


@query("""WITH o AS (SELECT o_custkey AS id, o_orderpriority = '1-URGENT' AS rip, 'Act ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status FROM orders),
g AS (SELECT id, string_agg(CASE WHEN rip THEN name END, ', ' ORDER BY name) AS rip, string_agg(CASE WHEN NOT rip THEN name || ' (' || day || ' Hall ' || status || ')' END, ', ' ORDER BY name) AS hh,
 string_agg(CASE WHEN NOT rip THEN name || ' (' || day || ')' END, ', ' ORDER BY name) AS short FROM o GROUP BY id),
d AS (SELECT id, concat_ws(' | ', 'RiP 2026: ' || rip, 'HH: ' || hh) AS whole, concat_ws(' | ', 'RiP 2026: ' || rip, 'HH: ' || short) AS short FROM g)
SELECT id, CASE WHEN length(whole) <= 300 THEN whole WHEN length(short) <= 300 THEN short ELSE substr(short, 1, 297) || '…' END AS description FROM d""")
def playlist_descriptions(spark, sf_dir):
    """acts and shows in at most 300 characters; places are left out first, then the text is cut.

    The first 100 names of a kind are more than 300 characters, so no more of them meet; lengths are sums over all.
    """
    rip = F.col("o_orderpriority") == "1-URGENT"
    name, day = F.concat(F.lit("Act "), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), rip.alias("rip"), name.alias("name"), F.when(rip, name).otherwise(F.concat(name, F.lit(" ("), day, F.lit(" Hall "), "o_orderstatus", F.lit(")"))).alias("long"),
        F.when(rip, name).otherwise(F.concat(name, F.lit(" ("), day, F.lit(")"))).alias("short"),
    )
    size = lambda c: F.sum(F.length(c) + 2) - 2 + F.when(F.col("rip"), 10).otherwise(4)
    sums = o.groupBy("id", "rip").agg(size("long").alias("n_long"), size("short").alias("n_short"))
    sums = sums.groupBy("id").agg(*((F.sum(c) + 3 * (F.count("*") - 1)).alias(c) for c in ("n_long", "n_short")))
    first = o.withColumn("_n", F.row_number().over(Window.partitionBy("id", "rip").orderBy("name"))).where("_n <= 100")
    part = lambda flag, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("name", c)))), lambda x: x[c]), ", ")
    both = lambda c: F.concat_ws(" | ", F.concat(F.lit("RiP 2026: "), F.nullif(part(F.col("rip"), "short"), F.lit(""))), F.concat(F.lit("HH: "), F.nullif(part(~F.col("rip"), c), F.lit(""))))
    d = first.groupBy("id").agg(both("long").alias("l"), both("short").alias("s")).join(sums, "id")
    return d.select("id", F.when(F.col("n_long") <= 300, F.col("l")).when(F.col("n_short") <= 300, F.col("s")).otherwise(F.concat(F.substring("s", 1, 297), F.lit("…"))).alias("description"))


@query("""WITH a AS (SELECT p_partkey AS id, p_name, CASE p_partkey % 5 WHEN 0 THEN '```json' || chr(10) || to_json([split_part(p_name, ' ', 1), '', p_brand]) || chr(10) || '```' WHEN 1 THEN '```' || to_json([p_name]) || '```'
 WHEN 2 THEN ' ' || to_json([p_name, p_type]) WHEN 3 THEN '{"a": 1}' ELSE '[broken' END AS raw FROM part),
b AS (SELECT id, p_name, trim(translate(regexp_replace(regexp_replace(trim(raw), '\\A```(?:json)?', ''), '```\\z', ''), chr(10), ' ')) AS raw FROM a),
f AS (SELECT id, p_name, list_filter(CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'ARRAY' THEN from_json(CASE WHEN json_valid(raw) THEN raw ELSE '[]' END, '["VARCHAR"]') ELSE [] END, lambda x: x <> '') AS facts FROM b)
SELECT id, facts, list_filter(facts, lambda x: x <> p_name) AS unseen FROM f""")
def answer_facts(spark, sf_dir):
    """Facts of an answer in a code fence, and those that are not known yet."""
    key = F.col("p_partkey") % 5
    js = lambda *c: F.to_json(F.array(*c))
    raw = F.when(key == 0, F.concat(F.lit("```json\n"), js(F.substring_index("p_name", " ", 1), F.lit(""), "p_brand"), F.lit("\n```"))).when(key == 1, F.concat(F.lit("```"), js("p_name"), F.lit("```")))
    raw = raw.when(key == 2, F.concat(F.lit(" "), js("p_name", "p_type"))).when(key == 3, '{"a": 1}').otherwise("[broken")
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", X.fenced_list(raw).alias("facts"))
    return a.select("id", "facts", F.array_remove("facts", F.col("p_name")).alias("unseen"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN [url] ELSE [url, 'https://b.example/'] END AS urls,
CASE WHEN page_id % 3 = 0 THEN [coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), url)] ELSE [coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), url), 'https://b.example/'] END AS titles FROM pages WHERE url IS NOT NULL""")
def answer_citations(spark, sf_dir):
    """addresses and titles of an answer's citations; other notes and those without an address are passed over."""
    note = lambda kind, url, title: F.struct(F.lit(kind).alias("type"), F.struct(url.cast("string").alias("url"), title.cast("string").alias("title")).alias("url_citation"))
    none = F.lit(None)
    notes = F.array(
        note("file", F.lit("x"), none), note("url_citation", F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1)), note("url_citation", none, F.lit("t")),
        note("url_citation", F.when(F.col("page_id") % 3 != 0, "https://b.example/"), none),
    )
    cited = F.transform(F.filter(notes, lambda x: (x["type"] == "url_citation") & (F.coalesce(x["url_citation"]["url"], F.lit("")) != "")), lambda x: x["url_citation"])
    p = table(spark, sf_dir, "pages").where("url is not null").select("page_id", cited.alias("c"))
    return p.select("page_id", F.transform("c", lambda x: x["url"]).alias("urls"), F.transform("c", lambda x: F.coalesce(F.nullif(x["title"], F.lit("")), x["url"])).alias("titles"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Commit: `' || md5(CAST(o_orderkey AS VARCHAR)) || '` gepusht' WHEN 1 THEN 'Push fehlgeschlagen ' || repeat(o_orderpriority, 60) WHEN 2 THEN 'nichts' ELSE '' END AS t FROM orders)
SELECT id, nullif(regexp_extract(t, 'Commit:\\s*`([^`]+)`', 1), '') AS commit_id, CASE WHEN contains(lower(t), 'gepusht') OR contains(t, 'Push') THEN NOT contains(t, 'Push fehlgeschlagen') END AS pushed, nullif(substr(t, 1, 300), '') AS short FROM r""")
def result_details(spark, sf_dir):
    """commit, push and the first 300 characters of a result."""
    key = F.col("o_orderkey")
    t = F.when(key % 4 == 0, F.concat(F.lit("Commit: `"), F.md5(key.cast("string").cast("binary")), F.lit("` gepusht"))).when(key % 4 == 1, F.concat(F.lit("Push fehlgeschlagen "), F.repeat("o_orderpriority", 60))).when(key % 4 == 2, "nichts").otherwise("")
    r = table(spark, sf_dir, "orders").select(key.alias("id"), t.alias("t"))
    told = F.lower("t").contains("gepusht") | F.col("t").contains("Push")
    return r.select("id", F.nullif(F.regexp_extract("t", r"Commit:\s*`([^`]+)`", 1), F.lit("")).alias("commit_id"), F.when(told, ~F.col("t").contains("Push fehlgeschlagen")).alias("pushed"), F.nullif(F.substring("t", 1, 300), F.lit("")).alias("short"))


_SAID = "CASE turn % 6 WHEN 0 THEN 'Todo: ' || text WHEN 1 THEN 'Bitte baue! ein Modul' WHEN 2 THEN ' ok, ' || text WHEN 3 THEN 'ja' WHEN 4 THEN 'der Server steht' ELSE text END"
_HAS_OBJECT = f"regexp_matches(t, '{'|'.join(rules.TASK_OBJECTS)}')"
_PREFIX = "(" + " OR ".join(f"starts_with(t, '{p}')" for p in rules.TASK_PREFIXES) + ")"


@query(rf"""WITH s AS (SELECT conv_id, turn, trim(coalesce({_SAID}, '')) AS m, lower(trim(coalesce({_SAID}, ''))) AS t FROM conversations)
SELECT conv_id, turn, {_PREFIX} OR ({_HAS_OBJECT} AND len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: regexp_replace(w, '[?!.]+\z', '') IN {_L(rules.TASK_VERBS)})) > 0) AS task,
{_PREFIX} OR {_HAS_OBJECT} AS faithful, length(m) >= 4 AND NOT regexp_matches(m, '{rules.TRIVIAL}') AS worth_keeping FROM s""")
def task_messages(spark, sf_dir):
    """Messages that ask for work, by the meant and by the literal rule, and those worth remembering."""
    text, turn = F.col("text"), F.col("turn") % 6
    said = F.when(turn == 0, F.concat(F.lit("Todo: "), text)).when(turn == 1, "Bitte baue! ein Modul").when(turn == 2, F.concat(F.lit(" ok, "), text)).when(turn == 3, "ja").when(turn == 4, "der Server steht").otherwise(text)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.is_task(said).alias("task"), rules.is_task(said, True).alias("faithful"), rules.worth_keeping(said).alias("worth_keeping"))


@query("""WITH l AS (SELECT l_orderkey AS pane, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS i,
 CASE l_suppkey % 5 WHEN 0 THEN '╭─ Hermes ─' WHEN 1 THEN '╰──' WHEN 2 THEN '💻 run $ step ' || l_partkey ELSE '│  text ' || l_partkey || ' ' END AS line FROM lineitem),
s AS (SELECT *, CASE WHEN contains(line, '╭') AND contains(line, 'Hermes') THEN 1 WHEN contains(line, '╰') THEN 0 END AS mark FROM l),
b AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY pane ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM s),
c AS (SELECT *, sum(CASE WHEN mark = 1 AND inside = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pane ORDER BY i ROWS UNBOUNDED PRECEDING) AS box FROM b),
x AS (SELECT pane, CAST(min(i) AS BIGINT) AS first_line, trim(string_agg(CASE WHEN coalesce(mark, 1) <> 0 AND trim(regexp_replace(line, '^│\\s*', '')) <> '' THEN rtrim(regexp_replace(line, '^│\\s*', '')) END, ' ' ORDER BY i)) AS text FROM c WHERE inside = 1 GROUP BY pane, box HAVING bool_or(mark = 0))
SELECT pane, first_line, 'box' AS kind, text FROM x WHERE text <> '' UNION ALL SELECT pane, i, 'tool', trim(regexp_extract(line, '💻.*?\\$\\s*(.*)', 1)) FROM c WHERE inside = 0 AND mark IS NULL AND regexp_matches(line, '💻.*?\\$\\s*(.*)')""")
def pane_boxes(spark, sf_dir):
    """Closed boxes of a terminal as one text each, and tool lines outside of boxes. A line is inside where the last
    mark above it opens a box; a second opening inside a box is text."""
    kind, part = F.col("l_suppkey") % 5, F.col("l_partkey").cast("string")
    line = F.when(kind == 0, "╭─ Hermes ─").when(kind == 1, "╰──").when(kind == 2, F.concat(F.lit("💻 run $ step "), part)).otherwise(F.concat(F.lit("│  text "), part, F.lit(" ")))
    order = Window.partitionBy("pane").orderBy("i")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("line").rlike("╭.*Hermes"), 1).when(F.col("line").contains("╰"), 0)
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pane"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")).cast("long").alias("i"), line.alias("line")).withColumn("mark", mark)
    c = l.withColumn("inside", F.coalesce(F.last("mark", True).over(above), F.lit(0))).withColumn("box", F.sum(F.when((F.col("mark") == 1) & (F.col("inside") == 0), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bare = F.rtrim(F.regexp_replace("line", r"^│\s*", ""))
    kept = F.when((F.coalesce("mark", F.lit(1)) != 0) & (F.trim(bare) != ""), F.struct("i", bare.alias("t")))
    boxes = c.where("inside = 1").groupBy("pane", "box").agg(F.min("i").alias("first_line"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), " ")).alias("text"), F.bool_or(F.col("mark") == 0).alias("closed"))
    tool = r"💻.*?\$\s*(.*)"
    tools = c.where((F.col("inside") == 0) & F.col("mark").isNull() & F.col("line").rlike(tool)).select("pane", F.col("i").alias("first_line"), F.lit("tool").alias("kind"), F.trim(F.regexp_extract("line", tool, 1)).alias("text"))
    return boxes.where("closed and text <> ''").select("pane", "first_line", F.lit("box").alias("kind"), "text").unionByName(tools)
