"""Events in JSON inside pages, parts of pages, and names that can be names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..session import table
from ..sources import page_json, selectors
from .registry import query

_DATE = "strftime(l_shipdate, '%Y-%m-%d')"


def _event_pages(spark, sf_dir):
    """A page per order, its lines as events of four shapes, in lists at five places; every sixth page is broken."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("t"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.concat(F.lit("hall "), F.col("l_suppkey").cast("string")).alias("v"))
    kind, js = (F.col("l_linenumber") + F.col("l_suppkey")) % 5, F.to_json
    entry = (
        F.when(kind == 0, js(F.struct(F.col("t").alias("name"), F.concat("d", F.lit("T20:00")).alias("startDate"), F.struct(F.col("v").alias("name"), F.lit("Hamburg").alias("city")).alias("place"))))
        .when(kind == 1, js(F.struct(F.col("t").alias("headline"), F.concat(F.lit("on "), "d").alias("eventDate"), F.col("v").alias("venue"))))
        .when(kind == 2, js(F.struct(F.lit("").alias("name"), F.col("t").alias("title"), F.col("d").alias("minStartDate"), F.struct(F.struct(F.col("v").alias("city")).alias("address")).alias("location"))))
        .when(kind == 3, js(F.struct(F.lit("").alias("displayName"), F.col("d").alias("date")))).otherwise(F.concat(F.lit('"'), "t", F.lit('"')))
    )
    lists = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "t", "d", entry.alias("e")))), lambda x: x["e"]), ",").alias("list"))  # of one order
    body, shape = F.concat(F.lit("["), "list", F.lit("]")), F.col("l_orderkey") % 6
    props = (
        F.when(shape == 0, F.concat(F.lit('{"searchResult":{"productGroups":'), body, F.lit("}}"))).when(shape == 1, F.concat(F.lit('{"initialData":{"productGroups":'), body, F.lit("}}")))
        .when(shape == 2, F.concat(F.lit('{"searchResult":{"productGroups":[]},"productGroups":'), body, F.lit("}"))).when(shape == 3, F.concat(F.lit('{"events":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"items":'), body, F.lit("}")))
    )
    data = F.concat(F.lit('{"props":{"pageProps":'), props, F.when(shape == 5, "}").otherwise("}}"))
    return lists.select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>")).alias("html"))


@query(f"""WITH l AS (SELECT *, (l_linenumber + l_suppkey) % 5 AS kind, l_orderkey % 6 AS shape, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, 'part ' || l_partkey::VARCHAR, l_shipdate) - 1 AS INTEGER) AS n FROM lineitem)
SELECT l_orderkey AS page_id, NULL AS problem, n, 'part ' || l_partkey::VARCHAR AS artist, {_DATE} AS day, 'hall ' || l_suppkey::VARCHAR AS venue, CASE kind WHEN 0 THEN 'Hamburg' WHEN 2 THEN 'hall ' || l_suppkey::VARCHAR END AS city FROM l WHERE kind < 3 AND shape < 4
UNION ALL SELECT DISTINCT l_orderkey, CASE shape WHEN 4 THEN 'no list' ELSE 'malformed' END, NULL::INTEGER, NULL, NULL, NULL, NULL FROM l WHERE shape >= 4""")
def embedded_events(spark, sf_dir):
    """Events read from data scripts of pages that are made from orders and their lines."""
    return page_json.embedded_events(_event_pages(spark, sf_dir)).drop("url")


_A = """<a href="([^"]*)">"""


@query(f"""SELECT page_id, len(regexp_extract_all(html, '{_A}'))::BIGINT AS n_links, nullif(regexp_extract(html, '{_A}', 1), '') AS first_link, len(regexp_extract_all(html, '<div class="ad">'))::BIGINT AS n_ads,
len(regexp_extract_all(html, '<h1>'))::BIGINT AS n_heads FROM pages""")
def page_parts(spark, sf_dir):
    """What selectors find in the pages: links of the navigation, advertisements, heads of articles."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    m = selectors.select(pages, {"link": "nav li a[href]", "ad": "body div.ad", "head": "article h1"})
    of = lambda s: F.count_if(F.col("selector") == s)
    found = m.groupBy("page_id").agg(of("link").alias("n_links"), F.min_by(F.when(F.col("selector") == "link", F.col("attributes")["href"]), F.when(F.col("selector") == "link", F.col("ord"))).alias("first_link"), of("ad").alias("n_ads"), of("head").alias("n_heads"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", zero("n_links"), "first_link", zero("n_ads"), zero("n_heads"))


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(coalesce(text, ''), '[\\n.,]'))) AS name FROM documents)
SELECT doc_id, count(*) AS n, count(CASE WHEN {names.GENERAL.sql("name")} THEN 1 END) AS general, count(CASE WHEN {names.PARK.sql("name")} THEN 1 END) AS park FROM l GROUP BY doc_id""")
def plausible_names(spark, sf_dir):
    """How many parts of a text can be names of acts, by the general rule and by a festival's."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\n.,]")).alias("name")).withColumn("name", F.trim("name"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(names.GENERAL.holds(F.col("name"))).alias("general"), F.count_if(names.PARK.holds(F.col("name"))).alias("park"))
