"""Scalar functions over the tables: dates, titles, names, labels, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import title_if_lower
from ..session import table
from .registry import query


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%d.%m.%Y') AS german_date, ['Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa', 'So'][isodow(o_orderdate)] AS weekday,
CAST(86400 - (epoch(o_orderdate)::BIGINT % 86400) AS BIGINT) AS to_midnight, o_orderdate >= TIMESTAMP '2000-01-01' AS upcoming,
coalesce(strftime(o_orderdate, '%Y-%m-%d'), '9999') BETWEEN '1996-01-01' AND '1997-06-30' AS in_range FROM orders""")
def date_functions(spark, sf_dir):
    """F24, F25, F26, P5, P6, X26."""
    d = F.col("o_orderdate")
    names = F.array(*map(F.lit, ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format(d, "dd.MM.yyyy").alias("german_date"), F.element_at(names, F.weekday(d) + 1).alias("weekday"),
        (F.lit(86400) - (F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d))).cast("long").alias("to_midnight"), (d >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("upcoming"),
        F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("9999")).between("1996-01-01", "1997-06-30").alias("in_range"),
    )


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'soon' END AS raw FROM orders)
SELECT id, raw, coalesce(nullif(regexp_extract(raw, '^\\d{4}-\\d{2}-\\d{2}'), ''), nullif(regexp_extract(raw, '^\\d{4}-\\d{2}'), '') || '-01', nullif(regexp_extract(raw, '^\\d{4}'), '') || '-01-01') AS day FROM s""")
def date_ladder(spark, sf_dir):
    """Day, month or year, whichever is given, as a date."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    raw = F.when(key % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(d, "yyyy-MM")).when(key % 4 == 2, F.date_format(d, "yyyy")).otherwise("soon")
    part = lambda p, end: F.concat(F.nullif(F.regexp_extract("raw", p, 0), F.lit("")), F.lit(end))
    s = table(spark, sf_dir, "orders").select(key.alias("id"), raw.alias("raw"))
    return s.withColumn("day", F.coalesce(part(r"^\d{4}-\d{2}-\d{2}", ""), part(r"^\d{4}-\d{2}", "-01"), part(r"^\d{4}", "-01-01")))


@query("""SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS slug, regexp_extract(p_name, '^([^—·,]+)', 1) AS head, CASE WHEN p_name = lower(p_name) THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE p_name END AS shown,
length(p_name) BETWEEN 2 AND 50 AND len(regexp_split_to_array(trim(p_name), '\\s+')) <= 5 AND regexp_matches(p_name, '\\p{L}') AND NOT regexp_matches(p_name, '[0-9]{4}') AS plausible,
regexp_matches(lower(p_name), '\\blive\\b') AS live FROM part""")
def name_functions(spark, sf_dir):
    """F31, F40, F43, P16, P26."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.substring_index("p_type", " ", 1).alias("slug"), F.regexp_extract("p_name", "^([^—·,]+)", 1).alias("head"),
        title_if_lower(F.col("p_name")).alias("shown"), rules.plausible_name(F.col("p_name")).alias("plausible"), F.lower("p_name").rlike(r"\blive\b").alias("live"),
    )


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN contains(line, '|') THEN 1 END) AS table_lines, CAST(sum(len(string_split(line, '|')) - 1) AS BIGINT) AS cells, max(length(regexp_replace(line, '^[\\s*\\-•0-9.)]+', ''))) AS longest FROM l GROUP BY doc_id""")
def line_functions(spark, sf_dir):
    """Lines, their bullets and their cells."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return l.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("line").contains("|")).alias("table_lines"), F.sum(F.size(F.split("line", r"\|")) - 1).cast("long").alias("cells"),
        F.max(F.length(F.regexp_replace("line", r"^[\s*\-•0-9.)]+", ""))).cast("long").alias("longest"),
    )


@query("""SELECT s_suppkey AS id, 'Support: ' || s_name AS text, [trim(x) for x in string_split('A, ' || s_name || ' ,B', ',')] AS parts, list_contains([lower(trim(x)) for x in string_split('Openai, ' || s_name, ',')], lower(s_name)) AS listed,
round(s_acctbal / 60.0::DOUBLE * 0.006::DOUBLE, 6) AS cost FROM supplier""")
def list_functions(spark, sf_dir):
    """Lists out of text, membership, cost."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("Support: "), "s_name").alias("text"), F.transform(F.split(F.concat(F.lit("A, "), "s_name", F.lit(" ,B")), ","), lambda x: F.trim(x)).alias("parts"),
        F.array_contains(F.transform(F.split(F.concat(F.lit("Openai, "), "s_name"), ","), lambda x: F.lower(F.trim(x))), F.lower("s_name")).alias("listed"), F.round(F.col("s_acctbal") / F.lit(60.0) * F.lit(0.006), 6).alias("cost"),
    )


@query("""SELECT page_id, substr(regexp_extract(html, '<h1>([^<]*)', 1), 1, 50) AS highlight, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
NOT regexp_matches(url, 'casino|spam|ads') AS allowed, coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), url) AS label FROM pages""")
def page_fields(spark, sf_dir):
    """First field that is not empty, a short highlight, a blacklist."""
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.substring(F.regexp_extract("html", "<h1>([^<]*)", 1), 1, 50).alias("highlight"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        (~F.col("url").rlike("casino|spam|ads")).alias("allowed"), F.coalesce(pick("<title>([^<]*)"), pick("<h1>([^<]*)"), F.col("url")).alias("label"),
    )
