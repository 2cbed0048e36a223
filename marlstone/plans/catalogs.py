"""Catalog enrichment: prices, tiers, provider policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.running import places
from ..scratch import Tables
from ..session import table
from .registry import query

_PRICE = "CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE round(p_retailprice / 1000.0::DOUBLE, 3) END"


@query(f"""SELECT p_partkey AS id, {_PRICE} AS price, CASE WHEN {_PRICE} IS NULL THEN NULL WHEN {_PRICE} <= 0.15 THEN 'low' WHEN {_PRICE} <= 0.60 THEN 'medium' WHEN {_PRICE} <= 1.50 THEN 'high' ELSE 'top' END AS tier,
CAST(rank() OVER (PARTITION BY p_brand ORDER BY ({_PRICE}) ASC NULLS LAST) AS INTEGER) AS place FROM part""")
def price_tier_catalog(spark, sf_dir):
    """Price with a sentinel as null, tier, and rank with nulls last, by ranges of a brand's prices."""
    price = F.when(F.col("p_partkey") % 50 != 0, F.round(F.col("p_retailprice") / F.lit(1000.0), 3))
    tier = F.when(F.col("price").isNull(), None).when(F.col("price") <= 0.15, "low").when(F.col("price") <= 0.60, "medium").when(F.col("price") <= 1.50, "high").otherwise("top")
    p = table(spark, sf_dir, "part").withColumn("price", price).withColumn("tier", tier)
    rows = p.select(F.col("p_partkey").alias("id"), "p_brand", "price", "tier")
    return places(rows, ["p_brand"], [F.asc_nulls_last("price"), "id"], "place", Tables(spark, "tiers"), ["price"]).select("id", "price", "tier", "place")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS model, l_suppkey AS provider FROM lineitem),
j AS (SELECT model, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_acctbal > 5000 END AS retains FROM e JOIN supplier ON s_suppkey = provider)
SELECT p_partkey AS model, count(j.model) AS providers, count(CASE WHEN retains THEN 1 END) AS retaining, count(CASE WHEN j.model IS NOT NULL AND retains IS NULL THEN 1 END) AS unknown,
CASE WHEN count(j.model) = 0 THEN NULL ELSE count(CASE WHEN retains THEN 1 END) = 0 AND count(CASE WHEN j.model IS NOT NULL AND retains IS NULL THEN 1 END) = 0 END AS retention_free FROM part LEFT JOIN j ON j.model = p_partkey GROUP BY p_partkey""")
def policy_verdict(spark, sf_dir):
    """Provider policies per model, and a verdict that may be unknown."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("model"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") >= 5, F.col("s_acctbal") > 5000).alias("retains"), F.lit(True).alias("there"))
    j = e.join(s, "s_suppkey")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model")).join(j, "model", "left")
    g = p.groupBy("model").agg(F.count("there").alias("providers"), F.count_if("retains").alias("retaining"), F.count_if(F.col("there") & F.col("retains").isNull()).alias("unknown"))
    return g.withColumn("retention_free", F.when(F.col("providers") > 0, (F.col("retaining") == 0) & (F.col("unknown") == 0)))


@query("SELECT r_name AS region, count(*) AS n, count(CASE WHEN s_acctbal > 0 THEN 1 END) AS eu, count(CASE WHEN s_acctbal <= 0 THEN 1 END) AS other FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def catalog_counts(spark, sf_dir):
    """Flag totals by membership."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("eu"), F.count_if(F.col("s_acctbal") <= 0).alias("other"))


@query("""SELECT p_partkey AS id, coalesce(nullif(trim(t.c_name), ''), p_name) AS label, t.c_name IS NOT NULL AS translated FROM part LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) t ON c_custkey = p_partkey
WHERE NOT starts_with(p_name, '~') AND NOT contains(p_name, ':free')""")
def localised_catalog(spark, sf_dir):
    """Translated text else the original; helper entries left out."""
    t = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("p_partkey"), "c_name")
    p = table(spark, sf_dir, "part").where(~F.col("p_name").startswith("~") & ~F.col("p_name").contains(":free")).join(t, "p_partkey", "left")
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(F.nullif(F.trim("c_name"), F.lit("")), F.col("p_name")).alias("label"), F.col("c_name").isNotNull().alias("translated"))
