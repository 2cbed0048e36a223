"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule over training time ``t`` in [0, 1]. Its integral is the source's
cumulative demand ``W(t) = target * ((1 - a) * t + a * t * t)`` (``a``: the ramp, from -1 falling to 1
rising). A source's documents stand in the order of a hash of their id; the position of a document is
the ``t`` at which ``W`` reaches the middle of its words, found by inverting ``W``. Documents of a source
that must give more words than it has come again in a second and third pass. Positions are range-sorted.

Nulls: a null text has size 0; texts of any length are counted where they are read; null sources are one source, ordered last. A document of size 0 comes at
most once. Repeated rows are documents of their own, and rows that are equal in all columns may stand for each
other. An empty table gives an empty result. A table
without any word has targets of 0. Columns of the input are kept unless named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, n_words

WEIGHTS = (5, 2, 1)
RAMPS = (-0.5, 0.0, 0.5)
MAX_PASSES = 3
#: Hash buckets that a source's documents are dealt into, so that no source is summed up in one task.
BUCKETS = 4096


def source_targets(sized: DataFrame, weights=WEIGHTS, ramps=RAMPS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source_size, target, ramp. ``sized`` has source and size.

    Targets share all words by weight and stop at ``max_passes`` times the source's size; what is over
    is shared again by weight. Sorted by size against weight, a source is at its cap exactly when the
    share that is left after the caps before it reaches its own.
    """
    cycle = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i % len(xs) + 1)
    every = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_i", (F.row_number().over(by_source) - 1).cast("int"))
    s = s.withColumns({
        "weight": cycle(weights, F.col("_i")).cast("long"),
        "ramp": cycle(ramps, F.col("_i")).cast("double"),
        "cap": (F.col("source_size") * max_passes).cast("long"),
    })
    s = s.withColumns({
        "_all": F.sum("source_size").over(every),
        "_before": F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("_capped", F.col("cap") * F.col("_rest") <= F.col("weight") * (F.col("_all") - F.col("_before")))
    s = s.withColumns({
        "_full": F.coalesce(F.sum(F.when(F.col("_capped"), F.col("cap"))).over(every), F.lit(0)),
        "_open": F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(every), F.lit(0)),
    })
    shared = (F.col("weight") * (F.col("_all") - F.col("_full"))).cast("double") / F.col("_open").cast("double")
    return s.select("source", "source_size", F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"), "ramp")


def _row_names(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row; rows of equal names are the same row repeated."""
    return [F.xxhash64(F.lit(k), *(docs[c] for c in docs.columns)).alias(f"_row{k}") for k in (1, 2)]


def _sized(docs: DataFrame, buckets: int) -> DataFrame:
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), h.alias("_h"), *_row_names(docs))
    return rows.withColumn("_b", F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") % buckets)


def plan_mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, ramps=RAMPS, max_passes: int = MAX_PASSES, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, bucket, place, source_size, target, ramp, middle (words of the source up to the document's middle), passes.

    ``bucket`` and ``place`` tell the rows of a source apart, equal ids too; ``_row1`` and ``_row2`` name the
    whole input row. All but the sizes runs over narrow written rows. Sums along a source go through hash
    buckets: totals per bucket, their running sum, and a window within each bucket.
    """
    sized = scratch.save(_sized(docs, buckets), "sized")
    targets = source_targets(sized, weights, ramps, max_passes)
    running = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sized.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .select(F.col("source").alias("_s"), F.col("_b").alias("_k"), "_start")
    )
    starts = starts.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    ordered = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", "_row1", "_row2")
    inside = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumns({"_upto": F.sum("size").over(inside), "place": F.row_number().over(ordered)})
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["_s"]) & (placed["_b"] == starts["_k"]))
    middle = (F.col("_start") + F.col("_upto")).cast("double") - F.col("size") / F.lit(2.0)
    fits = sum((F.when(middle + F.col("source_size") * i <= F.col("target"), 1).otherwise(0) for i in range(max_passes)), F.lit(0))
    return placed.select(
        "doc_id", "source", "size", F.col("_b").alias("bucket"), "place", "source_size", "target", "ramp", middle.alias("middle"),
        F.when(F.col("size") == 0, F.least(fits, F.lit(1))).otherwise(fits).cast("int").alias("passes"), "_row1", "_row2",
    )


def position(demand: Column, ramp: Column) -> Column:
    """The time at which ``(1 - a) t + a t^2`` reaches ``demand`` (a share of the target)."""
    b = F.lit(1.0) - ramp
    curve = (F.sqrt(b * b + F.lit(4.0) * ramp * demand) - b) / (F.lit(2.0) * ramp)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(ramp == 0, demand).otherwise(curve)))


def training_order(plan: DataFrame) -> DataFrame:
    """One row per occurrence of a document in training, range-sorted by ``position``."""
    rows = plan.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    reached = F.when(F.col("target") > 0, (F.col("middle") + F.col("pass") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    rows = rows.withColumn("position", position(reached, F.col("ramp"))).drop("source_size", "target", "ramp", "middle", "passes")
    return rows.orderBy("position", "source", "doc_id", "pass")


def taken(plan: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The digest of a mix: what it takes of every document and where it comes first (null: nowhere), from the training order's rows.

    With ``scratch`` the plan and the training order are written first; Spark would drop a sort under a sum.
    """
    if scratch is not None:
        plan = scratch.save(plan, "plan")
    order = training_order(plan)
    if scratch is not None:
        order = scratch.save(order, "order")
    row = ["doc_id", "source", "size", "bucket", "place"]
    none = plan.select(*row, "source_size", "target", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("double").alias("position"))
    some = order.select(*row, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), F.col("size").alias("_n"), "position")
    every = none.unionByName(some).groupBy(*row).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("_n").alias("taken"), F.min("position").alias("first_position")
    )
    return every.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def mixed_documents(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of ``docs``, each once per occurrence in the mix, in training order.

    Positions are worked out on narrow written rows. Whole rows move twice: to the occurrences of their name,
    where of a repeated row one is enough, and to their place in the order.
    """
    order = scratch.save(training_order(plan_mix(docs, scratch, **how)).select("_row1", "_row2", "position", "source", "doc_id", "pass"), "order")
    names = ["_row1", "_row2"]
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), *_row_names(docs))
    once = whole.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))).where("_nth = 1").drop("_nth")
    placed = order.join(once.hint("merge"), names)
    return placed.orderBy("position", "source", "doc_id", "pass", "_row1").select("_doc.*")
