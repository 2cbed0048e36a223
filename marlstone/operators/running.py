"""Running figures and ranks along an order, without a group that one task must read.

A group's rows are cut into buckets that follow one another in its order. Each bucket is summed up, the sums run
over a group's buckets (a few rows), and windows run inside buckets; a running value is the one before the bucket
combined with the one inside it. A group of any size is as many tasks as it has buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Tables

_PLUS = (F.sum, lambda a, b: F.coalesce(a, b - b) + F.coalesce(b, a - a))
#: Kinds of running value: the aggregate of a bucket, and how two neighbours combine (either may be null).
KINDS = {
    "sum": _PLUS,
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))),
}


def running(rows: DataFrame, keys: list[str], bucket: str, order: list[Column | str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with running values: name: (kind, column), from a group's first row up to each row.

    ``bucket`` must rise with ``order`` inside a group, and ``order`` must leave no ties. ``rows`` are read twice,
    so hand over a written table where they are dear. Nulls among the keys are a group.
    """
    here = [*keys, bucket]
    sums = rows.groupBy(*here).agg(*(KINDS[kind][0](c).alias(f"_{n}") for n, (kind, c) in values.items()))
    passed = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    total = {"count": F.sum}
    before = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(here)), *(total.get(kind, KINDS[kind][0])(f"_{n}").over(passed).alias(f"_{n}") for n, (kind, _) in values.items()))
    met = rows.join(before, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(here))))
    inside = Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = {n: KINDS[kind][1](F.col(f"_{n}"), KINDS[kind][0](c).over(inside)).alias(n) for n, (kind, c) in values.items()}
    return met.select(*(F.col(c) for c in rows.columns), *found.values())


def in_order(rows: DataFrame, by: list[Column | str], bucket: str = "bucket", place: str = "place", keep: list[Column | str] | None = None, ranges: int | None = None) -> DataFrame:
    """``keep`` of rows range-sorted ``by``, with the range that each fell into and its place, which rises over all rows.

    Write the result before it is used: places are given while it is made. Rows of equal ``by`` are in one range.
    """
    ranged = rows.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    return ranged.select(*(keep or rows.columns), F.spark_partition_id().alias(bucket), F.monotonically_increasing_id().alias(place))


def places(rows: DataFrame, group: list[str], order: list[Column | str], name: str, tables: Tables, equal: list[str] | None = None) -> DataFrame:
    """``rows`` with each row's place (from 1) in its group under an order without ties; a group may be any size.

    With ``equal``, columns that ``order`` begins with, rows that agree in them share the place of the first.
    """
    kept = tables.save(in_order(rows, [*group, *order], "_range", "_in_order"), "placed")
    found = running(kept, group, "_range", ["_in_order"], {name: ("count", F.lit(1))}).withColumn(name, F.col(name).cast("int")).drop("_range", "_in_order")
    if not equal:
        return found
    same = [*group, *equal]
    first = found.groupBy(*same).agg(F.min(name).alias("_first")).select(*(F.col(c).alias(f"_e{i}") for i, c in enumerate(same)), "_first")
    met = found.join(first, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(same))))
    return met.withColumn(name, F.col("_first")).drop("_first", *(f"_e{i}" for i in range(len(same))))
