"""Positions and running sums in a global order, without a task that sees all rows.

Rows are dealt to ranges between quantiles of a number that leads the order;
each range is ordered by itself, and the sums of the ranges before it, one small
row a range, are added. Only the bounds and those rows reach the driver or are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _place(by: Column, bounds: list[float], first: int = 0) -> Column:
    """Number of bounds at or below ``by``, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(by < F.lit(bounds[mid]), _place(by, bounds[:mid], first)).otherwise(_place(by, bounds[mid + 1 :], first + mid + 1))


def dealt(rows: DataFrame, by: Column, ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``: ascending with ``by``, nulls first; ranges hold about equally many rows."""
    number = rows.select(by.cast("double").alias("by"))
    bounds = sorted(set(number.approxQuantile("by", [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    return rows.withColumn("_range", F.when(by.isNull(), F.lit(-1)).otherwise(_place(by.cast("double"), bounds)))


def before(rows: DataFrame, by: Column, order: list[Column], value: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before each one in ``order``, which ``by`` must lead (never falling along it)."""
    parts = dealt(rows, by, ranges)
    sums = parts.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # one row a range
    offsets = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(offsets), "_range")
    return out.withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset")


def numbered(rows: DataFrame, by: Column, order: list[Column], name: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: 1, 2, ... in ``order``, which ``by`` must lead."""
    out = before(rows, by, order, F.lit(1), name, ranges)
    return out.withColumn(name, (F.col(name) + 1).cast("long"))
