"""As-of, interval and band joins without range joins over whole tables.

An as-of join is a union of both sides and one window: rows of a key are sorted
once and the last seen definition is carried along. Cost is a sort, whatever the
number of matches, and keys spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import passes


def asof(left: DataFrame, right: DataFrame, key: list[str], on: str, carry: list[str], forward: bool = False) -> DataFrame:
    """left with ``carry`` of the nearest right row at or before ``on`` (at or after: ``forward``); unmatched rows get nulls.

    Of right rows at one place the first in order of ``carry`` counts.
    """
    first = Window.partitionBy(*key, on).orderBy(*carry)
    right = right.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    row = F.struct(*[F.col(c) for c in carry])
    a = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_left"), *[F.col(k) for k in key], F.col(on).alias("_on"), F.lit(None).cast(right.select(row.alias("r")).schema[0].dataType).alias("_right"))
    b = right.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *[F.col(k) for k in key], F.col(on).alias("_on"), row.alias("_right"))
    # at one place the definition comes before the rows that look for it
    place = [F.col("_on").desc() if forward else F.col("_on").asc(), F.col("_right").isNull()]
    order = Window.partitionBy(*key).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(order))
    return both.where("_left is not null").select("_left.*", *[F.col("_right")[c].alias(c) for c in carry])


def ends(starts: DataFrame, key: list[str], line: str, tail: int, *ties: str) -> DataFrame:
    """Adds ``end_line``: the line before the next start; ``tail`` lines on for the last one."""
    order = Window.partitionBy(*key).orderBy(line, *ties)
    return starts.withColumn("end_line", F.coalesce(F.lead(line).over(order) - 1, F.col(line) + tail))


def enclosing(points: DataFrame, ranges: DataFrame, key: list[str], at: str) -> DataFrame:
    """The smallest range(start, stop, symbol) of the same key around each point; unmatched points are left out.

    One sorted pass over ranges and points of a key, see ``passes.smallest_around``:
    neither is copied, however long a range is or however many overlap.
    """
    return passes.smallest_around(points, ranges, key, at)


def band(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, reach: int) -> DataFrame:
    """Pairs of one key whose places are at most ``reach`` apart, by an equi-join on blocks of that width."""
    block = F.floor(F.col(left_at) / (reach + 1))
    a = left.withColumn("_block", F.explode(F.array(block - 1, block, block + 1)))
    b = right.withColumn("_block", F.floor(F.col(right_at) / (reach + 1)))
    return a.join(b, [*key, "_block"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_block")


def islands(rows: DataFrame, key: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adds ``island``: runs of rows, in order within the key, whose ``same`` columns don't change."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_new", (change | first).cast("bigint")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def adjacent(rows: DataFrame, key: list[str], line: str, last: str | None = None) -> DataFrame:
    """Adds ``island``: runs of lines that follow each other without a gap (``last``: a row's own end line)."""
    w = Window.partitionBy(*key).orderBy(line)
    gap = F.coalesce(F.col(line) - F.lag(last or line).over(w) != 1, F.lit(True))
    return rows.withColumn("_new", gap.cast("bigint")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def context(lines: DataFrame, key: list[str], line: str, text: str, before: int, after: int) -> DataFrame:
    """Adds ``context``: the texts of the lines around each line."""
    w = Window.partitionBy(*key).orderBy(line).rowsBetween(-before, after)
    return lines.withColumn("context", F.collect_list(text).over(w))
