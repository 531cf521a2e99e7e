"""Usage statistics over the tool log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_key


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def measures() -> list[Column]:
    calls = F.count("*")
    return [
        calls.alias("calls"),
        F.round(ratio(F.lit(100.0) * F.count_if("success"), calls), 6).alias("success_pct"),
        F.round(F.sum("execution_time_ms"), 6).alias("total_ms"),
        F.round(F.avg("execution_time_ms"), 6).alias("avg_ms"),
        F.sum("tokens").alias("tokens"),
    ]


def totals(log: DataFrame) -> DataFrame:
    return log.agg(*measures())


def by_tool(log: DataFrame) -> DataFrame:
    return log.groupBy("tool_name").agg(*measures())


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*measures())


def weekly(log: DataFrame) -> DataFrame:
    return log.groupBy(week_key(F.col("ts")).alias("week")).agg(*measures())


def per_tool_map(log: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, tools): ``tool=calls`` of each bucket, in order of the tool."""
    one = log.groupBy(bucket.alias("bucket"), "tool_name").agg(F.count("*").alias("n"))
    pair = F.concat("tool_name", F.lit("="), F.col("n").cast("string"))
    return one.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("tools"))


def span(log: DataFrame) -> DataFrame:
    """First and last call and the days between them, whole 24 hours, counting both ends."""
    days = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 86_400_000_000) + 1
    return log.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), days.cast("bigint").alias("days"))


def debounce(changes: DataFrame, quiet_seconds: float, key: list[str] | None = None) -> DataFrame:
    """Bursts: a change within the quiet period of the one before belongs to its burst; one row a burst."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(key or [])).orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    marked = changes.withColumn("_new", F.coalesce((gap >= int(quiet_seconds * 1e6)).cast("bigint"), F.lit(1)))
    marked = marked.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*(key or []), "burst").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("changes"))
