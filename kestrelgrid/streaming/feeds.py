"""Structured Streaming: file changes, debounced refreshes, the usage log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import usage as U

# Fixed values, seconds: quiet period and time between refreshes.
QUIET, COOLDOWN = 2, 15


def changes(spark: SparkSession, path: str, schema: str, extensions: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """A folder of change records (ts, path, ...) as a stream, without excluded folders and other file types."""
    rows = spark.readStream.schema(schema).json(path)
    if extensions:
        rows = rows.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*extensions))
    if excluded:
        rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))
    return rows


def bursts(rows: DataFrame, key: str, quiet: int = QUIET, late: str = "10 minutes") -> DataFrame:
    """One row for each burst of changes of a key: a quiet period ends it. It appears once the watermark has passed it."""
    window = F.session_window("ts", f"{quiet} seconds")
    out = rows.withWatermark("ts", late).groupBy(window, key).agg(F.count("*").alias("changes"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(key, F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("closed_at"), "changes", "paths")


def burst_parts(batch: DataFrame, key: str, quiet: int = QUIET) -> DataFrame:
    """Bursts of one micro-batch: (key, first_ts, closed_at, changes, paths). One that goes on in another batch has a part in each."""
    out = batch.groupBy(F.session_window("ts", f"{quiet} seconds"), key).agg(F.count("*").alias("changes"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(key, F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("closed_at"), "changes", "paths")


def merged_bursts(parts: DataFrame, key: str) -> DataFrame:
    """Whole bursts from the parts of all batches, in whatever order their rows came; none is late and open ones count."""
    order = Window.partitionBy(key).orderBy("first_ts", "closed_at")
    before = F.max("closed_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("first_ts") >= before).cast("long"), F.lit(1))
    burst = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = parts.withColumn("_fresh", fresh).withColumn("_burst", burst).groupBy(key, "_burst")
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths")
    return rows.agg(F.min("first_ts").alias("first_ts"), F.max("closed_at").alias("closed_at"), F.sum("changes").alias("changes"), paths).drop("_burst")


def batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What the batches have left in ``folder``/batch=<number>; no rows if none has run."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


class ChangeLog:
    """State kept as one small table a micro-batch, the last row of each key counting.

    A batch costs its own rows, not the table's. Its folder is named by the batch
    number that the checkpoint keeps, so a batch that is run again replaces
    itself and a restart goes on where it was. ``compact`` folds what is there.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], place: list[str]):
        """place: columns that tell which of a batch's rows of a key is the last, then the batch counts."""
        self.spark, self.folder, self.schema, self.key, self.place = spark, folder.rstrip("/"), schema, key, place

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*self.key, "_row.*")

    def add(self, batch: DataFrame, number: int) -> None:
        self._last(batch, self.place).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def rows(self) -> DataFrame:
        """The last row of each key, over all batches."""
        every = batches(self.spark, self.folder, f"{self.schema}, batch long")
        return self._last(every, ["batch", *self.place]).drop("batch")

    def compact(self, into: str) -> ChangeLog:
        """A new log whose first batch holds the state; batches that follow go there."""
        self.rows().write.mode("overwrite").parquet(f"{into.rstrip('/')}/batch=-1")
        return ChangeLog(self.spark, into, self.schema, self.key, self.place)


def follow(rows: DataFrame, keep: Callable[[DataFrame, int], None], checkpoint: str, every: int | None = COOLDOWN):
    """Micro-batches with their numbers into ``keep``, one at a time; None: all that is there, then stop."""
    writer = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{every} seconds") if every is not None else writer.trigger(availableNow=True)).start()


def usage_parts(batch: DataFrame, width: str = "1 day") -> DataFrame:
    """Sums of one micro-batch by tool and tumbling window; a window that goes on in another batch has a part in each."""
    ok = F.count_if("success").alias("succeeded")
    out = batch.groupBy(F.window("ts", width), "tool_name").agg(F.count("*").alias("calls"), ok, F.sum("execution_time_ms").alias("total_ms"), F.count("execution_time_ms").alias("timed"), F.sum("tokens").alias("tokens"))
    return out.select(F.col("window.start").alias("day"), *[c for c in out.columns if c != "window"])


def merged_usage(parts: DataFrame) -> DataFrame:
    """Usage measures by tool and window from the parts of all batches: no row is late, and open windows count."""
    calls, total = F.sum("calls"), F.sum("total_ms")
    pct, mean = U.ratio(F.lit(100.0) * F.sum("succeeded"), calls), total / F.nullif(F.sum("timed"), F.lit(0))
    return parts.groupBy("day", "tool_name").agg(calls.alias("calls"), F.round(pct, 6).alias("success_pct"), F.round(total, 6).alias("total_ms"), F.round(mean, 6).alias("avg_ms"), F.sum("tokens").alias("tokens"))


def usage_windows(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Usage measures by tool and tumbling window, with bounded state: rows more than ``late`` behind the newest are dropped."""
    out = log.withWatermark("ts", late).groupBy(F.window("ts", width), "tool_name").agg(*U.measures())
    return out.select(F.col("window.start").alias("day"), "tool_name", *[c for c in out.columns if c not in ("window", "tool_name")])


def wanted(path: str):
    """Predicate for glob-filtered feeds."""
    return P.glob(F.col("path"), path)
