"""Streaming operators run to completion over the tables (availableNow); compared with batch in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import feeds
from .registry import query


def _stream(t, name: str) -> DataFrame:
    """A table as a stream; the path is a glob, so that it may name one file or a folder."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


_LOG_MEASURES = "count(*) as calls, round(coalesce(100.0::double * count(*) filter (success) / nullif(count(*), 0), 0), 6) as success_pct, round(sum(execution_time_ms), 6) as total_ms, round(avg(execution_time_ms), 6) as avg_ms, sum(tokens)::bigint as tokens"


@query("T7 T3", f"select date_trunc('day', ts)::timestamp as day, tool_name, {_LOG_MEASURES} from tool_log group by all", "tool_log")
def stream_tool_log(t):
    """Daily measures by tool from the events as a stream: sums of each micro-batch, put together over all of them, so no row comes too late."""
    folder = shared_folder(t.spark)
    log = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool_name"), F.col("value").alias("execution_time_ms"), (F.col("event_type") != "error").alias("success"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    # named by the batch number of the checkpoint, so a batch that is run again replaces itself
    keep = lambda batch, number: feeds.usage_parts(batch).write.mode("overwrite").parquet(f"{folder}/windows/batch={number}")
    feeds.follow(log, keep, f"{folder}/checkpoint", every=None).awaitTermination()
    parts = feeds.batches(t.spark, f"{folder}/windows", "day timestamp, tool_name string, calls long, succeeded long, total_ms double, timed long, tokens long, batch long")
    return feeds.merged_usage(parts).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("T1 T4 T5 R13", "select doc_id as path, md5(text) as md5 from documents")
def stream_incremental(t):
    """File states kept up by an idempotent upsert in each micro-batch."""
    folder = shared_folder(t.spark)
    rows = _stream(t, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("md5"))
    state = feeds.ChangeLog(t.spark, f"{folder}/files", "path bigint, md5 string", ["path"], ["md5"])
    feeds.follow(rows, state.add, f"{folder}/checkpoint", every=None).awaitTermination()
    return state.rows()


@query("T2", """
with m as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 1800000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
b as (select *, sum(fresh) over (partition by user_id order by ts) as burst from m)
select user_id, min(ts) as first_ts, max(ts) + interval 30 minute as closed_at, count(*) as changes, string_agg(distinct event_type, ',' order by event_type) as paths from b group by user_id, burst""")
def stream_debounce(t):
    """Bursts of each user's events: what each micro-batch saw of them, put together; those still open at the end count."""
    folder = shared_folder(t.spark)
    rows = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), "user_id")

    def keep(batch: DataFrame, number: int) -> None:
        feeds.burst_parts(batch, "user_id", quiet=1800).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    feeds.follow(rows, keep, f"{folder}/checkpoint", every=None).awaitTermination()
    parts = feeds.batches(t.spark, f"{folder}/parts", "user_id bigint, first_ts timestamp, closed_at timestamp, changes bigint, paths array<string>")
    out = feeds.merged_bursts(parts, "user_id").withColumn("paths", F.array_join("paths", ","))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "closed_at")})
