"""The usage log: appended JSON lines by day, read back, aged out."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LOG = "ts timestamp, tool_name string, repo_hash string, execution_time_ms double, input_tokens int, output_tokens int, success boolean, error string, response string"


def append(calls: DataFrame, path: str) -> None:
    calls.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def call(spark: SparkSession, path: str, tool_name: str, action: Callable[[], DataFrame], repo_hash: str | None = None, now: datetime | None = None) -> list[Row]:
    """The rows of a tool's DataFrame, which must bound itself (as the tools do by their limits); one line of the log says how it went.

    The time is that of building and running the plan. A tool that fails is logged
    with its error, which then goes on to the caller.
    """
    began, error, rows = time.perf_counter(), None, []
    try:
        rows = action().collect()
        return rows
    except Exception as e:
        error = str(e).split("\n", 1)[0]
        raise
    finally:
        took = (time.perf_counter() - began) * 1000
        response = None if error is not None else "\n".join(str(r) for r in rows)
        line = (now or datetime.now(), tool_name, repo_hash, took, None, None if response is None else len(response.split()), error is None, error, response)
        append(spark.createDataFrame([line], LOG), path)


def read(spark: SparkSession, path: str, since: date | None = None, repo_hash: str | None = None) -> DataFrame:
    """Calls by day and repository; lines that aren't JSON are skipped. The day prunes folders."""
    log = spark.read.schema(LOG + ", day date").option("mode", "DROPMALFORMED").json(path)
    if since is not None:
        log = log.where(F.col("day") >= F.lit(since))
    return log if repo_hash is None else log.where(F.col("repo_hash") == repo_hash)


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n calls in order of time."""
    return log.orderBy(F.col("ts").desc()).limit(n).orderBy("ts")


def older(log: DataFrame, today: date, days: int) -> DataFrame:
    """The days that a retention of ``days`` drops."""
    return log.where(F.col("day") < F.lit(today - timedelta(days=days))).select("day").distinct()
