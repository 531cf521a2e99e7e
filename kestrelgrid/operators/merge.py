"""Incremental maintenance: diffs of content hashes, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "path", content: str = "md5") -> DataFrame:
    """(key, status): new, modified, deleted or unchanged."""
    a, b = old.select(key, F.col(content).alias("_old")), new.select(key, F.col(content).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def merge(parts: list[DataFrame], key: list[str], last_wins: bool = True) -> DataFrame:
    """Union in which the last (or first) part that holds a key gives its row."""
    rows = None
    for k, df in enumerate(parts):
        df = df.withColumn("_part", F.lit(k if last_wins else -k))
        rows = df if rows is None else rows.unionByName(df)
    order = Window.partitionBy(*key).orderBy(F.col("_part").desc())
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_part")


def upsert(table: DataFrame, fresh: DataFrame, key: list[str], gone: DataFrame | None = None) -> DataFrame:
    """Rows of deleted keys and replaced rows go, fresh ones come in. A second run with the same rows changes nothing."""
    kept = table.join(gone.select(*key).distinct(), key, "left_anti") if gone is not None else table
    return kept.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def replace_files(table: DataFrame, fresh: DataFrame, changed: DataFrame, file: str) -> DataFrame:
    """All rows of changed or deleted files go, so a module that a file lost goes too."""
    return table.join(changed.select(file).distinct(), file, "left_anti").unionByName(fresh)


def reuse(fresh: DataFrame, old: DataFrame, key: list[str], columns: list[str], unchanged: Column) -> DataFrame:
    """Enrichment columns taken from the old table where the row's file is unchanged and the fresh value is missing."""
    kept = old.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = fresh.join(kept, key, "left")
    return out.withColumns({c: F.coalesce(c, F.when(unchanged, F.col(f"_{c}"))) for c in columns}).drop(*[f"_{c}" for c in columns])


def outside(prs: DataFrame, index: DataFrame, number: str = "number") -> DataFrame:
    """Rows newer than the newest or older than the oldest of the index; all if it is empty."""
    ends = index.agg(F.max(number).alias("_high"), F.min(number).alias("_low"))
    return prs.crossJoin(F.broadcast(ends)).where(F.col("_high").isNull() | (F.col(number) > F.col("_high")) | (F.col(number) < F.col("_low"))).drop("_high", "_low")


def may_save(fetched: DataFrame, index: DataFrame, complete: bool, number: str = "number") -> DataFrame:
    """What of a fetch may be merged into the index without a hole in it.

    A complete fetch may as a whole. Of one that broke off, rows below the newest
    of the index may: a later run goes on below them. Newer ones may not, as the
    next run would start above them and never meet what is missing in between.
    """
    if complete:
        return fetched
    ends = index.agg(F.max(number).alias("_high"))
    return fetched.crossJoin(F.broadcast(ends)).where(F.col(number) <= F.col("_high")).drop("_high")
