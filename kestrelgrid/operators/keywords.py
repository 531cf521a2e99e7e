"""Keyword extraction, merging across sources and document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written


def extract(docs: DataFrame, entity: str, doc: str) -> DataFrame:
    """(entity, kw, times, tf): weighted counts of words, identifiers and their parts."""
    pool = docs.select(F.col(entity).alias("entity"), F.explode(T.keyword_pool(F.col(doc))).alias("p")).select("entity", "p.kw", "p.times")
    counts = pool.groupBy("entity", "kw").agg(F.sum("times").alias("times"))
    return counts.withColumn("tf", F.col("times") / F.sum("times").over(Window.partitionBy("entity")))


def counted(rows: DataFrame, found: Column) -> DataFrame:
    """``rows`` with ``counts``: array<struct<kw, times, at>> of the words of an array, each once, with its first place; rows stay whole.

    Equal words are neighbours once sorted, so each is counted by where the next one begins.
    Use ``explode_outer``: a plain one adds a filter that makes the array anew for every element.
    """
    placed = F.sort_array(F.transform(found, lambda w, k: F.struct(w.alias("kw"), k.alias("at"))))
    at = lambda k: F.col("_placed")[k]
    first = lambda k: (k == 0) | (at(k)["kw"] != at(k - 1)["kw"])
    sorted_rows = rows.withColumn("_placed", placed)
    starts = F.when(F.size("_placed") > 0, F.filter(F.sequence(F.lit(0), F.size("_placed") - 1), first))
    begun = sorted_rows.withColumn("_starts", starts)
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_placed"))
    pairs = F.transform("_starts", lambda k, j: F.struct(at(k)["kw"].alias("kw"), (end(j) - k).cast("long").alias("times"), at(k)["at"].cast("long").alias("at")))
    return begun.withColumn("counts", pairs).drop("_placed", "_starts")


def words(docs: DataFrame, entity: str, doc: str) -> DataFrame:
    """(entity, kw, times, at): plain keywords with the position at which each is first seen."""
    one = docs.select(F.col(entity).alias("entity"), F.posexplode(T.keywords(F.col(doc))).alias("at", "kw"))
    return one.groupBy("entity", "kw").agg(F.count("*").alias("times"), F.min("at").cast("bigint").alias("at"))


def top(counts: DataFrame, n: int, *ties) -> DataFrame:
    """The n most frequent keywords of each entity; ties as given."""
    order = Window.partitionBy("entity").orderBy(F.col("times").desc(), *ties)
    return counts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def top_words(docs: DataFrame, entity: str, doc: str, n: int) -> DataFrame:
    """(entity, kw, times, at, rank): the n most frequent plain keywords of each entity, of equal ones the first seen.

    An entity of one row is counted and ranked inside that row, so its words are not
    shuffled. Which entities have several rows is found by their keys alone; the rows
    of those are grouped.
    """
    rows = docs.select(F.col(entity).alias("entity"), F.col(doc).alias("_text"))
    several = written(rows.groupBy("entity").count().where("count > 1").select(F.col("entity").alias("_several")))
    same = F.col("entity").eqNullSafe(F.col("_several"))
    ranked = counted(rows.join(several, same, "left_anti"), T.keywords(F.col("_text")))
    first = F.slice(F.sort_array(F.transform("counts", lambda c: F.struct((-c["times"]).alias("less"), c["at"].alias("at"), c["kw"].alias("kw")))), 1, n)
    one = ranked.select("entity", F.posexplode_outer(first).alias("rank", "c")).where("c is not null")
    one = one.select("entity", "c.kw", (-F.col("c.less")).alias("times"), "c.at", (F.col("rank") + 1).cast("bigint").alias("rank"))
    return one.unionByName(top(words(rows.join(several, same, "left_semi"), "entity", "_text"), n, "at"))


def merge_sources(weighted: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """weighted(entity, kw, source, weight) -> the greatest weight of each keyword and the sources it came from."""
    weight = F.col("weight")
    for source, factor in (boosts or {}).items():
        weight = F.when(F.col("source") == source, F.col("weight") * factor).otherwise(weight)
    return weighted.withColumn("weight", weight).groupBy("entity", "kw").agg(F.max("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def document_frequency(weighted: DataFrame) -> DataFrame:
    """(kw, df): documents that hold a keyword, each counted once."""
    return weighted.select("entity", "kw").distinct().groupBy("kw").agg(F.count("*").alias("df"))
