"""Keyword enrichment of an index in phases, each a table of its own.

A phase's table is named by what went into it, so an enrichment that was broken
off goes on with the next phase, and one whose input has changed since is made
anew. Phases are plans over whole tables: documents' words, string literals and
comments with their boosts, and the merge of all sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import keywords as K

BOOSTS = {"strings": T.STRING_BOOST, "comments": T.COMMENT_BOOST}


def _of(text: DataFrame, source: str) -> DataFrame:
    """(entity, kw, source, weight) of rows (entity, text): the count of each keyword by that of the most frequent one."""
    counts = K.extract(text, "entity", "text")
    most = counts.groupBy("entity").agg(F.max("times").alias("_most"))
    return counts.join(most, "entity").select("entity", "kw", F.lit(source).alias("source"), (F.col("times") / F.col("_most")).alias("weight"))


def _docs(tables: dict[str, DataFrame]) -> DataFrame:
    """Names and docs of entities(entity, name, doc); parts of the name count at least NAME_BOOST."""
    e = tables["entities"]
    words = _of(e.select("entity", F.concat_ws(" ", "name", "doc").alias("text")), "docs")
    parts = e.select("entity", F.explode(F.array_distinct(T.split_identifier(F.col("name")))).alias("kw"))
    named = parts.where(F.length("kw") > 2).select("entity", "kw", F.lit("docs").alias("source"), F.lit(T.NAME_BOOST).alias("weight"))
    return words.unionByName(named).groupBy("entity", "kw", "source").agg(F.max("weight").alias("weight"))


def _literals(kind: str) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Words of literals(entity, kind, text) of one kind."""
    return lambda tables: _of(tables["literals"].where(F.col("kind") == kind.rstrip("s")).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")), kind)


def _merged(tables: dict[str, DataFrame]) -> DataFrame:
    every = tables["docs"].unionByName(tables["strings"]).unionByName(tables["comments"])
    return K.merge_sources(every, BOOSTS)


#: Name, plan and input tables of each phase.
PHASES: tuple[tuple[str, Callable[[dict[str, DataFrame]], DataFrame], tuple[str, ...]], ...] = (
    ("docs", _docs, ("entities",)),
    ("strings", _literals("strings"), ("literals",)),
    ("comments", _literals("comments"), ("literals",)),
    ("entity_keywords", _merged, ("entities", "literals")),
)


def _stamp(table: DataFrame) -> str:
    """A hash of the rows in whatever order, repeats counted: one aggregate over the table."""
    row = F.xxhash64(*[F.col(c) for c in sorted(table.columns)])
    n, both, all_ = table.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0))).first()
    return f"{n}:{both}:{all_}"


def enrich(spark: SparkSession, tables: dict[str, DataFrame], folder: str, until: str | None = None) -> dict[str, DataFrame]:
    """The tables and those of all phases up to ``until``; ends of phases are the writer's own success marks."""
    out = dict(tables)
    stamps = {name: _stamp(tables[name]) for name in ("entities", "literals")}
    for name, build, inputs in PHASES:
        at = f"{folder}/{name}-{hashlib.sha256(repr([stamps[i] for i in inputs]).encode()).hexdigest()[:16]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            build(out).write.mode("overwrite").parquet(at)
        out[name] = spark.read.parquet(at)
        if name == until:
            break
    return out
