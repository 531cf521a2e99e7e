"""Keyword, wildcard, pattern and hybrid search as joins with a small relation of query terms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S


def term_groups(query: Sequence[str | Sequence[str]]) -> list[tuple[str, int, int]]:
    """(term, group, position): a nested list or ``a|b`` is one group of synonyms."""
    out, position = [], 0
    for group, item in enumerate(query):
        for term in ([t for x in item for t in P.split_or(x)] if not isinstance(item, str) else P.split_or(item)):
            out.append((term.lower(), group, position))
            position += 1
    return out


def terms(spark: SparkSession, query: Sequence[str | Sequence[str]]) -> DataFrame:
    """The query as a relation; the nth repeat of a term counts 0.5^(n-1)."""
    rows, seen = [], {}
    for term, group, position in term_groups(query):
        seen[term] = seen.get(term, -1) + 1
        rows.append((term, group, position, S.REPEAT_DECAY ** seen[term]))
    return spark.createDataFrame(rows, "term string, grp int, pos int, decay double")


def exact(weighted: DataFrame, query: DataFrame, groups: int) -> DataFrame:
    """Scores of weighted(entity, kw, weight, zipf): sum of weight * zipf * decay, times the coverage bonus.

    The query is a handful of literal rows, so it is broadcast and filters the
    keywords before anything shuffles.
    """
    hits = weighted.join(F.broadcast(query), weighted["kw"] == query["term"])
    scored = hits.groupBy("entity").agg(F.sum(F.col("weight") * F.col("zipf") * F.col("decay")).alias("raw"), F.countDistinct("grp").alias("matched"))
    return scored.withColumn("score", F.col("raw") * S.coverage(F.col("matched"), groups))


def any_pattern(query: Sequence[str]) -> Column:
    """Predicate on ``kw`` for the patterns of a query."""
    return reduce(or_, [P.wildcard(F.col("kw"), term) for term, _, _ in term_groups(query)], F.lit(False))


def wildcard(hits: DataFrame, query: Sequence[str], groups: int | None = None) -> DataFrame:
    """As ``exact`` for patterns: the best keyword of each pattern counts. One ``*`` makes all terms patterns.

    ``hits``: rows (entity, kw, weight, zipf) of the keywords that match ``any_pattern``.
    """
    pairs = term_groups(query)
    matches = F.array(*[F.when(P.wildcard(F.col("kw"), term), F.struct(F.lit(position).alias("pos"), F.lit(group).alias("grp"))) for term, group, position in pairs])
    best = hits.select("entity", F.explode(F.filter(matches, lambda m: m.isNotNull())).alias("m"), (F.col("weight") * F.col("zipf")).alias("w")).groupBy("entity", "m.pos", "m.grp").agg(F.max("w").alias("w"))
    scored = best.groupBy("entity").agg(F.sum("w").alias("raw"), F.countDistinct("grp").alias("matched"))
    return scored.withColumn("score", F.col("raw") * S.coverage(F.col("matched"), groups or len({g for _, g, _ in pairs})))


def name_hits(entities: DataFrame, simple: Column, query: DataFrame, keywords: DataFrame) -> DataFrame:
    """(entity, bonus): a term that is an entity's own name and none of its keywords counts 3."""
    named = entities.select("entity", simple.alias("simple")).join(F.broadcast(query), F.col("simple") == F.col("term"))
    fresh = named.join(keywords.select("entity", F.col("kw").alias("term")), ["entity", "term"], "left_anti")
    return fresh.groupBy("entity").agg(F.sum(F.lit(S.EXACT_NAME) * F.col("decay")).alias("bonus"))


def module_boost(scored: DataFrame, modules: Column, patterns: Sequence[str]) -> DataFrame:
    """Adds 2 to the score of entities whose module matches one of the patterns, even from zero."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | P.qualified(modules, p)
    return scored.withColumn("score", F.coalesce("score", F.lit(0.0)) + F.when(hit, S.MODULE_BOOST).otherwise(0.0))


def cochange_factor(modules_sum: Column | None = None, function_sum: Column | None = None, file_sum: Column | None = None) -> Column:
    """1 + count * 0.5 * (0.01 module, 0.02 function, 0.005 file)."""
    out = F.lit(1.0)
    for total, kind in ((modules_sum, "module"), (function_sum, "function"), (file_sum, "file")):
        if total is not None:
            out = out + F.coalesce(total, F.lit(0)) * (S.COCHANGE["weight"] * S.COCHANGE[kind])
    return out


def best_per_name(results: DataFrame, name: str, score: str, ordinal: str) -> DataFrame:
    """The best score of each name, the earliest on ties."""
    order = Window.partitionBy(name).orderBy(F.col(score).desc(), ordinal)
    return results.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def ranked(results: DataFrame, score: str, name: str, limit: int, offset: int = 0) -> DataFrame:
    return results.orderBy(F.col(score).desc(), name).offset(offset).limit(limit)


def hybrid(keyword: DataFrame, semantic: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer merge of two percentile rankings; hits of both gain half, at most 100."""
    a = keyword.withColumnRenamed("pct", "kw_pct")
    b = semantic.withColumnRenamed("pct", "sem_pct")
    both = F.least(F.greatest("kw_pct", "sem_pct") * S.HYBRID_BOOST, F.lit(S.HYBRID_CAP))
    found = F.when(F.col("kw_pct").isNotNull() & F.col("sem_pct").isNotNull(), "both").when(F.col("kw_pct").isNotNull(), "keyword").otherwise("semantic")
    out = a.join(b, list(key), "full_outer")
    return out.withColumn("confidence", F.when(found == "both", both).otherwise(F.coalesce("kw_pct", "sem_pct"))).withColumn("found_by", found)


def first_of(rows: DataFrame, tests: Sequence[tuple[str, Column]], few: bool = False) -> DataFrame:
    """Fallbacks that are filters of the same rows: of the tests (note, predicate) the first that any row passes decides.

    Rows are made once with the numbers of the tests that they pass. ``few``: a
    limit bounds them, so one window finds the first test; else an aggregate does.
    """
    passed = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, (_, test) in enumerate(tests)]))
    tagged = rows.withColumn("_passed", passed).where(F.size("_passed") > 0)
    least = F.min(F.array_min("_passed"))
    if few:
        tagged = tagged.withColumn("stage", least.over(Window.partitionBy()))
    else:
        tagged = tagged.join(F.broadcast(tagged.agg(least.alias("stage"))))
    note = F.array(*[F.lit(n) for n, _ in tests])[F.col("stage")]
    return tagged.where(F.array_contains("_passed", F.col("stage"))).drop("_passed").withColumn("note", note)


def staged(candidates: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Fallbacks in one job: all stages in one relation, and only the first that has rows stays."""
    rows = None
    for k, (name, df) in enumerate(candidates):
        part = df.withColumn("stage", F.lit(k)).withColumn("note", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.agg(F.min("stage").alias("stage"))
    return rows.join(F.broadcast(first), "stage")
