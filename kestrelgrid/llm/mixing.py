"""Mixing sources to target weights by capped water-filling.

A source's target is ``min(cap, level * weight)``, where cap is its size times
the most epochs; the level is the one at which the targets add up to the words
asked for. It is found by clamping sources in the order in which the rising
level meets their caps (cap / weight), which is what clamping and resharing
round by round ends at.

A target of e epochs takes every document floor(e) times, and once more the
documents that come first in a seeded order, as long as their sizes fit in the
rest; the next one in order is taken in part, so that a source's words add up to
its target (``mix``, which gives whole documents, takes it if half of it or more
fits). The order is by a hash of seed and doc_id, so reruns agree. The cut is
found without sorting a source in one task: sums over 65,536 hash bins find the
bin where the rest runs out, and only that bin's rows are ordered.

Defined cases: a null text has size 0; null sources are one source, last in
order; sources of size 0 get target 0; an empty table gives an empty result;
rows of one doc_id and size share a place in the order and a cut there evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import attach, fields_of, quoted, written

BINS = 1 << 16


def words_in(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """Adds weight and target to sizes(skey, source, source_size, n).

    The windows here run over one row for each source.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    filled = ranked.withColumns({
        "asked": F.sum("source_size").over(every) * F.lit(float(share)),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(after),
    })
    # the level if all sources from this one on are open; the first source it doesn't fill sets the level
    level = (F.col("asked") - F.col("full")) / F.col("open_weight")
    filled = filled.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("k"), F.col("level")))).over(every)
    filled = filled.withColumn("final", final.getField("level"))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return filled.select("skey", "source", "n", "source_size", "weight", target.alias("target"))


def _rows(docs: DataFrame, seed: int, id_column: str, text_column: str, source_column: str, *more) -> DataFrame:
    """The columns that decide about a row; a row's place in the order depends on seed and doc_id (null: on its text)."""
    text, own = quoted(text_column).cast("string"), quoted(id_column).cast("string")
    name = F.coalesce(own, F.md5(F.coalesce(text, F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 15), 16, 10).cast("long")
    source = quoted(source_column).cast("string")
    rows = docs.select(own.cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("skey"), words_in(text).alias("size"), draw.alias("draw"), *more)
    return rows.withColumn("bin", F.expr(f"draw div {(1 << 60) // BINS}L")).withColumn("place", F.struct("draw", F.col("doc_id").isNull().alias("z"), "doc_id", "size"))


def _limits(rows: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """One row per source: target, whole repetitions, and the last place that is taken once more."""
    bins = written(rows.groupBy("skey", "bin").agg(F.max("source").alias("source"), F.sum("size").alias("bin_size"), F.count("*").alias("n")))
    per_source = bins.groupBy("skey").agg(F.max("source").alias("source"), F.sum("bin_size").alias("source_size"), F.sum("n").alias("n"))
    want = targets(per_source, weights, share, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    want = want.withColumn("whole", F.floor(rate + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    want = written(want)
    upto = Window.partitionBy("skey").orderBy("bin")
    run = bins.withColumn("upto", F.sum("bin_size").over(upto)).join(want.select("skey", "rest"), "skey")
    cut = written(run.where("upto > rest").groupBy("skey").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("below"), "rest"), "bin").alias("c")).select("skey", F.col("c.bin").alias("bin"), "c.below", "c.rest"))
    # only the rows of the bin in which the rest runs out are ordered
    edge = rows.join(cut, ["skey", "bin"]).groupBy("skey", "place", "below", "rest").agg(F.sum("size").alias("here"), F.count("*").alias("rows"))
    edge = edge.withColumn("before", F.col("below") + F.sum("here").over(Window.partitionBy("skey").orderBy("place")) - F.col("here"))
    fits = F.col("before") + F.col("here") <= F.col("rest")
    ends = edge.groupBy("skey").agg(F.max(F.when(fits, F.col("place"))).alias("last"), F.min(F.when(~fits, F.struct("place", F.floor((F.col("rest") - F.col("before")) / F.col("rows")).alias("words")))).alias("part"))
    return written(want.join(cut.select("skey", F.col("bin").alias("cut_bin")), "skey", "left").join(ends, "skey", "left"))


def _times(rows: DataFrame, limits: DataFrame, total: int) -> DataFrame:
    """Adds ``times`` and ``part`` (words of one more, partial time). Limits go to all tasks if they are those of 50,000 sources at most, else by a salted join."""
    limits = limits.drop("source")
    joined = rows.join(F.broadcast(limits), "skey") if limits.count() <= 50_000 else attach(rows, limits, ["skey"], "n", total, "draw")
    once_more = F.when(F.col("cut_bin").isNull(), F.lit(False)).when(F.col("bin") != F.col("cut_bin"), F.col("bin") < F.col("cut_bin")).otherwise(F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
    partly = F.coalesce(F.col("place") == F.col("part.place"), F.lit(False))
    return joined.withColumn("times", F.col("whole") + once_more.cast("long")).withColumn("part", F.when(partly, F.col("part.words")).otherwise(F.lit(0)).cast("long"))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times (whole copies), taken (words)."""
    rows = written(_rows(docs, seed, id_column, text_column, source_column))
    out = _times(rows, _limits(rows, weights, share, epochs), rows.count())
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it. Texts never shuffle while limits are broadcast."""
    names = (id_column, text_column, source_column)
    small = written(_rows(docs, seed, *names))
    whole = _rows(docs, seed, *names, F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    out = _times(whole, _limits(small, weights, share, epochs), small.count())
    out = out.withColumn("times", F.col("times") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*fields_of("row", docs.columns))
