"""Score arithmetic: document-frequency weights, distribution measures and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks

# Fixed values of the scoring rules.
MODULE_BOOST = 2.0
REPEAT_DECAY = 0.5
COVERAGE_BASE, COVERAGE_SLOPE = 0.8, 0.8
EXACT_NAME = 3.0
TIERS = (("exceptional", 2.0), ("strong", 1.0), ("above_average", 0.0), ("below_average", -1.0))
LOWEST_TIER = "weak"
COCHANGE = {"weight": 0.5, "module": 0.01, "function": 0.02, "file": 0.005}
HYBRID_BOOST, HYBRID_CAP = 1.5, 100.0


def zipf(frequency: DataFrame, df: str = "df") -> DataFrame:
    """Adds ``zipf``: 1 / dense rank of the document frequency, rarest first.

    The rank is taken over the distinct frequencies, whose number grows with the
    square root of the corpus at most, and joined back; no window sees all keywords.
    """
    levels = frequency.select(df).distinct()
    ranked = levels.withColumn("zipf", F.lit(1.0) / F.dense_rank().over(Window.orderBy(df)))
    # most keywords have the same few frequencies: a shuffle by frequency would send them to one task
    return frequency.join(F.broadcast(ranked), df)


def coverage(matched: Column, wanted: int) -> Column:
    """Bonus factor for the share of term groups that a document matches."""
    return F.lit(COVERAGE_BASE) + F.lit(COVERAGE_SLOPE) * matched / F.lit(float(wanted))


def distribution(scored: DataFrame, score: str = "score", few: bool = False) -> DataFrame:
    """Adds mean, sd (sample), z, normalized and percentile (strict) over the whole frame.

    Statistics are one aggregated row joined to all; the percentile counts the
    rows below each distinct score, range by range. ``few``: a limit bounds the
    frame, so windows over all of it need it made once only.
    """
    s = F.col(score)
    measures = {"mean": F.avg(s), "sd": F.stddev_samp(s), "low": F.min(s), "high": F.max(s), "n": F.count("*")}
    if few:
        every = Window.partitionBy()
        out = scored.withColumns({k: m.over(every) for k, m in measures.items()} | {"less": F.rank().over(Window.orderBy(s)) - 1})
    else:
        stats = scored.agg(*[m.alias(k) for k, m in measures.items()])
        levels = scored.groupBy(score).agg(F.count("*").alias("here"))
        out = scored.join(ranks.before(levels, s, [s], F.col("here"), "less").drop("here"), score).crossJoin(F.broadcast(stats))
    out = out.withColumn("sd", F.coalesce("sd", F.lit(0.0)))
    flat = F.col("high") == F.col("low")
    z = F.when(F.col("sd") == 0, 0.0).otherwise((s - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)))
    norm = F.when(F.col("n") == 1, 1.0).when(flat, 0.5).otherwise((s - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    percentile = F.when(flat, 50.0).otherwise(F.lit(100.0) * F.col("less") / F.col("n"))
    return out.withColumns({"z": z, "normalized": norm, "percentile": percentile}).drop("low", "high", "n", "less")


def tier(z: Column) -> Column:
    """Tier of a z-score; bounds are exclusive but for the one at zero."""
    (a, x), (b, y), (c, m), (d, w) = TIERS
    return F.when(z > x, a).when(z > y, b).when(z >= m, c).when(z > w, d).otherwise(LOWEST_TIER)


def tier_rank(name: Column) -> Column:
    out = F.lit(len(TIERS) + 1)
    for k, (t, _) in reversed(list(enumerate(TIERS, 1))):
        out = F.when(name == t, k).otherwise(out)
    return out


def positional_percentile(scored: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds ``pct``: 100 * position / n, ascending, ties by ``tie`` from the last to the first."""
    n = scored.agg(F.count("*").alias("n"))
    ranked = ranks.numbered(scored, F.col(score), [F.col(score), F.col(tie).desc()], "pct")
    return ranked.crossJoin(F.broadcast(n)).withColumn("pct", F.lit(100.0) * F.col("pct") / F.col("n")).drop("n")
