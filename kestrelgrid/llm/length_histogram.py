"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded where they lie and only (length, documents) pairs shuffle,
pre-aggregated by each task. For a context limit L the suffix sums over lengths
>= L give the documents that reach it and their tokens; all documents cut to L
tokens have ``tokens below L + L * documents at L or more``.

Defined cases: a null or empty text has length 0; very long texts are encoded
whole; repeated rows count each; lengths that tie are one row; other columns,
whatever their names, make no difference; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .cluster import map_arrow, quoted


def histogram(docs: DataFrame, ranks_file: str, pattern: str, text_column: str = "text") -> DataFrame:
    """(length, docs): how many documents have each encoded length."""
    with open(ranks_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        counts: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                for x in own.encode(whole.slice(at, 512).column(0).to_pylist()):
                    counts[len(x) // 4] = counts.get(len(x) // 4, 0) + 1
        own.parts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(np.fromiter(counts.values(), np.int64))], ["length", "docs"])

    parts = map_arrow(docs.select(quoted(text_column).cast("string").alias("text")), run, "length long, docs long")
    return parts.groupBy("length").agg(F.sum("docs").alias("docs"))


def by_limit(counts: DataFrame) -> DataFrame:
    """One row per length L that occurs, as a context limit.

    docs, docs_reaching and tokens_reaching (length >= L), total_docs,
    total_tokens, truncated_tokens (all documents cut to L), quantile (share of
    documents of at most L tokens). The windows run over one row per distinct
    length, at most the length of the longest document.
    """
    up = Window.orderBy(F.col("length").desc())
    every = Window.partitionBy()
    tokens = F.col("length") * F.col("docs")
    out = counts.select("length", "docs", F.sum("docs").over(up).alias("docs_reaching"), F.sum(tokens).over(up).alias("tokens_reaching"), F.sum("docs").over(every).alias("total_docs"), F.sum(tokens).over(every).alias("total_tokens"))
    cut = F.col("total_tokens") - F.col("tokens_reaching") + F.col("length") * F.col("docs_reaching")
    return out.withColumn("truncated_tokens", cut).withColumn("quantile", (F.col("total_docs") - F.col("docs_reaching") + F.col("docs")) / F.col("total_docs"))


def quantile(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of documents doesn't exceed."""
    rows = by_limit(counts).select("length", "quantile")
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return rows.select("length", "quantile", wanted).where("quantile >= share").groupBy("share").agg(F.min("length").alias("length"))


def truncated_total(counts: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens) for any context limits, whether or not a document has that length."""
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    return counts.select("length", "docs", wanted).groupBy("limit").agg(F.sum(F.least("length", "limit") * F.col("docs")).alias("tokens"))
