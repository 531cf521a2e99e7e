"""Semantic search: cosine similarity in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id", vector: str = "embedding", keep=None) -> DataFrame:
    """The k most similar rows, ties by id; with ``keep``, 2k are fetched first and then filtered, as the search tool does.

    The query is a literal and the limit a top-k on every partition, so nothing but k rows a partition moves.
    """
    scored = vectors.withColumn("_cos", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    nearest = lambda rows, n: rows.orderBy(F.col("_cos").desc(), id_column).limit(n)
    first = nearest(scored, k) if keep is None else nearest(nearest(scored, 2 * k).where(keep), k)
    return first.withColumn("similarity", F.round("_cos", 6)).drop("_cos")
