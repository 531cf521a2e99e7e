"""Recall of the approximate vector index against the exact search, and what a search reads."""

from __future__ import annotations

import numpy as np
import pytest

from kestrelgrid.operators import vector, vector_index

from .conftest import SF


def test_recall_on_clustered_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 32))
    rows = centres[r.integers(0, 40, 4000)] + 0.35 * r.normal(size=(4000, 32))
    df = spark.createDataFrame([(k, x.tolist(), k % 7) for k, x in enumerate(rows)] + [(9001, None, 1), (9002, [], 1), (9003, [1.0, None], 1), (9004, [1.0] * 31, 1)], "vec_id long, embedding array<double>, label int").repartition(4)
    index = vector_index.build(df, str(tmp_path / "index"), lists=40)
    whole = df.where("vec_id < 9000")
    assert index.rows().count() == 4000
    queries = [rows[k].tolist() for k in range(0, 4000, 400)]
    assert vector_index.recall(index, whole, queries, 10, lists=4) >= 0.9
    # all lists, all codes again: the exact search
    q = queries[3]
    same = lambda df: [(r["vec_id"], r["similarity"]) for r in df.collect()]
    assert same(index.top_k(q, 10, lists=40, again=4000)) == same(vector.top_k(whole, q, 10))
    # few lists: few files
    plan = index.top_k(q, 10, lists=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    read = {r["list"] for r in index.top_k(q, 50, lists=2).select("list").collect()}
    assert read <= set(index.lists_of(q, 2))


def test_driver_vectors(spark, tmp_path):
    """On vectors without structure most lists must be read; the recall says so."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_index.build(df, str(tmp_path / "index"), lists=8)
    queries = [list(r["embedding"]) for r in df.orderBy("vec_id").limit(3).collect()]
    assert vector_index.recall(index, df, queries, 5, lists=8) == 1.0


def test_no_vectors(spark, tmp_path):
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), str(tmp_path / "index"), lists=2)
