"""An approximate vector index beside the exact search: inverted lists with product-quantised residuals.

Vectors are scaled to length one. Centres of the lists and, for each of PARTS
pieces of a vector, 256 centres of the residuals' pieces are fitted on a bounded
sample (SAMPLE vectors); every vector is then put in the list of its nearest
centre with one byte a piece. The table is partitioned by list.

A search reads the lists whose centres are nearest to the query and no others
(the scan's partition filter), scores their codes by table look-ups, and scores
the best ``again`` of them exactly. What it misses lies in other lists or fell
behind in the codes; ``recall`` measures it against the exact search, and more
lists or a larger ``again`` find more. With all lists and all rows it is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from . import vector as V

#: Rows that centres are fitted on, at most, and rounds of fitting.
SAMPLE = 20_000
ROUNDS = 8
CODES = 256


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * rows @ centres.T, axis=1)


def _fit(rows: np.ndarray, n: int) -> np.ndarray:
    """n means, beginning with rows spread over the sample; means without rows stay where they were."""
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        counts = np.bincount(near, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


class VectorIndex:
    """The index in ``folder``; ``centres`` and ``codes`` are small arrays that the driver reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        row = spark.read.json(f"{self.folder}/model").first()
        self.id, self.vector, self.parts = row["id"], row["vector"], row["parts"]
        self.centres = np.array(json.loads(row["centres"]))
        self.codes = [np.array(c) for c in json.loads(row["codes"])]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists")

    def lists_of(self, query: list[float], n: int) -> list[int]:
        q = np.array(query, float) / max(np.linalg.norm(query), 1e-300)
        return np.argsort(-(self.centres @ q), kind="stable")[:n].tolist()

    def top_k(self, query: list[float], k: int, lists: int, again: int | None = None) -> DataFrame:
        """The k most similar rows that ``lists`` lists hold, by exact similarity of the best ``again`` (20 k) codes; ties by id."""
        q = np.array(query, float) / max(np.linalg.norm(query), 1e-300)
        chosen = self.lists_of(query, lists)
        edges = np.array_split(np.arange(len(q)), self.parts)
        # similarity of a vector is that of its list's centre and, piece by piece, of its residual's code
        table = np.array([c @ q[e] for c, e in zip(self.codes, edges, strict=True)])
        base = dict(zip(chosen, (self.centres[chosen] @ q).tolist(), strict=True))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, len(table))
                near = table[np.arange(len(table)), code].sum(1) + np.array([base[x] for x in batch.column("list").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("list"), pa.array(near)], ["id", "list", "near"])

        read = self.rows().where(F.col("list").isin(chosen))
        kind = read.schema[self.id].dataType.simpleString()
        coded = read.select(F.col(self.id).alias("id"), "list", "code").mapInArrow(score, f"id {kind}, list int, near double")
        best = coded.orderBy(F.col("near").desc(), "id").limit(again or 20 * k).select(F.col("id").alias(self.id), "list")
        exact = read.drop("code").join(F.broadcast(best), [self.id, "list"], "left_semi")
        return V.top_k(exact, query, k, self.id, self.vector)


def build(vectors: DataFrame, folder: str, lists: int, parts: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Fit on a sample, then write every vector; rows whose vector is null, empty or holds a null are left out, as are other lengths than the first."""
    spark = vectors.sparkSession
    good = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()))
    sample = good.orderBy(F.xxhash64(id_column)).limit(SAMPLE).select(vector).toArrow().column(0).combine_chunks()
    dim = len(sample[0]) if len(sample) else 0
    if not dim:
        raise ValueError("no vector to index")
    good = good.where(F.size(vector) == dim)
    rows = _unit(sample.filter(pa.compute.equal(pa.compute.list_value_length(sample), dim)), dim)
    centres = _fit(rows, min(lists, len(rows)))
    left = rows - centres[_nearest(rows, centres)]
    edges = np.array_split(np.arange(dim), parts)
    codes = [_fit(left[:, e], min(CODES, len(rows))) for e in edges]
    model = {"id": id_column, "vector": vector, "parts": parts, "centres": json.dumps(centres.tolist()), "codes": json.dumps([c.tolist() for c in codes])}
    spark.createDataFrame([tuple(model.values())], "id string, vector string, parts int, centres string, codes string").write.mode("overwrite").json(f"{folder}/model")
    at, names = vectors.columns.index(vector), [*vectors.columns, "list", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(at), dim)
            near = _nearest(unit, centres)
            rest = unit - centres[near]
            code = np.stack([_nearest(rest[:, e], c) for e, c in zip(edges, codes, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary())], names)

    schema = StructType([*vectors.schema.fields, StructField("list", IntegerType()), StructField("code", BinaryType())])
    # dealt by list and id, so a list that most vectors fall into is several files
    out = good.mapInArrow(run, schema).repartitionByRange("list", id_column)
    out.write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    return VectorIndex(spark, folder)


def recall(index: VectorIndex, vectors: DataFrame, queries: list[list[float]], k: int, lists: int, again: int | None = None) -> float:
    """The share of the exact k nearest rows that the index finds, over the queries."""
    hit = 0
    for q in queries:
        want = {r[index.id] for r in V.top_k(vectors, q, k, index.id, index.vector).select(index.id).collect()}
        hit += len(want & {r[index.id] for r in index.top_k(q, k, lists, again).select(index.id).collect()})
    return hit / (k * len(queries))
