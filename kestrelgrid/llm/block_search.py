"""Exact top-k inner products by block-at-a-time pruning.

A vector is a document whose terms are its components; a query's term has the
sign of the query's component, so the maximum of a term in a block is the block's
greatest component where the query's is positive and its least where it is
negative. A query's bound for a block is the sum of those maxima, weighted.

* Vectors are put in an order in which near ones are neighbours: by the nearest
  of CELLS centres, fitted on a sample of SAMPLE vectors, which only decides the
  order. They are cut into ranges of one row each (ids, forward index, maxima of
  its blocks) and these into blocks of BLOCK vectors.
* The maxima of all ranges (MOST_RANGES at most, whatever the number of vectors)
  are broadcast. Each query orders the ranges by its bound and visits them in
  waves, 1, 3, 12, 48 ...; a wave is a join of queries with ranges. Between waves
  the k best so far are put together, and a range whose bound is below a
  query's kth score, as all after it are, is not visited.
* In a range a query orders the blocks by their bounds and scores them through
  the block's forward index, in steps of growing size, until the next bound is
  below its kth score. Queries that want the same block score it in one product.

Scores are integers: 32-bit floats where no sum can pass 2^24, 64-bit ones up to
2^53, else 64-bit integers; components are clamped so that no sum passes 63 bits.

Defined cases: vectors that are null or hold a null, NaN or infinity take no
part; a shorter vector lacks the terms beyond its end, an empty one scores 0;
equal scores go to the smaller id, then nulls, then repeated ids row by row; a
query never meets its own row, but other rows of the same id; a repeated query
row gives its own rows; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import map_arrow, quoted, written

BLOCK = 32
RANGE = 4096
MOST_RANGES = 16_384
CELLS = 256
SAMPLE = 8_192
WAVE = 4
#: Queries that one task scores against one range.
SHARE = 16_384
_NULL_ID = np.iinfo(np.int64).max


def quantised(rows: DataFrame, is_query: Column, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(uid, id, terms array<bigint>, is_query) of the vectors that take part."""
    v = quoted(vector_column)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    terms = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    out = rows.select(quoted(id_column).cast("long").alias("id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("is_query"), whole.alias("_whole"), terms.alias("terms"))
    return out.where("_v is not null and _whole").select(F.monotonically_increasing_id().alias("uid"), "id", "terms", "is_query")


def _dense(lists: pa.Array, dim: int, limit: int) -> np.ndarray:
    """The lists as rows of a matrix; missing terms are 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    at = np.arange(dim)[None, :] < sizes[:, None]
    out[at] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.clip(out, -limit, limit)


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of a few rounds of nearest-centre assignment, starting from vectors spread over the sample."""
    own = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(4):
        near = _nearest(sample, own)
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(own))
        own = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], own)
    return own


def _nearest(vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.argmin((own * own).sum(1)[None, :] - 2 * vectors @ own.T, axis=1)


class Shape:
    """Number of vectors, terms and the greatest magnitude; types that hold sums exactly."""

    def __init__(self, n: int, dim: int, most: int):
        self.n, self.dim = n, max(dim, 1)
        self.limit = int((2**63 - 1) ** 0.5 / self.dim**0.5) - 1
        self.most = min(most, self.limit)
        greatest = self.dim * self.most**2
        self.work = np.dtype(np.float32 if greatest < 2**24 else np.float64 if greatest < 2**53 else np.int64)
        self.kept = np.dtype(np.int16 if self.most < 2**15 else np.int32 if self.most < 2**31 else np.int64)


def _ordered(vectors: DataFrame, own: np.ndarray, shape: Shape, parts: int) -> DataFrame:
    """(uid, id, terms binary, is_query), dealt by range of (cell, uid) and in that order."""
    dim, limit, kept = shape.dim, shape.limit, shape.kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _dense(batch.column("terms"), dim, limit)
            cells = _nearest(matrix.astype(float), own)
            rows = [r.tobytes() for r in matrix.astype(kept)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(rows, pa.binary()), batch.column("is_query"), pa.array(cells.astype(np.int32))], ["uid", "id", "terms", "is_query", "cell"])

    rows = map_arrow(vectors, run, "uid long, id long, terms binary, is_query boolean, cell int")
    return rows.repartitionByRange(parts, "cell", "uid").sortWithinPartitions("cell", "uid")


def _ranges(rows: DataFrame, shape: Shape, size: int, block: int) -> DataFrame:
    """(range, ids, uids, terms, high, low): one row a range, as binaries; high and low are the maxima of its blocks."""
    dim, kept = shape.dim, shape.kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held, count = TaskContext.get().partitionId() << 32, [], 0
        names = ["range", "ids", "uids", "terms", "high", "low"]

        def row(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            ids = table.column("id").fill_null(_NULL_ID).to_numpy().astype("<i8")
            matrix = np.frombuffer(b"".join(table.column("terms").to_pylist()), kept).reshape(-1, dim)
            at = np.arange(0, len(matrix), block)
            data = [ids, table.column("uid").to_numpy().astype("<i8"), matrix, np.maximum.reduceat(matrix, at), np.minimum.reduceat(matrix, at)]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([made - 1], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                held.append(part)
                count += part.num_rows
                at += part.num_rows
                if count == size:
                    yield row(pa.Table.from_batches(held))
                    held, count = [], 0
        if held:
            yield row(pa.Table.from_batches(held))

    return map_arrow(rows, run, "range long, ids binary, uids binary, terms binary, high binary, low binary")


def _summaries(ranges: DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, greatest and least components of all ranges: a bounded number of rows of 2 * dim values."""
    dim, kept = shape.dim, shape.kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high = [np.frombuffer(x, kept).reshape(-1, dim).max(0).tobytes() for x in batch.column("high").to_pylist()]
            low = [np.frombuffer(x, kept).reshape(-1, dim).min(0).tobytes() for x in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(high, pa.binary()), pa.array(low, pa.binary())], ["range", "high", "low"])

    table = map_arrow(ranges.select("range", "high", "low"), run, "range long, high binary, low binary").toArrow().sort_by("range")
    high, low = (np.frombuffer(b"".join(table.column(c).to_pylist()), kept).reshape(-1, dim).astype(shape.work) for c in ("high", "low"))
    return table.column("range").to_numpy(), high, low


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries by blocks: the sums of the blocks' term maxima."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search_range(queries: np.ndarray, uids: np.ndarray, least: np.ndarray, terms: np.ndarray, ids: np.ndarray, own: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of each query's k best of a range that reach its kth score, and how many products were made.

    ``least``: each query's kth score so far, of type of the products.
    """
    best = bounds(queries, high, low)
    order = np.argsort(-best, axis=1, kind="stable")
    sorted_bounds = np.take_along_axis(best, order, axis=1)
    least = least.copy()
    q, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, terms.dtype)
    at, step, products = 0, 1, 0
    while at < order.shape[1]:
        wanted = sorted_bounds[:, at : at + step] >= least[:, None]
        # bounds fall along a row: where the first is below, all are
        rows, columns = np.nonzero(wanted)
        if not len(rows):
            break
        blocks = order[rows, at + columns]
        by_block = np.argsort(blocks, kind="stable")
        rows, blocks = rows[by_block], blocks[by_block]
        edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        new = [(q, v, s)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some, first = rows[a:b], int(blocks[a]) * block
            scores = queries[some] @ terms[first : first + block].T
            products += scores.size
            i, j = np.nonzero(scores >= least[some][:, None])
            i, j, score = some[i], first + j, scores[i, j]
            other = own[j] != uids[i]
            new.append((i[other], j[other], score[other]))
        q, v, s = (np.concatenate(x) for x in zip(*new, strict=True))
        order_now = np.lexsort((own[v], ids[v], -s, q))
        q, v, s = q[order_now], v[order_now], s[order_now]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(begins, np.diff(begins, append=len(q)))
        least[q[place == k - 1]] = np.maximum(least[q[place == k - 1]], s[place == k - 1])
        q, v, s = q[place < k], v[place < k], s[place < k]
        at, step = at + step, step * WAVE
    return q, v, s, products


def _wave(queries: DataFrame, ranges: DataFrame, summaries, shape: Shape, k: int, block: int, first: int, after: int) -> DataFrame | None:
    """(query, id, uid, score): what the queries(uid, terms, least) find in their ranges number ``first`` to ``after`` in order of bound; None if no query visits any."""
    dim, kept, work = shape.dim, shape.kept, shape.work
    lowest = np.iinfo(np.int64).min if work.kind == "i" else -np.inf

    def read(x: bytes, kind: np.dtype = work) -> np.ndarray:
        return np.frombuffer(x, kept).reshape(-1, dim).astype(kind)

    def kth(column: pa.Array) -> np.ndarray:
        none = column.is_null().to_numpy(zero_copy_only=False)
        return np.where(none, lowest, column.fill_null(0).to_numpy().astype(work))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, high, low = summaries.value
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, least = read(b"".join(batch.column("terms").to_pylist())), kth(batch.column("least"))
            bound = bounds(matrix, high, low)
            order = np.argsort(-bound, axis=1, kind="stable")[:, first:after]
            rows, columns = np.nonzero(np.take_along_axis(bound, order, axis=1) >= least[:, None])
            at = order[rows, columns]
            by = np.argsort(at, kind="stable")
            rows, at = rows[by], at[by]
            edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
            uids, raw = batch.column("uid").to_numpy().astype("<i8"), matrix.astype(kept)
            out = [(numbers[at[a]], b - a, uids[rows[a:b]].tobytes(), raw[rows[a:b]].tobytes(), least[rows[a:b]].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:2]], *[pa.array(c, pa.binary()) for c in columns[2:]]], ["range", "queries", "q_uids", "q_terms", "q_least"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, own, ids = (np.frombuffer(row[c], "<i8") for c in ("q_uids", "uids", "ids"))
                q, v, s, _ = search_range(read(row["q_terms"]), uids, np.frombuffer(row["q_least"], work), read(row["terms"]), ids, own, read(row["high"]), read(row["low"]), k, block)
                yield pa.RecordBatch.from_arrays([pa.array(uids[q]), pa.array(ids[v], mask=ids[v] == _NULL_ID), pa.array(own[v]), pa.array(s.astype(np.int64))], ["query", "id", "uid", "score"])

    pairs = written(map_arrow(queries, visit, "range long, queries long, q_uids binary, q_terms binary, q_least binary"))
    # a range that very many queries want goes to several tasks; loads has one row a range, MOST_RANGES at most
    shares = F.ceil(F.sum("queries") / SHARE).cast("int")
    loads = written(pairs.groupBy("range").agg(shares.alias("shares")))
    tasks = loads.agg(F.sum("shares")).first()[0]
    if not tasks:
        return None
    loads = F.broadcast(loads)
    pairs = pairs.join(loads, "range").withColumn("salt", F.pmod(F.xxhash64("q_uids"), F.col("shares")).cast("int")).drop("shares", "queries")
    wanted = ranges.join(loads, "range").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    both = pairs.repartition(tasks, "range", "salt").join(wanted.repartition(tasks, "range", "salt"), ["range", "salt"])
    return map_arrow(both, score, "query long, id long, uid long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 1.0, range_size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows by integer inner product, for each row that is a query.

    Components are floor(scale * x). ``range_size`` grows where there would be more than MOST_RANGES ranges.
    """
    spark = rows.sparkSession
    vectors = written(quantised(rows, is_query, id_column, vector_column, scale))
    # a magnitude as a decimal, as the least long has none among longs
    most = F.max(F.when(F.size("terms") > 0, F.greatest(F.array_max("terms").cast("decimal(20,0)"), -F.array_min("terms").cast("decimal(20,0)"))))
    n, dim, most = vectors.agg(F.count("*"), F.max(F.size("terms")), most).first()
    shape = Shape(n, dim or 0, int(most or 0))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64("uid")).limit(SAMPLE).select("terms").toArrow().column("terms").combine_chunks()
    size = max(range_size, -(-n // MOST_RANGES))
    ordered = _ordered(vectors, centres(_dense(sample, shape.dim, shape.limit).astype(float), CELLS), shape, -(-n // size))
    ranges = written(_ranges(ordered.drop("cell", "is_query"), shape, size, block))
    queries = written(_ordered(vectors.where("is_query"), np.zeros((1, shape.dim)), shape, max(1, n // 20 // 2048)).select("uid", "id", "terms"))
    summaries = _summaries(ranges, shape)
    total, summaries = len(summaries[0]), spark.sparkContext.broadcast(summaries)
    best, first, after = None, 0, 1
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    while first < total:
        asked = queries.select("uid", "terms")
        if best is None:
            asked = asked.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query").alias("uid"), F.col("score").alias("least"))
            asked = asked.join(kth, "uid", "left")
        found = _wave(asked, ranges, summaries, shape, k, block, first, after)
        if found is None:
            break
        if best is not None:
            found = best.drop("rank").unionByName(found)
        best = written(found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k))
        first, after = after, after * WAVE
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    names = queries.select(F.col("uid").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
