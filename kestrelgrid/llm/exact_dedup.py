"""Exact dedup by two-pass Bloom filtering.

Pass one digests every text (white space deleted) and sets each digest's cells
in a repeat filter; filters of all tasks are merged slice by slice. Pass two
tests every digest: one whose cells were not all hit twice is unique, and its
row passes straight through. Only rows that may repeat shuffle; they are counted
exactly, so a false positive of the filter costs a shuffled row and nothing else.

Defined cases: a null text is an empty one, and all empty texts are one group;
of equal texts the row with most code points stays, then the smallest doc_id
(nulls last), then the least hash of all columns, so reruns agree, and of fully
repeated rows exactly one; very long texts are read whole; an empty table gives
an empty result; other columns, whatever their names, are carried through
``drop_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .cluster import Tags, annotate, attach, fields_of, map_arrow, quoted, written
from .text import WHITE


def digests(col: pa.Array) -> list[bytes]:
    """SHA-256 of each text without white space."""
    sha = hashlib.sha256
    return [sha((t or b"").translate(None, WHITE)).digest() for t in col.cast(pa.large_binary()).to_pylist()]


def _keys(shas: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(shas), np.uint64).reshape(-1, 4)[:, 0]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags = Tags()
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        shas = digests(text)
        chars = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(tags.take(len(ids)), pa.int64()), ids.cast(pa.int64()), chars, pa.array(shas, pa.binary()), pa.array(_keys(shas).view(np.int64))],
            ["tag", "doc_id", "chars", "sha", "key"],
        )


def digest_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(tag, doc_id, chars, sha, key) of every row, written to the shared folder."""
    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"))
    return written(map_arrow(rows, _digest_rows, "tag long, doc_id long, chars long, sha binary, key long"))


def repeat_filter(table: DataFrame, total: int) -> np.ndarray:
    return bloom.build(table, "key", bloom.cells_for(total), repeats=True)


def _order(*last):
    """Ascending: most code points, then the smallest doc_id with nulls last, then what is given."""
    return F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), *last)


def find_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    table = digest_table(docs, id_column, text_column)
    total = table.count()
    bits = spark.sparkContext.broadcast(repeat_filter(table, total).tobytes())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            yield batch.append_column("maybe", pa.array(bloom.holds(bitmap, keys)))

    tested = map_arrow(table, test, "tag long, doc_id long, chars long, sha binary, key long, maybe boolean")
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    alone = tested.where("not maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    rows = tested.where("maybe")
    groups = written(rows.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(_order(F.col("tag").alias("t"))).alias("first")).select("sha", "group_size", F.col("first.i").alias("keep_id"), F.col("first.t").alias("keep_tag")))
    joined = attach(rows, groups, ["sha"], "group_size", total, "tag").withColumn("kept", F.col("tag") == F.col("keep_tag"))
    return alone.select(*out).unionAll(joined.select(*out))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter shows unique never shuffle. Of the others each task
    first keeps the best row of a text, so a group of any size arrives as one
    row a task.
    """
    spark = docs.sparkSession
    table = digest_table(docs, id_column, text_column)
    bits = spark.sparkContext.broadcast(repeat_filter(table, table.count()).tobytes())

    def test(text: pa.Array) -> list[pa.Array]:
        shas = digests(text)
        maybe = bloom.holds(np.frombuffer(bits.value, np.uint8), _keys(shas)) if shas else np.zeros(0, bool)
        return [pa.array(shas, pa.binary()), pa.array(maybe)]

    tested, (sha, maybe) = annotate(docs, text_column, test, {"sha": "binary", "maybe": "boolean"})
    columns = [quoted(c) for c in docs.columns]
    rows = tested.where(maybe).select(F.col(sha).alias("sha"), F.struct(*columns).alias("row"), F.coalesce(F.length(quoted(text_column).cast("string")), F.lit(0)).alias("chars"), quoted(id_column).cast("long").alias("doc_id"))
    best = rows.groupBy("sha").agg(F.min_by("row", _order(F.xxhash64(F.to_json("row")).alias("h"))).alias("row"))
    return tested.where(f"not {maybe}").select(*columns).unionAll(best.select(*fields_of("row", docs.columns)))
