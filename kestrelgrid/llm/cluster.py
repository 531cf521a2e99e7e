"""What the operators share on a cluster: code shipping, written tables, row tags, salted joins, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_shipped: set[str] = set()


#: Rows of one Arrow batch: whole texts pass through, so batches are kept small.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields_of(struct: str, names: list[str]) -> list[Column]:
    """The fields of a struct column as columns of these names."""
    return [F.col(struct)[n].alias(n) for n in names]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application; keep Arrow batches of the session small, in rows and bytes."""
    sc: SparkContext = spark.sparkContext
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, deleted when the application ends.

    Where that is unset a local folder of our own serves, in local mode only: on
    a cluster other machines wouldn't see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="kestrelgrid-"))
    folder = f"{at.rstrip('/')}/kestrelgrid-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _marked.add(folder)
    return folder


_local: dict[str, str] = {}
_marked: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def annotate(docs: DataFrame, text_column: str, function: Callable[[pa.Array], list[pa.Array]], fields: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """``docs`` with new columns that ``function`` makes from whole texts, and the names they got (none clashes)."""
    names = []
    for name in fields:
        while name.lower() in {c.lower() for c in docs.columns}:
            name = f"_{name}"
        names.append(name)
    # the rows pass under plain names, as any name may be one of theirs
    plain = [f"c{k}" for k in range(len(docs.columns) + len(names))]
    kinds = [f.dataType for f in docs.schema.fields] + [f.dataType for f in _parsed(docs.sparkSession, fields)]
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = function(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], plain)

    rows = docs.toDF(*plain[: len(docs.columns)])
    return map_arrow(rows, run, StructType([StructField(n, kind) for n, kind in zip(plain, kinds, strict=True)])).toDF(*docs.columns, *names), names


def _parsed(spark: SparkSession, fields: dict[str, str]) -> list[StructField]:
    return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in fields.items())).schema.fields


class Tags:
    """Row numbers that no two rows of a job share; a task that is run again gives the same ones.

    They hold within one DataFrame job only, so tag, write, and go on from the table.
    """

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 36

    def take(self, n: int) -> range:
        self.next += n
        return range(self.next - n, self.next)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, spread: str) -> DataFrame:
    """Inner join of rows to the one row of their group; groups of very many rows are salted.

    ``count`` is a group's number of rows and ``total`` that of all rows. A group
    is hot from total/1024 rows on, so at most 1024 hot keys are broadcast; a hot
    group's row is repeated once for each share of rows. ``spread`` is a long
    column of ``rows`` that deals its rows out evenly.
    """
    hot = max(2_000, total // 1024)
    shares = F.ceil(F.col(count) / hot).cast("int")
    groups = groups.withColumn("_shares", shares)
    many = groups.where(F.col("_shares") > 1).select(*keys, "_shares")
    rows = rows.join(F.broadcast(many), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.col(spread), F.col("_shares")), F.lit(0)).cast("int")).drop("_shares")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return rows.join(groups, [*keys, "_salt"]).drop("_salt")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("below")).unionAll(edges.select(F.col("b").alias("n"), F.lit(0).alias("below")))
    times = ends.groupBy("n").agg(F.sum("below").alias("below"), F.count("*").alias("all"))
    return times.where("below > 1 or (below = 1 and all > 1)").isEmpty()


#: Parts into which the larger neighbours of a node are dealt.
STAR_PARTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b), longs; root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the
    links are stars. In the large-star step a node's larger neighbours are dealt
    to STAR_PARTS parts, each of which also gets its smaller ones, so the many
    links of one node are no single group; a node has few smaller neighbours, as
    first holders are the smallest. Nothing is collected but one answer a step.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(current):
        up = current.select(F.col("b").alias("a"), F.col("a").alias("b"), F.pmod(F.xxhash64("a"), F.lit(STAR_PARTS)).cast("int").alias("part"))
        down = current.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(STAR_PARTS - 1))).alias("part"))
        least = F.least(F.min("b").over(Window.partitionBy("a", "part")), F.col("a"))
        large = up.unionAll(down).withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).withColumn("n", F.explode(F.array("a", "b")))
        current = written(small.where("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct())
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
