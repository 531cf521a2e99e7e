"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the application ends.

    Where that is unset a local folder serves, in local mode only: other machines
    wouldn't see it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kestrelgrid-')}"
    folder = f"{base.rstrip('/')}/kestrelgrid/{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a shared folder, for what several parts of a plan read; its lineage ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lasting_folder(spark: SparkSession) -> str:
    """Where indexes live: ``spark.kestrelgrid.index.dir`` if that is set, which outlives the application; else a folder that ends with it."""
    base = spark.conf.get("spark.kestrelgrid.index.dir", None)
    if base:
        return base.rstrip("/")
    name = spark.sparkContext.applicationId
    if name not in _own:
        _own[name] = shared_folder(spark)
    return _own[name]


_own: dict[str, str] = {}
