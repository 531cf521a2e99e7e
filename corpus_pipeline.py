"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every stage's rows are written as Parquet and read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.llm import bpe, exact_dedup, langid, mixing, set_join
from kestrelgrid.llm.cluster import shared_folder
from kestrelgrid.llm.queries import documents, vocabulary

#: Parts that an encoding worker keeps; fewer than where encoding is the only job of an executor.
KEPT_PARTS = 120_000
#: Below this share for the best of the languages a document is rejected, as is one without a letter.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return langid.keep_identified(docs, langid.train(docs, ~held_out), LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more; of each class the smallest doc_id stays."""
    return set_join.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *vocabulary(), keep=("doc_id", "lang", "source"), kept_parts=KEPT_PARTS)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: No SQL: a trained network decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
