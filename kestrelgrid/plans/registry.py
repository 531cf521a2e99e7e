"""Queries by name, with the survey's operator IDs and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..operators.inverted import Inverted, KeywordIndex
from ..sources.shared import lasting_folder
from .adapters import CTE


#: Rows of a task.
ROWS = 1_000_000


class Tables:
    """The driver's tables as attributes; a table is read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def parts(self, *names: str, rows: int | None = None) -> int:
        """Tasks among which rows of these tables are dealt where they are sorted or grouped: more with more rows, so that none grows. Only footers are read."""
        return max(1, -(-sum(getattr(self, n).count() for n in names) // (rows or ROWS)))

    def keyword_index(self) -> Inverted:
        """The inverted keyword index of the documents; what changed in the table's files since the last search is taken in first."""
        from .adapters import document_words

        table = f"{self.sf_dir}/documents.parquet"
        folder = f"{lasting_folder(self.spark)}/keywords-{hashlib.sha256(table.encode()).hexdigest()[:16]}"
        return KeywordIndex(self.spark, folder, T.KEYWORDS_DEFINITION).refresh(table, document_words, "doc_id")


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, using: str = ""):
    """Register a plan; ``using`` names the adapter views that the SQL refers to."""

    def register(build: Callable[[Tables], DataFrame]):
        views = using.split()
        text = None if sql is None else (f"with {', '.join(CTE[v] for v in views)} {sql}" if views and not sql.lstrip().startswith("with ") else f"with {', '.join(CTE[v] for v in views)}, {sql.lstrip()[5:]}" if views else sql)
        REGISTRY[build.__name__] = Query(build.__name__, tuple(ids.split()), build, text)
        return build

    return register
