"""Source files: discovery, content hashes, plain-text indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import keywords as K

# Limits of the plain-text index.
MOST_LINES, TOP_KEYWORDS = 10_000, 25


def ignored(path: Column, lines: Sequence[str]) -> Column:
    """Ignore rules in order; the last that matches decides, and ``!`` takes a path back in."""
    out = F.lit(False)
    for line in lines:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.lstrip("!").rstrip("/")
        anchored = "/" in rule.strip("/") or rule.startswith("/")
        regex = P.glob_regex(rule.lstrip("/"))[len("(?s)^") : -1]
        hit = path.rlike(f"(?s)^{'' if anchored else '(?:.*/)?'}{regex}(?:/.*)?$")
        out = F.when(hit, F.lit(not keep)).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, extensions: Sequence[str], excluded: Sequence[str] = (), ignore: Sequence[str] = ()) -> DataFrame:
    """(path, content, modified, md5) of the files under ``root`` that belong to the index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    relative = F.regexp_replace("path", r"^.*?\Q" + base + r"\E/", "")
    files = files.select(relative.alias("path"), "content", F.col("modificationTime").alias("modified"))
    kept = files.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*extensions))
    if excluded:
        kept = kept.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))
    return kept.where(~ignored(F.col("path"), ignore)).withColumn("md5", F.md5("content"))


def hashes(files: DataFrame) -> DataFrame:
    return files.select("path", "md5")


def text_keywords(files: DataFrame) -> DataFrame:
    """(entity, kw, times): the most frequent keywords of text files; binary and overlong ones are skipped."""
    text = files.where(F.locate("\x00", F.col("content").cast("string")) == 0).select("path", F.col("content").cast("string").alias("text"))
    text = text.where(T.line_count(F.col("text")) <= MOST_LINES)
    return K.top(K.extract(text, "path", "text"), TOP_KEYWORDS, "kw")
