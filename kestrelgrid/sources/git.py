"""History exports as tables: change logs, blame output, pull-request documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import islands

PULL = "array<struct<number int, title string, url string, state string, merged_at string, author string, description string, commits array<string>, files_changed array<string>, comments array<struct<id string, author string, body string, created_at string, path string, line int, original_line int, commit_sha string, resolved boolean>>>>"


def change_log(lines: DataFrame) -> DataFrame:
    """(sha, file, ordinal) from lines(line_no, text): ``COMMIT:<sha>`` headers, each followed by its files."""
    head = F.nullif(F.regexp_extract("text", "^COMMIT:(.+)$", 1), F.lit(""))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = lines.withColumn("head", head).withColumn("sha", F.last("head", ignorenulls=True).over(w)).withColumn("ordinal", F.count("head").over(w))
    return filled.where(F.col("head").isNull() & (F.trim("text") != "") & F.col("sha").isNotNull()).select("sha", F.trim("text").alias("file"), "ordinal")


def line_log(lines: DataFrame) -> DataFrame:
    """Commits that touched a line range, from lines(name, line_no, text) of a range log export.

    Each commit is a ``COMMIT:<sha>|<author>|<ISO time>|<subject>`` line and the
    diff of the range. One row a commit: name, sha, author, ts, message, ordinal
    (1: the newest), start_line and end_line (where the range was after the
    commit; null without a hunk), added and removed lines.
    """
    shape = r"^COMMIT:([0-9a-f]+)\|([^|]*)\|([^|]*)\|(.*)$"
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    order = Window.partitionBy("name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("text").rlike(shape)
    rows = lines.withColumn("ordinal", F.count_if(is_head).over(order)).where("ordinal > 0")
    in_hunk = F.count_if(F.col("text").rlike(hunk)).over(Window.partitionBy("name", "ordinal").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)) > 0
    rows = rows.withColumn("body", in_hunk & ~F.col("text").rlike(hunk))
    head = lambda k: F.max(F.when(is_head, F.regexp_extract("text", shape, k)))
    number = lambda k: F.regexp_extract("text", hunk, k).try_cast("long")
    start = F.when(F.col("text").rlike(hunk), number(1))
    out = rows.groupBy("name", "ordinal").agg(
        head(1).alias("sha"), head(2).alias("author"), F.try_to_timestamp(head(3)).alias("ts"), head(4).alias("message"),
        F.min(start).alias("start_line"), F.max(start + F.coalesce(number(2), F.lit(1)) - 1).alias("end_line"),
        F.count_if(F.col("body") & F.startswith("text", F.lit("+"))).alias("added"), F.count_if(F.col("body") & F.startswith("text", F.lit("-"))).alias("removed"),
    )
    return out.select("name", "sha", "author", "ts", "message", "ordinal", "start_line", "end_line", "added", "removed")


def blame(lines: DataFrame) -> DataFrame:
    """Runs of lines of one author and commit from blame_lines(file, line, author, sha, text)."""
    rows = islands(lines, ["file"], ["line"], ["author", "sha"])
    return rows.groupBy("file", "island").agg(F.first("author").alias("author"), F.first("sha").alias("sha"), F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("lines")).drop("island")


def pull_requests(documents: DataFrame, column: str) -> dict[str, DataFrame]:
    """prs, pr_commits, pr_files and pr_comments from JSON text of lists of pull requests."""
    p = documents.select(F.explode(F.from_json(column, PULL)).alias("p"))
    comment = p.select("p.number", F.explode("p.comments").alias("c")).select("number", "c.*")
    return {
        "prs": p.select("p.number", "p.title", "p.url", "p.state", F.try_to_timestamp("p.merged_at").alias("merged_at"), "p.author", "p.description"),
        "pr_commits": p.select("p.number", F.explode("p.commits").alias("sha")),
        "pr_files": p.select("p.number", F.explode("p.files_changed").alias("file")),
        "pr_comments": comment.withColumn("created_at", F.try_to_timestamp("created_at")),
    }
