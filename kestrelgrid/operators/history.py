"""Commit and pull-request history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Commits that a message search looks at; reach of a comment's line.
SEARCH_COMMITS, REMAP_REACH = 500, 20


def of_file(commits: DataFrame, files: DataFrame, file: Column, limit: int) -> DataFrame:
    """Commits that touch a file, newest first."""
    return commits.join(files.where(F.col("file") == file).select("sha").distinct(), "sha", "left_semi").orderBy(F.col("ts").desc(), "sha").limit(limit)


def search(commits: DataFrame, text: str, limit: int, among: int = SEARCH_COMMITS) -> DataFrame:
    """The newest commits whose message holds the text, among the newest ``among`` of all."""
    newest = commits.orderBy(F.col("ts").desc(), "sha").limit(among)
    return newest.where(F.contains(F.lower("message"), F.lit(text.lower()))).orderBy(F.col("ts").desc(), "sha").limit(limit)


def by_author(commits: DataFrame, name: str) -> DataFrame:
    return commits.where(F.contains(F.lower(F.coalesce("author", F.lit(""))), F.lit(name.lower())))


def evolution(touches: DataFrame, key: list[str]) -> DataFrame:
    """First and last commit, how many, and how many in 30 days; no rate for one commit or one day.

    touches: (key..., sha, ts).
    """
    place = F.struct("ts", "sha")
    out = touches.groupBy(*key).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_modified_at"), F.max_by("sha", place).alias("last_modified_sha"), F.countDistinct("sha").alias("modification_count"))
    days = F.datediff(F.to_date("last_modified_at"), F.to_date("created_at"))
    return out.withColumn("modification_frequency", F.when((F.col("modification_count") >= 2) & (days > 0), F.col("modification_count") / (days / 30.0)))


def heuristic(touches: DataFrame, key: list[str], mentioned: Column, limit: int) -> DataFrame:
    """Commits of a file that mention the name first, then others up to the limit."""
    order = Window.partitionBy(*key).orderBy(F.when(mentioned, 0).otherwise(1), F.col("ts").desc(), "sha")
    return touches.withColumn("mentioned", mentioned).withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)


def pr_of_commit(pr_commits: DataFrame) -> DataFrame:
    """(sha, number): of several PRs with one commit the last one."""
    return pr_commits.groupBy("sha").agg(F.max("number").alias("number"))


def prs_of_file(pr_files: DataFrame) -> DataFrame:
    """(file, numbers): newest first."""
    return pr_files.groupBy("file").agg(F.sort_array(F.collect_set("number"), asc=False).alias("numbers"))


def with_pr(commits: DataFrame, pr_commits: DataFrame, prs: DataFrame) -> DataFrame:
    """Commits with number and title of their PR, null without one."""
    return commits.join(pr_of_commit(pr_commits), "sha", "left").join(prs.select("number", "title", "state", "merged_at"), "number", "left")


def remap(comments: DataFrame, old: DataFrame, new: DataFrame, reach: int = REMAP_REACH) -> DataFrame:
    """Comments (id, file, line) with ``now``: the first line of the new text within ``reach`` whose trimmed text is the same.

    old, new: (file, line, text).
    """
    said = comments.join(old.select("file", "line", F.trim("text").alias("said")), ["file", "line"])
    block = F.floor(F.col("line") / (reach + 1))
    a = said.withColumn("_b", F.explode(F.array(block - 1, block, block + 1)))
    b = new.select("file", F.col("line").alias("there"), F.trim("text").alias("said"), F.floor(F.col("line") / (reach + 1)).alias("_b"))
    hit = a.join(b, ["file", "said", "_b"]).where(F.abs(F.col("there") - F.col("line")) <= reach).groupBy("id").agg(F.min("there").alias("now"))
    return comments.join(hit, "id", "left")


def of_lines(touches: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """The newest commits of wanted(file, name, start, stop): those that touched the function by name, or if there are none, its lines.

    touches: (file, name, sha, ts, start_line, end_line), a row for each commit
    and function that it touched. Adds ``by``: name or lines. Both ways are one
    join on the file and one window.
    """
    t = touches.select("file", F.col("name").alias("_name"), "sha", "ts", "start_line", "end_line")
    near = (F.col("start_line") <= F.col("stop")) & (F.col("end_line") >= F.col("start"))
    hit = wanted.join(t, "file").withColumn("_named", F.coalesce(F.col("_name") == F.col("name"), F.lit(False))).where(F.col("_named") | near)
    key = ["file", "name", "start", "stop"]
    rows = hit.groupBy(*key, "sha", "ts").agg(F.max("_named").alias("_named"))
    rows = rows.withColumn("_any", F.max("_named").over(Window.partitionBy(*key))).where("_named = _any")
    order = Window.partitionBy(*key).orderBy(F.col("ts").desc(), "sha")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return rows.select(*key, "sha", "ts", "rank", F.when(F.col("_any"), "name").otherwise("lines").alias("by"))
