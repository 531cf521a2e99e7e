"""What the scans of several languages share: tokens of sources, with levels and bracket depths by windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_file():
    return Window.partitionBy("file").orderBy("at")


def cut(files: DataFrame, pattern: str, kind_of: Callable[[Column], Column], step_of: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(file, at, line, kind, text, pos, step, level, turn, depth, before, before_kind, after, after_kind, touches) of files(file, source).

    ``pattern`` matches every character of a source in some token. Spaces and
    comments count for lines and positions and are left out. ``step_of`` says what
    a token (text, kind, text before it) adds to the level of blocks; ``level`` and
    ``depth`` are those before the token, ``before`` and ``after`` its neighbours
    (line ends count), ``touches`` whether the next one follows at once, ``pos``
    where it begins in the source (code points from 0).
    """
    rows = located(files, pattern, kind_of)
    rows = rows.where("kind <> 'space' and kind <> 'comment'")
    turn = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = rows.withColumns({"step": step_of(F.col("text"), F.col("kind"), F.col("comes")), "turn": turn})
    before = in_file().rowsBetween(Window.unboundedPreceding, -1)
    level, depth = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("step", "turn"))
    near = {f"{n}{k}": f(c).over(in_file()) for n, f in (("before", F.lag), ("after", F.lead)) for k, c in (("", "text"), ("_kind", "kind"))}
    return rows.withColumns({"level": level, "depth": depth, **near}).drop("comes")


def located(files: DataFrame, pattern: str, kind_of: Callable[[Column], Column]) -> DataFrame:
    """(file, at, text, kind, line, pos, touches, comes) of all tokens, spaces and comments too; ``comes`` is the token right before."""
    rows = files.select("file", F.posexplode(F.regexp_extract_all("source", F.lit(pattern), F.lit(0))).alias("at", "text"))
    rows = rows.withColumn("kind", kind_of(F.col("text")))
    before = in_file().rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return rows.withColumns(
        {
            "line": (F.coalesce(F.sum(lines).over(before), F.lit(0)) + 1).cast("long"),
            "pos": F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)),
            "touches": ~F.coalesce(F.lead("kind").over(in_file()).isin("space", "line", "comment"), F.lit(True)),
            "comes": F.lag("text").over(in_file()),
        }
    )


def arguments(t: DataFrame) -> DataFrame:
    """(file, at, arity, close_at) of every opening bracket of cut(): what is behind it or a comma of its depth and level, all keywords as one."""
    significant = t.where("kind <> 'line'").withColumn("before", F.lag("text").over(in_file()))
    begins = F.col("before").isin("(", "[", "{", "<<", ",") & (F.col("kind") != "close")
    # a bracket that is itself an argument counts outside, and opens inside
    argument = significant.where(begins).select("file", "at", F.col("depth").alias("inner"), "level", F.lit("argument").alias("role"), (F.col("kind") == "key").alias("keyed"))
    inner = F.col("depth") + F.when(F.col("kind") == "open", 1).otherwise(0)
    ends = significant.where("kind in ('open', 'close')").select("file", "at", inner.alias("inner"), "level", F.col("kind").alias("role"), F.lit(False).alias("keyed"))
    w = Window.partitionBy("file", "inner", "level").orderBy("at")
    running = lambda c: F.sum((c & (F.col("role") == "argument")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = argument.unionByName(ends).withColumns({"plain": running(~F.col("keyed")), "keys": running(F.col("keyed"))}).where("role <> 'argument'")
    count = F.lead("plain").over(w) - F.col("plain") + F.when(F.lead("keys").over(w) > F.col("keys"), 1).otherwise(0)
    return both.withColumns({"arity": count.cast("long"), "close_at": F.lead("at").over(w)}).where("role = 'open'").select("file", "at", "arity", "close_at")
