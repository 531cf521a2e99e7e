"""Function signatures by regex, one plan for each language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elixir

# Shapes of a definition: group 1 is the name, group 2 the arguments.
SHAPES = {
    "python": r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)[ \t]*\(([^)]*)\)",
    "elixir": r"(?m)^[ \t]*defp?[ \t]+([a-z_]\w*[?!]?)(?:\(([^)]*)\))?",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+)?fn[ \t]+([A-Za-z_]\w*)(?:<[^>]*>)?[ \t]*\(([^)]*)\)",
}


def scan(files: DataFrame, source: str, language: str) -> DataFrame:
    """All columns but the source, with name and arity of every definition; a Rust receiver is no argument."""
    shape = SHAPES[language]
    found = F.arrays_zip(F.regexp_extract_all(source, F.lit(shape), F.lit(1)).alias("name"), F.regexp_extract_all(source, F.lit(shape), F.lit(2)).alias("args"))
    rows = files.withColumn("_f", F.explode(found)).select(*[c for c in files.columns if c != source], F.col("_f.name").alias("name"), F.col("_f.args").alias("_args"))
    args = F.filter(F.split(F.coalesce("_args", F.lit("")), ","), lambda a: F.trim(a) != "")
    if language == "rust":
        args = F.filter(args, lambda a: ~F.trim(a).rlike(r"^(&\s*)?('\w+\s+)?(mut\s+)?self\b"))
    return rows.withColumn("arity", F.size(args).cast("bigint")).drop("_args")


def elixir_scopes(lines: DataFrame) -> DataFrame:
    """(file, module, name, arity, line) of Elixir definitions from lines(file, line, text), with the innermost module around each."""
    return elixir.functions(elixir.sources_of(lines)).select("file", "module", "name", "arity", "line")


def elixir_references(lines: DataFrame) -> DataFrame:
    """(file, kind, target, name) of alias, import, require, use and behaviour lines; ``A.{B, C}`` gives a row each."""
    shape = r"^\s*(alias|import|require|use|@behaviour)\s+([A-Z]\w*(?:\.\w+)*)(\.\{([^}]*)\})?(?:\s*,\s*as:\s*([A-Z]\w*))?"
    part = lambda k: F.regexp_extract("text", shape, k)
    rows = lines.where(F.col("text").rlike(shape)).select("file", "line", part(1).alias("kind"), part(2).alias("base"), part(4).alias("inner"), part(5).alias("as"))
    many = F.transform(F.split("inner", ","), lambda x: F.concat(F.col("base"), F.lit("."), F.trim(x)))
    rows = rows.withColumn("target", F.explode(F.when(F.col("inner") != "", many).otherwise(F.array("base"))))
    name = F.when(F.col("as") != "", F.col("as")).otherwise(F.element_at(F.split("target", r"\."), -1))
    return rows.select("file", "line", F.regexp_replace("kind", "^@", "").alias("kind"), "target", name.alias("name"))


def elixir_calls(lines: DataFrame) -> DataFrame:
    """(file, line, module, function, arity) of calls; module is null for local ones. Attributes and definitions are skipped."""
    return elixir.calls(elixir.sources_of(lines)).select("file", "line", "module", "function", "arity")
