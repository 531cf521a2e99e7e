"""The nested code index as normalised tables, and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = "struct<module string, `function` string, arity int, line int>"
FUNCTION = "struct<name string, arity int, args array<string>, type string, line int, signature string, doc string, keywords map<string,double>>"
MODULE = f"struct<file string, line int, moduledoc string, functions array<{FUNCTION}>, calls array<{CALL}>, aliases map<string,string>, imports array<string>, requires array<string>, uses array<string>, behaviours array<string>, value_mentions array<string>, keywords map<string,double>>"
INDEX = f"modules map<string, {MODULE}>, metadata struct<total_modules int, repo_path string>"


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """modules, functions, calls, aliases, module_refs and entity_keywords of an index document; no inference."""
    m = spark.read.schema(INDEX).json(path, multiLine=True).select(F.explode("modules").alias("module", "m"))
    refs = [m.select("module", F.lit(k).alias("kind"), F.explode(f"m.{c}").alias("target")) for k, c in (("import", "imports"), ("require", "requires"), ("use", "uses"), ("behaviour", "behaviours"), ("value_mention", "value_mentions"))]
    refs.append(m.select("module", F.lit("alias").alias("kind"), F.explode(F.map_values("m.aliases")).alias("target")))
    f = m.select("module", F.explode("m.functions").alias("f"))
    own = m.select(F.lit("module").alias("entity_type"), F.col("module").alias("entity"), "module", F.explode("m.keywords").alias("kw", "weight"))
    inner = f.select(F.lit("function").alias("entity_type"), F.concat("module", F.lit("."), "f.name", F.lit("/"), F.col("f.arity").cast("string")).alias("entity"), "module", F.explode("f.keywords").alias("kw", "weight"))
    return {
        "modules": m.select("module", "m.file", "m.line", "m.moduledoc"),
        "functions": f.select("module", "f.*").drop("keywords").withColumnRenamed("type", "ftype"),
        "calls": m.select(F.col("module").alias("caller_module"), F.col("m.file").alias("caller_file"), F.explode("m.calls").alias("c")).select("caller_module", "caller_file", F.col("c.module").alias("callee_module"), F.col("c.function").alias("callee"), "c.arity", "c.line"),
        "aliases": m.select("module", F.explode("m.aliases").alias("alias", "target")),
        "module_refs": reduce(DataFrame.unionByName, refs),
        "entity_keywords": own.unionByName(inner),
    }


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each relation."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: tuple[str, ...] = ("modules", "functions", "calls", "aliases", "module_refs", "entity_keywords")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def violations(table: DataFrame, id_column: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, id) for every row and rule that it breaks; a null verdict breaks the rule. One scan."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return table.select(F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"), F.col(id_column).alias("id"))


def strict_rules() -> dict[str, Column]:
    """Constraints of functions: arity is the number of arguments and not negative, lines are positive."""
    return {"arity_args": F.col("args").isNull() | (F.size("args") == F.col("arity")), "arity": F.col("arity") >= 0, "line": F.col("line") > 0, "name": F.length("name") > 0}
