"""What enrichment reads, for each language: entities(entity, name, doc) and literals(entity, kind, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof
from . import elixir as X
from . import forms, parsers, scip
from .shared import written
from .structure import located


def _entity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entity", T.canonical(F.col("module"), F.col("name"), F.col("arity")))


def elixir(files: DataFrame) -> dict[str, DataFrame]:
    """Of files(file, source): functions with their docs, strings inside them, and comments inside or right above them."""
    t = written(X.tokens(files))
    functions = written(_entity(X.functions(files)))
    entities = functions.groupBy("entity").agg(F.first("name").alias("name"), F.max("doc").alias("doc"))
    owners = functions.select("file", "line", "entity")
    strings = asof.asof(X.literals(files, t).where("function is not null").select("file", "line", "text"), owners, ["file"], "line", ["entity"])
    comments = located(files, X.TOKEN, lambda c: F.when(c.startswith("#"), "comment").otherwise("code")).where("kind = 'comment'")
    comments = comments.select("file", "line", F.regexp_replace("text", r"^#+\s*", "").alias("text"))
    above = asof.asof(comments, owners, ["file"], "line", ["entity"], forward=True)
    literals = strings.select("entity", F.lit("string").alias("kind"), "text").unionByName(above.select("entity", F.lit("comment").alias("kind"), "text"))
    return {"entities": entities, "literals": literals.where("entity is not null")}


def erlang(files: DataFrame) -> dict[str, DataFrame]:
    """Of files(file, source): functions with their edoc, parameters and returns in it, strings inside their forms."""
    functions = written(_entity(forms.erlang_functions(files)))
    told = F.concat_ws(" ", "doc", F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["name"], p["desc"])), " "), "returns")
    entities = functions.select("entity", "name", F.nullif(told, F.lit("")).alias("doc"))
    strings = forms.erlang_forms(files).where("kind = 'string'").select("file", "line", F.regexp_replace("text", "^\"|\"$", "").alias("text"))
    owned = asof.asof(strings, functions.select("file", "line", "entity"), ["file"], "line", ["entity"])
    return {"entities": entities, "literals": owned.where("entity is not null").select("entity", F.lit("string").alias("kind"), "text")}


def python(protocol_files: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Of protocol files(content) the functions with their descriptions, of sources(path, source) the strings inside them."""
    tables = scip.convert(scip.occurrences(protocol_files), scip.descriptions(protocol_files))
    functions = written(_entity(tables["functions"]))
    words = F.concat_ws(" ", "doc", F.regexp_replace("signature", r"\W+", " "))
    entities = functions.select("entity", "name", F.nullif(words, F.lit("")).alias("doc"))
    strings = parsers.python_literals(sources, "path", "source").where("function is not null").select(F.col("path").alias("file"), F.element_at(F.split("function", r"\."), -1).alias("name"), "text")
    owned = strings.join(functions.select("file", "name", "entity"), ["file", "name"])
    return {"entities": entities, "literals": owned.select("entity", F.lit("string").alias("kind"), "text")}
