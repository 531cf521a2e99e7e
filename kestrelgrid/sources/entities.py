"""Entities of Elixir, Erlang and Gleam sources from lines(file, line, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof
from . import elixir, forms
from .signatures import elixir_references


def _in_file():
    return Window.partitionBy("file").orderBy("line")


def _group(shape: str, k: int, text: str = "text") -> Column:
    return F.nullif(F.regexp_extract(text, shape, k), F.lit(""))


def doc_blocks(lines: DataFrame) -> DataFrame:
    """(file, attr, line, end_line, doc) of @moduledoc and @doc, on one line or between triple quotes."""
    opens = _group(r'^\s*@(moduledoc|doc)\s+(?:~[sS])?"""', 1)
    inside = F.sum(F.col("text").contains('"""').cast("int")).over(_in_file())
    rows = lines.withColumns({"opens": opens, "quotes": inside}).withColumn("attr", F.when(F.col("quotes") % 2 == 1, F.last("opens", ignorenulls=True).over(_in_file())))
    block = F.max(F.when(F.col("opens").isNotNull(), F.col("line"))).over(_in_file())
    body = rows.withColumn("block", block).where("attr is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens").isNull(), F.struct("line", "text")))), lambda x: F.trim(x["text"])), "\n")
    long = body.groupBy("file", "attr", F.col("block").alias("line")).agg((F.max("line") + 1).alias("end_line"), text.alias("doc"))
    short = r'^\s*@(moduledoc|doc)\s+"([^"]+)"\s*$'
    brief = lines.where(F.col("text").rlike(short)).select("file", _group(short, 1).alias("attr"), "line", F.col("line").alias("end_line"), _group(short, 2).alias("doc"))
    return long.select("file", "attr", "line", "end_line", "doc").unionByName(brief)


def split_examples(doc: Column) -> Column:
    """struct<doc, examples>: the part under an Examples heading apart from the rest."""
    at = F.regexp_instr(doc, F.lit(r"(?m)^##? Examples?\s*$"))
    rest = F.regexp_replace(F.substring(doc, at, F.length(doc)), r"^##? Examples?\s*\n?", "")
    return F.struct(F.trim(F.when(at > 0, F.substring(doc, F.lit(1), at - 1)).otherwise(doc)).alias("doc"), F.when(at > 0, F.trim(rest)).alias("examples"))


def elixir_modules(lines: DataFrame) -> DataFrame:
    """(file, module, line, moduledoc) by structure, see ``elixir.modules``."""
    return elixir.modules(elixir.sources_of(lines)).select("file", "module", "line", "moduledoc")


def elixir_functions(lines: DataFrame) -> DataFrame:
    """(file, module, name, arity, line, ftype, guards, impl, spec, doc) by structure, see ``elixir.functions``."""
    return elixir.functions(elixir.sources_of(lines)).drop("module_at", "at", "end_at")


def elixir_value_mentions(lines: DataFrame) -> DataFrame:
    """(file, target): module names used as values: not before a dot, nor in references and definitions."""
    code = lines.where(~F.col("text").rlike(r"^\s*(#|alias|import|require|use|@|defmodule)"))
    docs = doc_blocks(lines).select("file", F.explode(F.sequence("line", "end_line")).alias("line"))
    code = code.join(docs, ["file", "line"], "left_anti")
    names = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\w.%])([A-Z]\w*(?:\.[A-Z]\w*)*)(?![\w.({])"), F.lit(1)))
    return code.select("file", names.alias("target")).distinct()


def elixir_literals(lines: DataFrame) -> DataFrame:
    """(file, function, kind, text, line) of strings outside docs and of comments, with the enclosing function of strings and the next one of comments."""
    files = elixir.sources_of(lines)
    strings = elixir.literals(files).withColumnRenamed("text", "literal").withColumn("kind", F.lit("string"))
    named = elixir.functions(files).select("file", "line", F.concat("name", F.lit("/"), F.col("arity").cast("string")).alias("function"))
    comment = r"^\s*#\s?(.*)$"
    comments = asof.adjacent(lines.where(F.col("text").rlike(comment)), ["file"], "line")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.regexp_extract("text", comment, 1).alias("t")))), lambda x: x["t"]), "\n")
    comments = comments.groupBy("file", "island").agg(F.min("line").alias("line"), body.alias("literal")).drop("island")
    comments = asof.asof(comments, named, ["file"], "line", ["function"], forward=True).withColumn("kind", F.lit("comment"))
    columns = ["file", "function", "kind", F.col("literal").alias("text"), "line"]
    return strings.select(*columns).unionByName(comments.select(*columns))


def erlang_functions(lines: DataFrame) -> DataFrame:
    """(file, module, name, arity, line, ftype, clauses, doc, params, returns, private) by forms, see ``forms.erlang_functions``."""
    return forms.erlang_functions(elixir.sources_of(lines))


def gleam_functions(lines: DataFrame) -> DataFrame:
    """(file, module, name, arity, line, ftype, doc); the module is the path below src or test."""
    return forms.gleam_functions(elixir.sources_of(lines))


def references(lines: DataFrame) -> DataFrame:
    """(module, kind, target): references of each Elixir module."""
    t = elixir.tokens(elixir.sources_of(lines))
    first = t.where("kind <> 'line'").groupBy("file", "line").agg(F.min("at").alias("at"))
    scope = elixir.in_scope(first, elixir.scopes(elixir.definitions(None, t))).select("file", F.col("line").cast("long").alias("line"), "module")
    mentions = elixir_value_mentions(lines).join(scope.groupBy("file").agg(F.first("module", ignorenulls=True).alias("module")), "file").select("module", F.lit("value_mention").alias("kind"), "target")
    return elixir_references(lines).join(scope, ["file", "line"]).select("module", "kind", "target").unionByName(mentions)
