"""Code intelligence protocol files: the wire format as occurrence rows, then joins.

Only the decoding of a file's bytes is Python, one file a row; definitions, call
sites, enclosing functions, arities and reverse calls are DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof

OCCURRENCES = "file string, symbol string, roles int, start_line int, end_line int"
#: Roles are bits; the lowest marks a definition.
DEFINITION, IMPORT = 1, 2
# Numbers of the protocol's kinds of symbols, and what modules of these kinds are called.
KINDS = {7: "class", 21: "interface", 55: "type_alias", 54: "type_alias", 29: "module", 49: "struct", 11: "enum", 53: "trait"}
# Modules that are no dependencies.
BUILTIN_MODULES = ("builtins", "__builtins__", "__future__", "sys", "os")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; length-delimited values as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _numbers(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        v, at = _varint(value, at)
        out.append(v)
    return out


def decode(content: bytes) -> list[tuple[str, str, int, int, int]]:
    """Occurrences of an index: documents are field 2; in them path 1 and occurrences 2 (range 1, symbol 2, roles 3, enclosing range 7)."""
    rows = []
    for number, doc in fields(content):
        if number != 2:
            continue
        parts = list(fields(doc))
        path = next((v.decode() for k, v in parts if k == 1), "")
        for k, occurrence in parts:
            if k != 2:
                continue
            place, around, symbol, roles = [], [], "", 0
            for f, v in fields(occurrence):
                if f == 1:
                    place += _numbers(v)
                elif f == 2:
                    symbol = v.decode()
                elif f == 3:
                    roles = v
                elif f == 7:
                    around += _numbers(v)
            if place:
                last = around[2] if len(around) == 4 else around[0] if around else place[0]
                rows.append((path, symbol, roles, place[0] + 1, last + 1))
    return rows


def described(content: bytes) -> list[tuple[str, str, str, int]]:
    """(path, symbol, text, kind) of the symbol descriptions of an index: field 3 of documents, with symbol 1, paragraphs 3 and kind 5."""
    rows = []
    for number, doc in fields(content):
        if number != 2:
            continue
        parts = list(fields(doc))
        path = next((v.decode() for k, v in parts if k == 1), "")
        for k, info in parts:
            if k == 3:
                said = list(fields(info))
                symbol = next((v.decode() for f, v in said if f == 1), "")
                kind = next((v for f, v in said if f == 5), 0)
                rows.append((path, symbol, "\n".join(v.decode() for f, v in said if f == 3), kind))
    return rows


def language_of(content: bytes) -> str:
    """The language of the first document that names one (field 4), else what the tool's name (fields 1, 2, 1) says, else unknown."""
    tool = ""
    for number, part in fields(content):
        if number == 2:
            named = next((v.decode() for k, v in fields(part) if k == 4), "")
            if named:
                return named
        elif number == 1:
            about = next((v for k, v in fields(part) if k == 2), b"")
            tool = next((v.decode() for k, v in fields(about) if k == 1), "")
    return tool.removeprefix("scip-") or "unknown"


def languages(files: DataFrame) -> DataFrame:
    """files with the column content in exchange for ``language``."""

    @F.pandas_udf("string")
    def language(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: language_of(bytes(c)))

    return files.withColumn("language", language("content")).drop("content")


def descriptions(files: DataFrame) -> DataFrame:
    """(file, symbol, documentation, kind) rows of files(content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for c in pdf["content"] for r in described(bytes(c))], columns=["file", "symbol", "documentation", "kind"])

    return files.select("content").mapInPandas(run, "file string, symbol string, documentation string, kind int")


def occurrences(files: DataFrame) -> DataFrame:
    """Occurrence rows of files(content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for c in pdf["content"] for r in decode(bytes(c))], columns=["file", "symbol", "roles", "start_line", "end_line"])

    return files.select("content").mapInPandas(run, OCCURRENCES)


#: References above this line of a file count as its imports.
IMPORT_LINES = 50


def convert(rows: DataFrame, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of an index from occurrences: modules, definitions, functions (with arity), calls, imports and reverse calls.

    A call belongs to the smallest function around it. Imports are modules other
    than those a file defines that are marked as such or named in its first
    lines, without built-in ones. ``docs``: descriptions, joined to functions; the
    fenced part of one is its signature. Classes and other types are a table of
    their own, with what they are, their description and their methods.
    """
    parts = T.symbol_parts(F.col("symbol"))
    is_definition = F.col("roles").bitwiseAND(DEFINITION) > 0
    is_parameter = F.col("symbol").rlike(r"\(\)\.\([^)]*\)$")
    defined = rows.where(is_definition & ~is_parameter).select("file", "symbol", "start_line", "end_line", *[parts[c].alias(c) for c in ("module", "parent", "name", "kind", "private")])
    parameters = rows.where(is_definition & is_parameter).select(F.regexp_replace("symbol", r"\([^)]*\)$", "").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("arity"))
    functions = defined.where(F.col("kind").isin("function", "method")).join(parameters, "symbol", "left").withColumn("arity", F.coalesce("arity", F.lit(0)))
    if docs is not None:
        told = docs.groupBy("symbol").agg(F.max("documentation").alias("_said"))
        fence = r"(?s)```\w*\n(.*?)\n?```"
        functions = functions.join(told, "symbol", "left").withColumns({
            "signature": F.nullif(F.regexp_replace(F.regexp_extract("_said", fence, 1), r"^\s+|\s+$", ""), F.lit("")),
            "doc": F.nullif(F.regexp_replace(F.regexp_replace("_said", fence, ""), r"^\s+|\s+$", ""), F.lit("")),
        }).drop("_said")
    used = rows.where(~is_definition & F.col("symbol").endswith("().")).select("file", F.col("symbol").alias("callee"), F.col("start_line").alias("line")).distinct()
    ranges = functions.select("file", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), "symbol")
    calls = asof.enclosing(used, ranges, ["file"], "line").withColumnRenamed("symbol", "caller").where("caller <> callee")
    # one row a call, in ranges of the whole row, however often one symbol is called
    reverse = calls.select("callee", "caller", "file", "line").repartitionByRange("callee", "caller", "file", "line").sortWithinPartitions("callee", "caller", "file", "line")
    own = defined.select("file", "module").where("module is not null").distinct()
    named = rows.where(~is_definition & ((F.col("roles").bitwiseAND(IMPORT) > 0) | (F.col("start_line") <= IMPORT_LINES))).select("file", parts["module"].alias("module"))
    imports = named.where(F.col("module").isNotNull() & ~F.col("module").isin(*BUILTIN_MODULES)).distinct().join(own, ["file", "module"], "left_anti")
    counts = functions.groupBy("file", "module").agg(F.count("*").alias("functions"), F.count_if(~F.col("private")).alias("public"), F.min("start_line").alias("line"))
    modules = own.join(counts, ["file", "module"], "left").na.fill(0, ["functions", "public"])
    return {"classes": classes(defined, docs), "modules": modules, "definitions": defined, "functions": functions, "calls": calls, "imports": imports, "reverse_calls": reverse}


def classes(defined: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(file, symbol, module, name, line, kind, moduledoc, methods, public) of the types among definitions.

    What a type is says its description's kind, else the fenced declaration in its
    description, else it is a class. Methods are the definitions inside it.
    """
    types = defined.where("kind = 'class'").select("file", "symbol", "module", "name", F.col("start_line").alias("line"))
    inside = defined.where("kind = 'method'").groupBy("file", "module", F.col("parent").alias("name")).agg(F.count("*").alias("methods"), F.count_if(~F.col("private")).alias("public"))
    out = types.join(inside, ["file", "module", "name"], "left").na.fill(0, ["methods", "public"])
    if docs is None:
        return out.select("file", "symbol", "module", "name", "line", F.lit("class").alias("kind"), F.lit(None).cast("string").alias("moduledoc"), "methods", "public")
    told = docs.groupBy("symbol").agg(F.max("documentation").alias("moduledoc"), F.max("kind").alias("number"))
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    fence = F.regexp_extract("moduledoc", r"(?s)```\w*\n(.*?)\n?```", 1)
    declared = F.when(fence != "", F.regexp_replace(T.fence_kind(fence), "^type$", "type_alias"))
    kind = F.coalesce(F.try_element_at(known, F.col("number")), declared, F.lit("class"))
    return out.join(told, "symbol", "left").select("file", "symbol", "module", "name", "line", kind.alias("kind"), F.nullif("moduledoc", F.lit("")).alias("moduledoc"), "methods", "public")
