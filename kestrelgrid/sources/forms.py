"""Erlang forms and Gleam functions by structure: tokens, form ends and brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .structure import arguments, cut, in_file, located

#: Every character belongs to one token. A dot ends a form if white space, a comment or nothing follows it.
ERLANG = "|".join(
    [
        r"%[^\n]*+",
        r'"(?:\\[\s\S]|[^"\\])*+"',
        r"'(?:\\[\s\S]|[^'\\])*+'",
        r"\$(?:\\(?:x\{[0-9a-fA-F]+\}|\^.|[\s\S])|[\s\S])",
        r"[0-9]++(?:#[0-9a-zA-Z]++)?(?:\.[0-9]++(?:[eE][+-]?[0-9]++)?)?",
        r"[\p{L}_][\w@]*+",
        r"<<|>>|->|\|\||=>|:=|::",
        r"\.(?=\s|%|\z)",
        r"\n",
        r"[ \t\r\f]++",
        r"[\s\S]",
    ]
)
GLEAM = "|".join([r"//[^\n]*+", r'"(?:\\[\s\S]|[^"\\])*+"', r"[\p{L}_]\w*+", r"[0-9][\w.]*+", r"<<|>>|->|<-|\|>|\.\.", r"\n", r"[ \t\r\f]++", r"[\s\S]"])
# What opens a block that ``end`` closes.
ERLANG_BLOCKS = ("case", "if", "receive", "begin", "try", "maybe")


def _kind(comment: str) -> Column:
    def kind(t: Column) -> Column:
        return (
            F.when(t == "\n", "line")
            .when(t.rlike(r"^[ \t\r\f]+$"), "space")
            .when(t.startswith(comment), "comment")
            .when(t.rlike("^\""), "string")
            .when(t.rlike(r"^(?:[\p{Ll}]|'.)"), "name")
            .when(t.rlike(r"^[\p{L}_]"), "variable")
            .when(t.rlike("^[0-9]"), "number")
            .when(t.isin("(", "[", "{", "<<"), "open")
            .when(t.isin(")", "]", "}", ">>"), "close")
            .otherwise("sign")
        )

    return kind


def _leading(everything: DataFrame, marker: str) -> DataFrame:
    """(file, at, doc lines) of the comment lines right above each token that begins a line: array of (line, text) in order.

    A run of comment lines ends where a line has none; the token stands on the next line.
    """
    said = everything.where((F.col("kind") == "comment") & F.col("text").rlike(marker) & (F.coalesce(F.col("comes"), F.lit("\n")).rlike(r"^\s")))
    island = F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line"))
    blocks = said.select("file", "line", "text").withColumn("island", island).groupBy("file", "island")
    blocks = blocks.agg((F.max("line") + 1).alias("line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    first = everything.where("kind not in ('space', 'line', 'comment')").groupBy("file", "line").agg(F.min("at").alias("at"))
    return blocks.join(first, ["file", "line"]).select("file", "at", F.transform("lines", lambda x: x["text"]).alias("lines"))


def edoc(lines: Column) -> Column:
    """struct<doc, params, returns, private> of the comment lines of a block.

    Text behind @doc goes on until the next tag; @param and @return(s) have one line
    each; @private and @hidden mark what isn't documented.
    """
    plain = F.transform(lines, lambda x: F.regexp_replace(x, r"^%+\s*", ""))
    tag = lambda x: F.regexp_extract(x, r"^@(\w+)", 1)
    # the tag that holds at each line: its own, or the last one before that opens or closes the text
    started = F.transform(plain, lambda x, k: F.try_element_at(F.filter(F.transform(F.slice(plain, F.lit(1), k + 1), tag), lambda t: (t != "") & ~t.isin("param", "return", "returns")), F.lit(-1)))
    said = F.filter(F.arrays_zip(plain.alias("x"), started.alias("t")), lambda z: (F.coalesce(z["t"], F.lit("")) == "doc") & ~z["x"].rlike(r"^@(?!doc\b)"))
    text = F.trim(F.array_join(F.filter(F.transform(said, lambda z: F.trim(F.regexp_replace(z["x"], r"^@doc\b", ""))), lambda x: x != ""), " "))
    param = F.filter(plain, lambda x: x.rlike(r"^@param\s+\w+"))
    params = F.transform(param, lambda x: F.struct(F.regexp_extract(x, r"^@param\s+(\w+)", 1).alias("name"), F.trim(F.regexp_extract(x, r"^@param\s+\w+\s*(.*)$", 1)).alias("desc")))
    returns = F.try_element_at(F.filter(plain, lambda x: x.rlike(r"^@returns?\b")), F.lit(-1))
    hidden = F.exists(plain, lambda x: x.rlike(r"^@(private|hidden)\b"))
    return F.struct(F.nullif(text, F.lit("")).alias("doc"), params.alias("params"), F.trim(F.regexp_replace(returns, r"^@returns?\s*", "")).alias("returns"), hidden.alias("private"))


def erlang_forms(files: DataFrame) -> DataFrame:
    """The tokens of files(file, source) with ``form``, the number of the form that each is in, line ends left out."""

    def step(text: Column, kind: Column, comes: Column) -> Column:
        return F.when((kind == "name") & text.isin(*ERLANG_BLOCKS), 1).when((kind == "name") & (text == "end"), -1).otherwise(0)

    t = cut(files, ERLANG, _kind("%"), step).where("kind <> 'line'")
    # fun(...) opens a block, fun name/1 doesn't
    near = {"before": F.lag("text").over(in_file()), "after": F.lead("text").over(in_file()), "after_kind": F.lead("kind").over(in_file())}
    t = t.withColumns(near)
    # a name such as a record field or an atom of a pair isn't a word of a block in brackets of a type; fun with a clause is
    fun = (F.col("text") == "fun") & (F.col("kind") == "name") & ((F.col("after") == "(") | ((F.col("after_kind") == "variable") & (F.lead("text", 2).over(in_file()) == "(")))
    earlier = in_file().rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("step", F.when(fun, 1).otherwise(F.col("step")))
    ends = F.coalesce(F.sum(((F.col("text") == ".") & (F.col("kind") == "sign") & (F.col("depth") == 0)).cast("int")).over(earlier), F.lit(0))
    t = t.withColumn("form", ends)
    in_form = Window.partitionBy("file", "form").orderBy("at")
    # levels begin anew in each form, and types have funs without an end
    attribute = F.first("text").over(in_form) == "-"
    level = F.coalesce(F.sum(F.when(~attribute, F.col("step")).otherwise(0)).over(in_form.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumns({"level": level, "place": F.row_number().over(in_form)})


def erlang_functions(files: DataFrame) -> DataFrame:
    """(file, module, name, arity, line, ftype, clauses, doc, params, returns, private) of files(file, source), one row a function.

    Public are the functions of the export lists, over any number of lines, and all
    with -compile(export_all). The comment block stands above the first clause or
    above the -spec before it.
    """
    t = written(erlang_forms(files))
    sizes = arguments(t).select("file", "at", "arity")
    heads = t.where("place = 1").select("file", "form", "at", "line", F.col("kind").alias("head"), F.col("text").alias("name"), F.col("after").alias("next"), F.lead("at").over(in_file()).alias("_"))
    opens = t.where("place = 2").select("file", "form", F.col("at").alias("open_at"), F.col("text").alias("second"))
    heads = heads.drop("_").join(opens, ["file", "form"], "left")
    attributes = heads.where("name = '-'").select("file", "form", "at", F.col("second").alias("attribute"))
    words = t.join(attributes.drop("at"), ["file", "form"])
    module = words.where("attribute = 'module' and place = 4").groupBy("file").agg(F.min("text").alias("module"))
    three = {"slash": F.lead("text", 1).over(in_file()), "number": F.lead("text", 2).over(in_file())}
    exported = words.withColumns(three).where("attribute = 'export' and slash = '/' and kind = 'name'").select("file", F.col("text").alias("name"), F.col("number").cast("long").alias("arity")).distinct().withColumn("listed", F.lit(True))
    everything = words.where("attribute = 'compile' and text = 'export_all'").select("file").distinct().withColumn("open", F.lit(True))
    # a semicolon may also stand in a guard
    clauses = t.where("level = 0 and depth = 0 and text = ';'").join(heads.select("file", "form", "name"), ["file", "form"]).where("after = name").groupBy("file", "form").agg(F.count("*").alias("more"))
    docs = _leading(located(files, ERLANG, _kind("%")), "^%")
    # a block above a -spec is the function's
    specs = attributes.where("attribute = 'spec'").select("file", "at", (F.col("form") + 1).alias("form"))
    above = docs.join(specs, ["file", "at"]).select("file", "form", F.col("lines").alias("spec_lines"))
    f = heads.where("head = 'name' and second = '('").join(sizes.withColumnRenamed("at", "open_at"), ["file", "open_at"], "left")
    f = f.join(docs, ["file", "at"], "left").join(above, ["file", "form"], "left").join(clauses, ["file", "form"], "left").withColumn("e", edoc(F.coalesce("lines", "spec_lines")))
    f = f.join(module, "file", "left").join(exported, ["file", "name", "arity"], "left").join(everything, "file", "left")
    f = f.select("file", "module", F.regexp_replace("name", "^'|'$", "").alias("name"), "arity", "line", F.when(F.coalesce("listed", "open", F.lit(False)), "def").otherwise("defp").alias("ftype"), (F.coalesce("more", F.lit(0)) + 1).alias("clauses"), "e.doc", "e.params", "e.returns", F.coalesce("e.private", F.lit(False)).alias("private"))
    # what conditional parts of a file define twice is its first
    first = Window.partitionBy("file", "name", "arity").orderBy("line")
    return f.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def gleam_functions(files: DataFrame) -> DataFrame:
    """(file, module, name, arity, line, ftype, doc) of files(file, source), heads over any number of lines; the module is the path below src or test."""
    t = written(cut(files, GLEAM, _kind("//"), lambda text, kind, comes: F.lit(0)).where("kind <> 'line'").withColumns({"before": F.lag("text").over(in_file())}))
    near = t.withColumns({"name": F.lead("text").over(in_file()), "name_kind": F.lead("kind").over(in_file()), "open_at": F.lead("at", 2).over(in_file()), "open": F.lead("text", 2).over(in_file()), "pub_at": F.lag("at").over(in_file())})
    f = near.where("text = 'fn' and kind = 'name' and depth = 0 and open = '(' and name_kind in ('name', 'variable')")
    is_public = F.coalesce(F.col("before") == "pub", F.lit(False))
    f = f.withColumns({"public": is_public, "first_at": F.when(is_public, F.col("pub_at")).otherwise(F.col("at"))})
    f = f.join(arguments(t).select("file", F.col("at").alias("open_at"), "arity"), ["file", "open_at"], "left")
    docs = _leading(located(files, GLEAM, _kind("//")), "^///(?!/)").select("file", F.col("at").alias("first_at"), F.array_join(F.transform("lines", lambda x: F.regexp_replace(x, r"^///\s?", "")), "\n").alias("doc"))
    module = F.regexp_replace(F.regexp_replace("file", r"^(.*/)?(src|test)/", ""), r"\.gleam$", "")
    return f.join(docs, ["file", "first_at"], "left").select("file", module.alias("module"), "name", "arity", "line", F.when(F.col("public"), "def").otherwise("defp").alias("ftype"), "doc")
