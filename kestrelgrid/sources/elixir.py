"""Elixir sources by structure: tokens, blocks and brackets, and what lies in them.

``tokens`` cuts every source into tokens with one expression (strings, heredocs,
sigils and comments are one token each, so nothing inside them counts). All else
is windows over the tokens of a file, as rows or, for modules, functions and calls,
as arrays inside the file's row (``token_arrays``):

* the block level is the running number of ``do`` and ``fn`` less that of ``end``,
  the bracket depth that of opening less closing brackets;
* on one level openers and closers take turns, so what closes an opener is the
  next row of its level: no stack is carried, and nothing is joined with itself;
* a bracket's arguments are the tokens behind its opener or a comma of its own
  depth and level, with all keywords as one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .shared import written
from .structure import cut, in_file
from .token_arrays import Tokens, in_parts, key_of

# The special forms, which look like calls and are none.
SPECIAL_FORMS = ("alias", "import", "require", "use", "def", "defp", "defmodule", "if", "unless", "case", "cond", "with", "for", "try", "receive")
DEFINITIONS = ("def", "defp", "defmacro", "defmacrop")
#: Words that end an expression or stand between two.
OPERATORS = ("do", "end", "fn", "when", "and", "or", "not", "in", "else", "after", "rescue", "catch", "true", "false", "nil")

_ESCAPED = r"\\[\s\S]"
_INTERPOLATION = rf'#\{{(?:[^{{}}"]|"(?:{_ESCAPED}|[^"\\])*+"|\{{[^{{}}]*+\}})*+\}}'
#: Every character belongs to one token; loops are possessive, so that long strings need no stack.
TOKEN = "|".join(
    [
        r"#[^\n]*+",
        rf'(?:~[a-zA-Z])?"""(?:{_ESCAPED}|(?!""")[\s\S])*+"""',
        rf"(?:~[a-zA-Z])?'''(?:{_ESCAPED}|(?!''')[\s\S])*+'''",
        rf"~[a-z]+(?:\((?:{_ESCAPED}|[^)\\])*+\)|\[(?:{_ESCAPED}|[^\]\\])*+\]|\{{(?:{_ESCAPED}|[^}}\\])*+\}}|<(?:{_ESCAPED}|[^>\\])*+>|/(?:{_ESCAPED}|[^/\\])*+/|\|(?:{_ESCAPED}|[^|\\])*+\||\"(?:{_ESCAPED}|[^\"\\])*+\"|'(?:{_ESCAPED}|[^'\\])*+')[a-zA-Z]*+",
        r"~[A-Z]+(?:\([^)]*+\)|\[[^\]]*+\]|\{[^}]*+\}|<[^>]*+>|/[^/]*+/|\|[^|]*+\||\"[^\"]*+\"|'[^']*+')[a-zA-Z]*+",
        rf':?"(?:{_ESCAPED}|{_INTERPOLATION}|[^"\\])*+"(?::(?=\s))?',
        rf":?'(?:{_ESCAPED}|[^'\\])*+'",
        r"\?(?:\\.|\S)",
        r"::",
        r":[\p{L}_][\w@]*+[?!]?",
        r"[\p{L}_]\w*+[?!]?:(?=\s)",
        r"[A-Z]\w*+(?:\.[A-Z]\w*+)*+",
        r"@[a-z_]\w*+",
        r"[\p{L}_]\w*+[?!]?+",
        r"[0-9][0-9a-fA-FxobXOB_]*+(?:\.[0-9]+)?",
        r"->|\|>|<<|>>|=>|<-|\.\.\.?|\\\\|&&&?|\|\|\|?|[=!<>~+*/^|&-]++",
        r"\n",
        r"[ \t\r\f]++",
        r"[\s\S]",
    ]
)


def _kind(t: Column) -> Column:
    """What a token is, by how it begins and ends."""
    word = t.rlike(r"^[\p{Ll}_]\w*[?!]?$")
    return (
        F.when(t == "\n", "line")
        .when(t.rlike(r"^[ \t\r\f]+$"), "space")
        .when(t.startswith("#"), "comment")
        .when(t.rlike("^[A-Z]"), "alias")
        .when(t.rlike(r":$") & t.rlike(r'^[\p{L}_"]'), "key")
        .when(t.rlike(r"^:.") & ~t.startswith("::"), "atom")
        .when(t.rlike("^[\"']|^~[a-zA-Z]"), "string")
        .when(t.rlike("^@[a-z_]"), "attribute")
        .when(t.rlike(r"^[0-9]|^\?."), "number")
        .when(word & t.isin(*OPERATORS), "reserved")
        .when(word, "name")
        .when(t.isin("(", "[", "{", "<<"), "open")
        .when(t.isin(")", "]", "}", ">>"), "close")
        .otherwise("sign")
    )


def sources_of(lines: DataFrame) -> DataFrame:
    """files(file, source) of lines(file, line, text); lines that are missing are empty."""
    listed = F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text"))))
    whole = lines.groupBy("file").agg(listed.alias("l"))
    gap = lambda x, k: F.greatest(x["line"] - F.when(k == 0, 0).otherwise(F.col("l")[k - 1]["line"]), F.lit(1)).cast("int")
    return whole.select("file", F.array_join(F.transform("l", lambda x, k: F.concat(F.repeat(F.lit("\n"), gap(x, k) - 1), x["text"])), "\n").alias("source"))


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of files(file, source), see ``structure.cut``; levels are those of do, fn and end."""
    # a field named do or end opens and closes nothing
    def step(text: Column, kind: Column, comes: Column) -> Column:
        reserved = (kind == "reserved") & ~F.coalesce(comes == ".", F.lit(False))
        return F.when(reserved & text.isin("do", "fn"), 1).when(reserved & (text == "end"), -1).otherwise(0)

    return cut(files, TOKEN, _kind, step)


def _closed(rows: DataFrame, step: str, level: str) -> DataFrame:
    """Openers of a kind with ``close_at`` and ``close_pos``: on a level they and the closers take turns."""
    w = Window.partitionBy("file", "_level").orderBy("at")
    on = rows.where(F.col(step) != 0).withColumn("_level", F.col(level) + F.when(F.col(step) < 0, -1).otherwise(0))
    return on.withColumns({"close_at": F.lead("at").over(w), "close_line": F.lead("line").over(w)}).where(F.col(step) > 0).drop("_level")


def _starts(t: DataFrame) -> DataFrame:
    """Tokens with ``starts``: definitions, modules, tests and attributes that begin a statement."""
    first = F.col("before").isNull() | (F.col("before_kind") == "line") | F.col("before").isin(";", "do", "->")
    defines = (F.col("kind") == "name") & F.col("text").isin(*DEFINITIONS, "defmodule", "defprotocol", "defimpl") & (F.col("after_kind").isin("name", "alias", "reserved") | (F.col("after") == "("))
    tests = (F.col("kind") == "name") & F.col("text").isin("test", "describe") & (F.col("after_kind") == "string")
    return t.withColumn("starts", first & (defines | tests))


def definitions(files: DataFrame, t: DataFrame | None = None) -> DataFrame:
    """(file, at, line, what, name, kind, name_at, pos, body, body_pos, end_at, end_line): modules, functions and tests with the place of their ``do``.

    ``body``: do, do: or null where a head has none; ``end_at``: where its block ends, null without a block.
    """
    t = _starts(written(tokens(files)) if t is None else t)
    follow = t.withColumns({"name": F.col("after"), "name_kind": F.col("after_kind"), "name_at": F.lead("at").over(in_file())})
    blocks = _closed(t, "step", "level").where("text = 'do'").select("file", F.col("at").alias("body_at"), F.col("close_at").alias("end_at"), F.col("close_line").alias("end_line"))
    same = Window.partitionBy("file", "level", "depth").orderBy("at")
    # what follows first on the level: its own do, or the next definition where it has none
    heads = follow.where(F.col("starts") | ((F.col("text") == "do") & (F.col("step") == 1)) | (F.col("text") == "do:"))
    heads = heads.withColumns({"body": F.lead(F.when(~F.col("starts"), F.col("text"))).over(same), "body_at": F.lead(F.when(~F.col("starts"), F.col("at"))).over(same), "body_pos": F.lead(F.when(~F.col("starts"), F.col("pos"))).over(same)})
    heads = heads.where("starts").select("file", "at", "line", F.col("text").alias("what"), "name", "name_kind", "name_at", "pos", "level", "depth", "body", "body_at", "body_pos")
    return heads.join(blocks, ["file", "body_at"], "left")


def scopes(defined: DataFrame) -> DataFrame:
    """(file, at, end_at, module): the blocks of modules, named as written; one that nothing closes lasts to the file's end."""
    m = defined.where("what in ('defmodule', 'defprotocol', 'defimpl') and name_kind = 'alias' and body = 'do'")
    return m.select("file", "at", F.coalesce("end_at", F.lit(2**31 - 1)).alias("end_at"), F.col("name").alias("module"))


def in_scope(rows: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows(file, at, ...) with ``module``, the innermost one around ``at``, and ``module_at``, where that begins.

    With c modules open, the innermost one is the last that began as the c-th.
    """
    named = F.struct("module", F.col("at").alias("module_at")).alias("_m")
    begins = modules.select("file", "at", named, F.lit(1).alias("_delta"))
    ends = modules.select("file", F.col("end_at").alias("at"), F.lit(-1).alias("_delta"))
    both = rows.withColumns({"_delta": F.lit(0), "_row": F.lit(True)})
    both = both.unionByName(begins, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    order = [F.col("at"), F.abs("_delta")]  # a module isn't in itself
    opened = F.coalesce(F.sum("_delta").over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumn("_nth", opened + F.when(F.col("_delta") == 1, 1).otherwise(0))
    innermost = F.last("_m", ignorenulls=True).over(Window.partitionBy("file", "_nth").orderBy(*order))
    around = both.withColumn("_m", F.when(F.col("_nth") > 0, innermost)).where("_row")
    return around.withColumns({"module": F.col("_m.module"), "module_at": F.col("_m.module_at")}).drop("_m", "_nth", "_delta", "_row")


def _found(files: DataFrame, of: Callable[[Tokens], tuple[np.ndarray, list]], shape: str, then: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(file, ...) of what ``of`` finds in the tokens of each file: their places and the fields of ``shape``. ``then`` sees the source beside it.

    Tokens stay in the row of their file, which keeps its partition.
    """
    kind = to_arrow_type(DataType.fromDDL(shape))

    def rows(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
        t = Tokens(lists, OPERATORS)
        places, fields = of(t)
        return t.file[places], pa.StructArray.from_arrays([pa.array(x).cast(f.type) for x, f in zip(fields, kind, strict=True)], fields=list(kind))

    @F.arrow_udf(f"array<{shape}>")
    def scan(lists: pa.Array) -> pa.Array:
        return in_parts(lists, rows, kind)

    found = files.select("file", "source", scan(F.regexp_extract_all("source", F.lit(TOKEN), F.lit(0))).alias("_found"))
    # a plain explode would add a filter that scans anew
    return found.select("file", F.explode_outer(then(F.col("_found"))).alias("_f")).where("_f is not null").select("file", "_f.*")


def _functions_of(t: Tokens) -> tuple[np.ndarray, list]:
    starts = t.starts(DEFINITIONS)
    head, body, end = t.heads(starts)
    name = t.after[head]
    wanted = (t.text(*DEFINITIONS, at=head) & t.kind("name", "reserved", at=name) & ~t.text("unquote", at=name)) | t.text("test", at=head)
    places, body, end, name = head[wanted], body[wanted], end[wanted], name[wanted]
    bracket = t.kind("name", "reserved", at=name) & t.text("(", at=t.after[name]) & t.touches[name]
    arity = np.where(bracket, np.append(t.arity(), -1)[np.where(bracket, t.after[name], -1)], -1)
    # the first guard behind the head on its level and depth
    both = np.union1d(places, np.flatnonzero(t.text("when") & t.kind("reserved")))
    guard = t.following(both, t.level[both], t.depth[both])[np.searchsorted(both, places)]
    guard = np.where((guard >= 0) & (guard < body) & ~np.append(starts, False)[guard], guard, -1)
    # attributes between a definition and the one before it
    earlier = lambda mark: np.append(-1, np.maximum.accumulate(np.where(mark, t.places, -1)))[places]
    since = np.maximum(earlier(starts), t.begin[places] - 1)
    own = {a: np.where((x := earlier(t.text(a) & t.kind("attribute"))) > since, x, -1) for a in ("@impl", "@spec", "@doc")}
    value = {a: np.append(t.after, -1)[x] for a, x in own.items()}
    module = t.around(places, *t.heads(starts))
    at = lambda x: t.values(t.at, x)
    return places, [
        at(places), t.line[places], t.strings(t.code[places]), t.strings(t.codes(name)), pa.array(arity, mask=arity < 0), at(end),
        t.values(t.pos, guard), t.values(t.pos, body), (own["@impl"] >= 0) & ~t.text("false", at=value["@impl"]), t.values(t.pos, value["@spec"]),
        t.strings(np.where(t.kind("string", at=value["@doc"]), t.codes(value["@doc"]), -1)), t.strings(t.codes(np.append(t.after, -1)[module])), at(module),
    ]


def functions(files: DataFrame) -> DataFrame:
    """(file, module, module_at, name, arity, line, ftype, guards, impl, spec, doc, at, end_at) of definitions and tests (``test: ...``, private)."""
    shape = "struct<at:int,line:bigint,what:string,name:string,arity:bigint,end_at:int,when_pos:bigint,body_pos:bigint,impl:boolean,spec_pos:bigint,doc:string,module:string,module_at:int>"

    def texts(x: Column) -> Column:
        guard = F.regexp_replace(F.trim(F.substring("source", (x["when_pos"] + 5).cast("int"), (x["body_pos"] - x["when_pos"] - 4).cast("int"))), r"\s*,\s*$", "")
        # a type may go on in the next line, after or before a sign
        rest = F.substring("source", (x["spec_pos"] + 1).cast("int"), F.length("source"))
        spec = F.regexp_replace(F.regexp_extract(rest, r"^[^\n]*+(?:(?<=[,|(:>\[{])[ \t]*+\n[^\n]*+|\n[ \t]*+(?:::|\||->|when\b|[)\]}])[^\n]*+)*+", 0), r"\s+", " ")
        return F.struct(x.alias("f"), F.when(x["when_pos"].isNotNull(), guard).alias("guards"), F.when(x["spec_pos"].isNotNull(), F.trim(spec)).alias("spec"))

    rows = _found(files, _functions_of, shape, lambda found: F.transform(found, texts)).select("file", "f.*", "guards", "spec")
    is_test = F.col("what") == "test"
    name = F.when(is_test, F.concat(F.lit("test: "), F.regexp_replace("name", '^"|"$', ""))).otherwise(F.col("name"))
    return rows.select(
        "file", "module", "module_at", name.alias("name"), F.when(is_test, 0).otherwise(F.coalesce("arity", F.lit(0))).cast("long").alias("arity"), "line",
        F.when(is_test | F.col("what").isin("defp", "defmacrop"), "defp").otherwise("def").alias("ftype"),
        "guards", "impl", "spec", _text_of(F.col("doc")).alias("doc"), "at", "end_at",
    )


def _text_of(literal: Column) -> Column:
    """What stands between the quotes of a documentation string, its lines trimmed."""
    text = F.regexp_replace(F.regexp_replace(literal, r"^(?:~[sS])?(?:\"\"\"\s?|\")", ""), r"(?:\"\"\"|\")$", "")
    return F.array_join(F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.trim(x)), "\n")


def _modules_of(t: Tokens) -> tuple[np.ndarray, list]:
    heads = t.heads(t.starts(DEFINITIONS))
    head, body, end = heads
    is_module = t.modules(head, body)
    places, end = head[is_module], end[is_module]
    outer = t.around(places, *heads)
    # of several texts the first
    docs = np.flatnonzero(t.text("@moduledoc") & t.kind("string", at=t.after))
    owner, first = np.unique(t.around(docs, *heads), return_index=True)
    doc = np.full(t.n + 1, -1)
    doc[owner] = t.after[docs[first]]
    doc[-1] = -1
    named = np.append(t.after, -1)
    return places, [
        t.values(t.at, places), t.strings(t.codes(t.after[places])), t.strings(t.codes(named[outer])), t.line[places], t.values(t.line, end), t.strings(t.codes(doc[places])),
    ]


def modules(files: DataFrame) -> DataFrame:
    """(file, module, outer, line, end_line, moduledoc, at): ``outer`` is the module around it."""
    found = written(_found(files, _modules_of, "struct<at:int,module:string,outer:string,line:bigint,end_line:bigint,doc:string>"))
    return found.select("file", "module", "outer", "line", "end_line", _text_of(F.col("doc")).alias("moduledoc"), "at")


def _calls_of(t: Tokens) -> tuple[np.ndarray, list]:
    starts, last, owner = t.starts(DEFINITIONS), t.before, t.near(-2)
    dot = t.text(".", at=last)
    remote = dot & t.kind("alias", at=owner)
    bracket = t.text("(", at=t.after) & t.touches
    begins = t.kind("name", "alias", "string", "number", "atom", "key", "attribute", at=t.after) | t.text("%", "fn", "not", at=t.after) | (remote & t.text("[", "{", at=t.after))
    bare = ~bracket & ~t.touches & begins
    defining = np.append(starts, False)[last]
    named = t.kind("name") & ~defining & ~starts & ~t.kind("attribute", at=last) & ~t.text(*SPECIAL_FORMS, *DEFINITIONS)
    places = np.flatnonzero(named & (bracket | remote | (bare & ~dot)))
    count = np.maximum(np.where(bracket, np.append(t.arity(), -1)[t.after], 0), 0)
    bare = np.flatnonzero(bare & np.isin(t.places, places))
    count[bare] = t.bare_arity(bare, t.kind("key", at=t.after[bare]))
    module = t.around(places, *t.heads(starts))
    return places, [
        t.line[places], t.strings(t.codes(np.append(t.after, -1)[module])), t.values(t.at, module),
        t.strings(np.where(remote, t.codes(owner), -1)[places]), t.strings(t.code[places]), count[places],
    ]


def calls(files: DataFrame) -> DataFrame:
    """(file, line, caller, caller_at, module, function, arity) of calls, over any number of lines and inside one another, with or without brackets.

    ``module`` is the one named in the call, null for a local one. Definitions,
    attributes and special forms are none; of a piped value the call counts what is
    written; a name alone is a variable unless a module stands before it. Arguments
    without brackets end at the line's end (unless a comma stands there), a block, a
    closing bracket or a branch.
    """
    return _found(files, _calls_of, "struct<line:bigint,caller:string,caller_at:int,module:string,function:string,arity:bigint>")


def call_counts(files: DataFrame) -> DataFrame:
    """(file, caller, function, arity, calls): how many of ``calls`` there are, whatever module they name, counted inside the row of their file."""

    def counted(t: Tokens) -> tuple[np.ndarray, list]:
        places, (_, caller, _, _, function, arity) = _calls_of(t)
        if not len(places):
            return places, [caller, function, arity, arity]
        codes = [x.dictionary_encode().indices.fill_null(-1).to_numpy() for x in (caller, function)]
        _, first, calls = np.unique(key_of(t.file[places], *codes, arity), return_index=True, return_counts=True)
        order = np.argsort(first)
        first, calls = first[order], calls[order]
        return places[first], [caller.take(pa.array(first)), function.take(pa.array(first)), arity[first], calls]

    return _found(files, counted, "struct<caller:string,function:string,arity:bigint,calls:bigint>")


def literals(files: DataFrame, t: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(file, line, function, text) of strings of ``least`` characters or more, docs left out, with the function they are in."""
    t = written(tokens(files)) if t is None else t
    text = F.regexp_replace(F.regexp_replace("text", r"^~[a-zA-Z]", ""), r"^(?:\"\"\"|'''|[\"'(\[{<|/])\s?|(?:\"\"\"|'''|[\"')\]}>|/])$", "")
    strings = t.where("kind = 'string' and coalesce(before, '') not in ('@doc', '@moduledoc', '@typedoc', 'test', 'describe')").select("file", "at", "line", F.trim(text).alias("text"))
    f = functions(files).select("file", "at", F.struct(F.concat("name", F.lit("/"), F.col("arity").cast("string")).alias("name"), "end_at").alias("f"))
    both = strings.withColumns({"f": F.lit(None).cast(f.schema["f"].dataType), "_row": F.lit(True)}).unionByName(f.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("f", F.last("f", ignorenulls=True).over(in_file())).where("_row").where(F.length("text") >= least)
    inside = F.col("f.end_at").isNull() | (F.col("f.end_at") > F.col("at"))
    return both.select("file", "line", F.when(inside, F.col("f.name")).alias("function"), "text")
