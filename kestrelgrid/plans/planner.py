"""What is decided on the driver before a plan is built: query analysis, guards, hints, JSON path queries."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# Limits of JSON queries, bytes at which results are warned about and cut.
MOST_CHARACTERS, MOST_NESTING = 10_000, 50
WARN_BYTES, CUT_BYTES = 500_000, 1_000_000
SAMPLE_ROWS = 5


# What makes a word a pattern: a wildcard or alternatives, an arity, a source file before a colon, a module's name.
_IN_WORD = re.compile(r"[*|]|/[0-9]+$|:.*\.ex|\.ex.*:|^[A-Z][^.]*\.")
# In a text that isn't parted yet, any slash is a sign too: spaces may belong to the pattern.
_IN_TEXT = re.compile(r"/|" + _IN_WORD.pattern)


def parted(text: str) -> list[str]:
    """Words of a text, quotes as in a shell; with an open quote, at white space."""
    try:
        return shlex.split(text)
    except ValueError:
        return text.split()


def read_query(query: str | list[str | list[str]]) -> dict[str, list]:
    """``keywords`` (a list among them is one group of synonyms) and ``patterns`` of a query, in order."""
    items = query if not isinstance(query, str) else [query] if _IN_TEXT.search(query) else parted(query)
    out: dict[str, list] = {"keywords": [], "patterns": []}
    for item in items:
        if isinstance(item, str):
            word = item.strip()
            kind = "patterns" if _IN_WORD.search(word) else "keywords"
            said = word if word.strip("|") else None
        else:
            kind, said = "keywords", [w.strip() for w in item if w.strip()]
        if said:
            out[kind].append(said)
    return out


def check_json_query(query: str | None) -> str | None:
    """Why a JSON query is refused, or None."""
    if not query or not query.strip():
        return "a query is required"
    if len(query) > MOST_CHARACTERS:
        return f"the query is longer than {MOST_CHARACTERS} characters"
    closing, stack, deepest = {")": "(", "]": "[", "}": "{"}, [], 0
    bare = re.sub(r'"(?:[^"\\]|\\.)*"', "", query)
    if '"' in bare:
        return "a string doesn't end"
    for c in bare:
        if c in "([{":
            stack.append(c)
            deepest = max(deepest, len(stack))
        elif c in closing and (not stack or stack.pop() != closing[c]):
            return f"unexpected '{c}'"
    if stack:
        return f"'{stack[-1]}' isn't closed"
    return f"nested deeper than {MOST_NESTING}" if deepest > MOST_NESTING else None


def _stages(query: str) -> list[str]:
    """Parts between bars outside of parentheses and strings."""
    parts, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(query):
        if c == '"' and query[i - 1 : i] != "\\":
            quoted = not quoted
        elif not quoted and c == "|" and depth == 0:
            parts.append(query[last:i])
            last = i + 1
        elif not quoted:
            depth += (c == "(") - (c == ")")
    return [p.strip() for p in [*parts, query[last:]]]


def json_query(rows: DataFrame, column: str, query: str, sample: bool = False) -> DataFrame:
    """A subset of JSON path queries over a JSON text column: ``.a.b``, ``.a[]``, ``| keys``, ``| length``, ``| schema``, ``| select(.x | test("re"))``.

    Each stage is a built-in expression; results stay JSON text.
    """
    if why := check_json_query(query):
        raise ValueError(why)
    out = rows.select(F.col(column).alias("value"))
    for stage in _stages(query):
        if stage == "keys":
            out = out.select(F.to_json(F.array_sort(F.json_object_keys("value"))).alias("value"))
        elif stage == "length":
            size = F.coalesce(F.json_array_length("value"), F.size(F.json_object_keys("value")), F.length(F.get_json_object("value", "$")))
            out = out.select(size.cast("string").alias("value"))
        elif stage == "schema":
            first = F.coalesce(F.get_json_object("value", "$[0]"), F.col("value"))
            out = out.select(F.to_json(F.array_sort(F.json_object_keys(first))).alias("value"))
        elif m := re.fullmatch(r'select\(\s*(\.[\w.]*)\s*\|\s*test\("(.*)"\)\s*\)', stage):
            out = out.where(F.get_json_object("value", "$" + m[1].rstrip(".")).rlike(m[2].replace("\\\\", "\\")))
        elif m := re.fullmatch(r"(\.[\w.]*)(\[\])?", stage):
            if m[1] != ".":
                out = out.select(F.get_json_object("value", "$" + m[1]).alias("value"))
            if m[2]:
                out = out.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
            out = out.where("value is not null")
        else:
            raise ValueError(f"not supported: {stage}; beyond paths, keys, length, schema and select use Spark SQL over the index's tables")
    return out.limit(SAMPLE_ROWS) if sample else out


def cut(text: str) -> str:
    """Results beyond the limit end at a line break."""
    if len(text) <= CUT_BYTES:
        return text
    end = text.rfind("\n", 0, CUT_BYTES)
    return text[: end if end > 0 else CUT_BYTES] + f"\n... {len(text) - CUT_BYTES} more characters"


def other_case(name: str) -> str:
    """snake_case for camelCase and the other way round."""
    if "_" in name.strip("_"):
        head, *rest = name.split("_")
        return head + "".join(p.title() for p in rest)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def relaxed(pattern: str) -> list[tuple[str, str]]:
    """A function pattern and what to try instead, in order; each relaxation holds for all alternatives."""
    said = [P.function_parts(p) for p in P.split_or(pattern) or ["*"]]
    names = [x["name"] or "*" for x in said]
    with_arity = [n + (f"/{x['arity']}" if x["arity"] else "") for n, x in zip(names, said, strict=True)]
    tries = {"as asked": [pattern], "any module": with_arity, "any arity": names, "private twin": [f"_{n}" for n in names], "other case": map(other_case, names), "part of the name": [f"*{n}*" for n in names if len(n.strip("*")) >= 4]}
    return [(note, text) for note, alternatives in tries.items() if (text := "|".join(alternatives))]


def hints(said: dict[str, list], options: dict, near: list[str] | None = None) -> list[str]:
    """What to try when nothing was found; ``near``: words of the index like those that were asked for."""
    out = [f"did you mean {', '.join(near)}?"] if near else []
    if options.get("recent"):
        out.append("look at older code too")
    if options.get("scope", "all") != "all":
        out.append("search all scopes")
    if options.get("source", "all") != "all":
        out.append("search docs, strings and comments")
    if said["patterns"] and not any("*" in p for p in said["patterns"]):
        out.append(f"use a wildcard: *{said['patterns'][0].rsplit('.', 1)[-1]}*")
    if len(said["keywords"]) > 1:
        out.append("use fewer terms")
    return out or ["try other words"]


def next_steps(rows: list[dict]) -> list[str]:
    """At most two suggestions on results."""
    out = []
    modules = [r.get("module") for r in rows[:10] if r.get("module")]
    if modules and (best := max(set(modules), key=lambda m: (modules.count(m), m))) and modules.count(best) > 1:
        out.append(f"look at module {best}")
    if any(r.get("type") == "function" for r in rows):
        out.append(f"see callers of {next(r['name'] for r in rows if r.get('type') == 'function')}")
    return out[:2]


def table(rows: list[dict], columns: list[str]) -> str:
    """Aligned text of a few collected rows."""
    cells = [columns, *[["" if r.get(c) is None else str(r[c]) for c in columns] for r in rows]]
    width = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells)
