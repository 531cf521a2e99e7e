"""What needs a parser or a library: Arrow-batched functions over one file or name a row."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of name matching.
SUBSTRING_FLOOR, PART_FLOOR, LEAST_RATIO = 0.7, 0.6, 0.4


def likeness(query: str, name: str) -> float:
    a, b = query.lower(), name.lower()
    if a == b:
        return 1.0
    floors = [SUBSTRING_FLOOR] * (a in b) + [PART_FLOOR] * any(p in b for p in a.split("."))
    return max([difflib.SequenceMatcher(None, a, b).ratio(), *floors])


def similar(names: DataFrame, column: str, query: str, n: int) -> DataFrame:
    """The n most similar names above the least ratio; an exact match stands alone."""

    @F.pandas_udf("double")
    def ratio(values: pd.Series) -> pd.Series:
        return values.map(lambda v: likeness(query, v or ""))

    rows = names.select(F.col(column).alias("name")).withColumn("similarity", F.round(ratio("name"), 6)).where(F.col("similarity") > LEAST_RATIO)
    # an exact match is first in this order; with it, only others like it stay
    first = rows.orderBy(F.col("similarity").desc(), "name").limit(n)
    best = F.max("similarity").over(Window.partitionBy())
    return first.withColumn("best", best).where("best < 1 or similarity = 1").drop("best").orderBy(F.col("similarity").desc(), "name")


class _Literals(ast.NodeVisitor):
    """String constants that are no docstrings; of formatted strings the fixed parts."""

    def __init__(self):
        self.docs, self.rows, self.scope = set(), [], []

    def _body(self, node: ast.AST) -> None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            self.docs.add(id(first.value))

    def visit(self, node: ast.AST) -> None:
        named = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
        if named or isinstance(node, (ast.Module, ast.ClassDef)):
            self._body(node)
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and id(node) not in self.docs and len(node.value.strip()) >= 3:
            self.rows.append((node.value, node.lineno, self.scope[-1] if self.scope else None))
        if named:
            self.scope.append(node.name)
        self.generic_visit(node)
        if named:
            self.scope.pop()


def _parsed(source: str | None) -> ast.AST | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError):
        return None


def python_literals(files: DataFrame, path: str, source: str) -> DataFrame:
    """(path, text, line, function) of Python string literals; files that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, s in zip(pdf["path"], pdf["source"], strict=True):
                tree, seen = _parsed(s), _Literals()
                if tree is not None:
                    seen.visit(tree)
                out += [(p, *r) for r in seen.rows]
            yield pd.DataFrame(out, columns=["path", "text", "line", "function"])

    return files.select(F.col(path).alias("path"), F.col(source).alias("source")).mapInPandas(run, "path string, text string, line int, function string")


def python_aliases(files: DataFrame, path: str, source: str) -> DataFrame:
    """(path, alias, target) of Python imports."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, s in zip(pdf["path"], pdf["source"], strict=True):
                for node in ast.walk(_parsed(s) or ast.Module([], [])):
                    if isinstance(node, ast.Import):
                        out += [(p, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        base = "." * node.level + (node.module or "")
                        out += [(p, a.asname or a.name, f"{base}.{a.name}" if base else a.name) for a in node.names]
            yield pd.DataFrame(out, columns=["path", "alias", "target"])

    return files.select(F.col(path).alias("path"), F.col(source).alias("source")).mapInPandas(run, "path string, alias string, target string")


def split_arguments(text: str) -> list[str]:
    """Arguments between commas at depth 0 of brackets and quotes."""
    parts, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>" and not (c == ">" and text[i - 1 : i] in ("-", "=")):
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def arguments(rows: DataFrame, signature: str) -> DataFrame:
    """Adds ``args``: names of a signature's arguments without types and defaults."""

    @F.pandas_udf("array<string>")
    def split(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> list[str]:
            v = v or ""
            inside = v[v.find("(") + 1 : v.rfind(")")] if "(" in v and ")" in v else ""
            return [a.split(":")[0].split("=")[0].strip() for a in split_arguments(inside)]

        return values.map(one)

    return rows.withColumn("args", split(signature))


def rust_uses(lines: DataFrame) -> DataFrame:
    """(file, alias, target) of Rust use trees, nested braces and ``as`` included."""

    def expand(prefix: str, item: str) -> list[tuple[str, str]]:
        item = item.strip()
        if item.endswith("}"):
            head, _, inner = item[:-1].partition("{")
            return [x for part in split_arguments(inner) for x in expand(prefix + head.strip(), part)]
        target, _, alias = item.partition(" as ")
        full = (prefix + target.strip()).removesuffix("::self")
        return [(alias.strip() or full.rsplit("::", 1)[-1], full)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(f, a, t) for f, s in zip(pdf["file"], pdf["tree"], strict=True) for a, t in expand("", s)]
            yield pd.DataFrame(out, columns=["file", "alias", "target"])

    tree = F.explode(F.regexp_extract_all("source", F.lit(r"(?ms)^\s*(?:pub\s+)?use\s+([^;]+);"), F.lit(1)))
    return lines.select("file", tree.alias("tree")).mapInPandas(run, "file string, alias string, target string")
