"""Column builders for words, identifiers, names and excerpts.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
    "this", "that", "these", "those", "it", "its", "they", "them", "their", "what", "which", "who", "when", "where", "why",
    "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "can", "just", "up", "out",
)

# Weights of keywords by where they come from, and of inflected forms.
IDENTIFIER_TIMES = 10
SPLIT_TIMES = 3
NAME_BOOST = 1.5
STRING_BOOST = 1.3
COMMENT_BOOST = 1.2
INFLECTION_PENALTY = 0.7

_RUN = r"[\p{L}\p{N}_]+"


def runs(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores: what word boundaries part."""
    return F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs that are ASCII words beginning with a letter."""
    return F.filter(runs(text), lambda x: x.rlike("^[a-zA-Z][a-zA-Z0-9_]*$"))


#: Names the rule of ``keywords``: an index that was made by another one is made anew.
KEYWORDS_DEFINITION = "ascii words of three characters or more, lower case, no stop words; 1"
#: Tokens of three characters or more, found in one pass over the text.
_KEYWORD = r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9_]{2,}+(?![\p{L}\p{N}_])"


def keywords(text: Column) -> Column:
    """Tokens in lower case, longer than two characters and no stop words; repeats stay."""
    found = F.regexp_extract_all(text, F.lit(_KEYWORD), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda x: ~x.isin(*STOP_WORDS))


# Shapes of code identifiers, whole runs.
IDENTIFIER_SHAPES = (
    "[a-z]+[A-Z][a-zA-Z]*",
    "[A-Z]{2,}[a-z]+[a-zA-Z]*",
    "[A-Z][a-z]+[A-Z][a-zA-Z]*",
    "[a-z]+_[a-z_]+",
    "[A-Z]{2,}",
)


def identifiers(text: Column) -> Column:
    """Distinct code identifiers, in order of the alphabet."""
    shape = "^(" + "|".join(IDENTIFIER_SHAPES) + ")$"
    return F.array_sort(F.array_distinct(F.filter(runs(text), lambda x: x.rlike(shape))))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of snake_case, camelCase and acronyms."""
    text = F.regexp_replace(name, "_", " ")
    text = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    text = F.regexp_replace(text, "(?<=[a-z])([A-Z])(?=[A-Z])", " $1")
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def split_words(names: Column) -> Column:
    """Distinct alphabetic parts, longer than one character, of several identifiers."""
    parts = F.flatten(F.transform(names, split_identifier))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^\p{L}{2,}$")))


def split_for_pairs(name: Column) -> Column:
    """The variant for co-occurrence: lower-to-upper boundaries and underscores only, parts of three or more."""
    text = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.filter(F.split(F.lower(text), " +"), lambda x: F.length(x) >= 3)


def split_for_display(name: Column) -> Column:
    """The variant for display: leading underscores off, split at underscores and lower-to-upper boundaries."""
    text = F.regexp_replace(F.regexp_replace(name, "^_+", ""), "([a-z])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(text), "_"), lambda x: x != "")


def keyword_pool(text: Column) -> Column:
    """array<struct<kw, times>>: words once each, identifiers ten times, their parts three times."""
    names = identifiers(text)
    weigh = lambda items, times: F.transform(items, lambda x: F.struct(x.alias("kw"), F.lit(times).cast("long").alias("times")))
    return F.concat(weigh(keywords(text), 1), weigh(F.transform(names, F.lower), IDENTIFIER_TIMES), weigh(split_words(names), SPLIT_TIMES))


def keyword_map(text: Column) -> Column:
    """map<keyword, weight> of the JSON forms that indexes hold: an object, a list of words (1 each), of pairs, of objects, or an object around one of these."""
    inner = F.coalesce(F.get_json_object(text, "$.top_keywords"), F.get_json_object(text, "$.tf_scores"), F.get_json_object(text, "$.keywords"), text)
    as_map = F.from_json(inner, "map<string,double>")
    objects = F.filter(F.from_json(inner, "array<struct<word:string,keyword:string,score:double,weight:double>>"), lambda x: F.coalesce(x["word"], x["keyword"]).isNotNull())
    pairs = F.filter(F.from_json(inner, "array<array<string>>"), lambda x: F.size(x) == 2)
    words = F.filter(F.from_json(inner, "array<string>"), lambda x: x.isNotNull())
    entry = lambda k, w: F.struct(k.alias("key"), w.alias("value"))
    entries = (
        F.when(inner.rlike(r"^\s*\{"), F.map_entries(as_map))
        .when(inner.rlike(r"^\s*\[\s*\{"), F.transform(objects, lambda x: entry(F.coalesce(x["word"], x["keyword"]), F.coalesce(x["score"], x["weight"], F.lit(1.0)))))
        .when(inner.rlike(r"^\s*\[\s*\["), F.transform(pairs, lambda x: entry(x[0], F.coalesce(x[1].try_cast("double"), F.lit(1.0)))))
        .when(inner.rlike(r"^\s*\["), F.transform(words, lambda x: entry(x, F.lit(1.0))))
    )
    # of a keyword named twice the greater weight counts
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    best = F.transform(names, lambda n: entry(n, F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == n), lambda e: e["value"]))))
    return F.map_from_entries(F.coalesce(best, F.array().cast("array<struct<key:string,value:double>>")))


def inflections(word: Column) -> Column:
    """array<struct<word, score>>: the word itself, and its plural or third person, past, present participle, comparative and superlative at a penalty.

    Forms follow the regular spelling rules; identifiers (with a digit or an
    underscore) have none but themselves.
    """
    y_stem = F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", ""))
    e_off = F.when(word.rlike("[^e]e$"), F.regexp_replace(word, "e$", ""))
    with_e = lambda end: F.when(y_stem.isNotNull(), F.concat(y_stem, F.lit(f"ie{end}"))).when(word.endswith("e"), F.concat(word, F.lit(end))).otherwise(F.concat(word, F.lit(f"e{end}")))
    plural = F.when(y_stem.isNotNull(), F.concat(y_stem, F.lit("ies"))).when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    others = F.array(plural, with_e("d"), F.concat(F.coalesce(e_off, word), F.lit("ing")), with_e("r"), with_e("st"))
    scored = lambda words, score: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(score).alias("score")))
    own = scored(F.array(word), 1.0)
    return F.when(word.rlike("[_0-9]"), own).otherwise(F.concat(own, scored(others, INFLECTION_PENALTY)))


def canonical(module: Column, name: Column, arity: Column) -> Column:
    return F.concat(module, F.lit("."), name, F.lit("/"), arity.cast("string"))


def parse_canonical(text: Column) -> Column:
    """struct<module, name, arity>; null where the text isn't ``Module.name/arity``."""
    shape = r"^(.*)\.([^.]*)/([^/]*)$"
    part = lambda k: F.regexp_extract(text, shape, k)
    return F.when(text.rlike(shape), F.struct(part(1).alias("module"), part(2).alias("name"), part(3).try_cast("bigint").alias("arity")))


def simple_name(name: Column) -> Column:
    """Last dotted part without arity, in lower case."""
    return F.lower(F.element_at(F.split(F.split_part(name, F.lit("/"), F.lit(1)), r"\."), -1))


def to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def to_camel(name: Column) -> Column:
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.initcap)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def paragraph_with_most(text: Column, words: Sequence[str]) -> Column:
    """The line that holds most of the words (each counted once), the first on ties; null if none holds any."""
    parts = F.split(text, r"\n+")
    count = lambda p: sum(F.contains(F.lower(p), F.lit(w.lower())).cast("int") for w in words)
    scored = F.transform(parts, lambda p, i: F.struct(count(p).alias("n"), (-i).alias("k"), p.alias("p")))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, F.trim(best["p"]))


def highlight(text: Column, words: Sequence[str]) -> Column:
    """Words wrapped in asterisks; longer ones first, so none is wrapped twice."""
    quoted = "|".join(r"\Q" + w + r"\E" for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, f"(?i)({quoted})", "*$1*")


def truncate_around(text: Column, words: Sequence[str], width: int = 150) -> Column:
    """At most ``width`` characters around the first of the words, with dots where text is left out."""
    spots = [F.when(F.locate(w.lower(), F.lower(text)) > 0, F.locate(w.lower(), F.lower(text))) for w in words]
    first = F.coalesce(F.least(*spots) if len(spots) > 1 else spots[0], F.lit(1))
    begin = F.greatest(F.lit(1), F.least(first - width // 2, F.length(text) - width + 1))
    cut = F.substring(text, begin, F.lit(width))
    before, after = F.when(begin > 1, "...").otherwise(""), F.when(begin + width <= F.length(text), "...").otherwise("")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(before, cut, after))


def excerpt(doc: Column, word: str, before: int = 30, after: int = 50, most: int = 80) -> Column:
    """White space collapsed, from ``before`` characters ahead of the word, at most ``most``; the head if it is absent."""
    flat = F.trim(F.regexp_replace(doc, r"\s+", " "))
    at = F.locate(word.lower(), F.lower(flat))
    begin = F.greatest(F.lit(1), at - before)
    return F.substring(flat, F.when(at > 0, begin).otherwise(1), F.when(at > 0, F.least(at + len(word) + after - begin, F.lit(most))).otherwise(F.lit(most)))


def pr_number(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"\((?:PR )?#(\d+)\)", 1), F.lit("")).try_cast("bigint")


def dedent(lines: Column) -> Column:
    """Lines without their common indent; blank lines don't count and become empty."""
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    return F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x))))


def line_count(text: Column) -> Column:
    """Line breaks and one; 0 for null or empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("bigint")


def path_to_module(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "/", ".")


def fence_kind(doc: Column) -> Column:
    """Kind of type that a fenced signature declares; null if none."""
    low = F.lower(doc)
    has = lambda w: F.contains(low, F.lit(w + " "))
    return F.when(has("class"), "class").when(has("interface"), "interface").when(has("type"), "type").when(has("enum"), "enum")


def string_literals(source: Column) -> Column:
    """Quoted strings of three or more characters, without block comments and full-line comments."""
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(?m)^\s*(//|#).*$", "")
    return F.filter(F.regexp_extract_all(bare, F.lit("\"([^\"\\n]*)\"|'([^'\\n]*)'"), F.lit(0)), lambda x: F.length(x) >= 5)


def symbol_parts(symbol: Column) -> Column:
    """struct<module, parent, name, kind, private> of ``package `module`/Parent#name().`` symbols."""
    shape = r"`([^`]*)`/(?:([A-Za-z0-9_]+)#)?([A-Za-z0-9_]*)(\(\)\.|#|\.|:|/)?$"
    part = lambda k: F.nullif(F.regexp_extract(symbol, shape, k), F.lit(""))
    mark = part(4)
    kind = F.when(mark == "().", F.when(part(2).isNull(), "function").otherwise("method")).when(mark == "#", "class").when(mark == ".", "attribute").when(mark == ":", "meta").otherwise("module")
    name = F.coalesce(part(3), part(2))
    return F.struct(part(1).alias("module"), F.when(part(3).isNotNull(), part(2)).alias("parent"), name.alias("name"), F.when(part(3).isNull() & part(2).isNotNull(), "class").otherwise(kind).alias("kind"), (name.startswith("_") & ~name.startswith("__")).alias("private"))


def embedding_text(*parts: Column) -> Column:
    """Paragraphs with nulls and blanks dropped."""
    return F.concat_ws("\n\n", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def first_paragraph(doc: Column) -> Column:
    return F.trim(F.element_at(F.split(F.trim(doc), r"\n\s*\n"), 1))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences, any case."""
    return F.coalesce((F.length(text) - F.length(F.replace(F.lower(text), F.lit(word.lower())))) / len(word), F.lit(0)).cast("bigint")
