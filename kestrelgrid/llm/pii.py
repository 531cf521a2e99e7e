"""Information-theoretic sanitisation of personal data, in built-in expressions only.

Patterns find protected entities: e-mail and IP addresses, card and phone
numbers. Every word or number of two characters or more of a document that holds
an entity is a candidate term. Over
the whole corpus of N documents, with df the number of documents that hold an
entity c or a term t, and co the documents that hold both, each counting 1 if t
is within REACH characters of c and FAR if it is anywhere else in the text,

    PMI(c; t) = log2(N * co / (df_c * df_t)),    IC(c) = log2(N / df_c),

and PMI / IC is the share of an entity's information that the term discloses
(1: the term occurs near that entity only). Few documents make an unsure
estimate, so the share is discounted by co / (co + 1) * m / (m + 1) with m =
min(df_c, df_t) (Pantel and Lin, 2002): a word that is seen once, next to an
entity that is seen once, has 1/4 of its share left. In documents that hold c,
terms whose share reaches GENERALISE are replaced by a general one, those that
reach REMOVE are removed. Documents without an entity are left alone.

Pairs that cannot reach GENERALISE are not made or not counted on: those of the
rest of a text for entities of too few documents, and those whose share stays
below it even if the term is nowhere else. Pairs are counted map-side first, so
an entity of very many documents is no large group; in the join back to
documents it is salted.

Everything about one text is rows, so no step depends on how many spans it has:
matches get their positions from a running sum over the pieces between them, in
code points; the words near a span come from a piece of PIECE characters of the
text, joined by its number; terms are found as the text's own words, joined by
word; the sanitised text is put together from its pieces, each with its own spans.
The patterns pass each character a bounded number of times, however long a run of
digits or letters is.

Defined cases: a null text is an empty one; no match gives counts of 0, the
hash of the empty string and empty spans; very long texts are read whole;
repeated rows are reported each and count as documents each; of equal shares
every term is treated alike; columns other than id and text, whatever their
names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import attach, quoted, written

#: Parameters of ``find``: characters around an entity that are near it, weight of the rest of the text, shares from which terms are treated.
REACH = 64
FAR = 0.1
GENERALISE = 0.2
REMOVE = 0.6
#: Keys of a table that is broadcast, at most; larger ones are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Characters of a piece of a text.
PIECE = 1024

KINDS = ("email", "ip", "card", "phone")
#: Same leftmost matches as the plain patterns: a match can only begin where a run begins or the last match ended,
#: and quantifiers that can't give back are possessive. Card runs of other than 16 to 19 digits are no match here.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A term: letters and digits, names of two letters, house numbers and years included.
WORD = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{2,}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits' weighted sum is divisible by ten."""
    back = F.reverse(_digits(value))

    def at(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + at(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _hits(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<kind, i, value, gap>> of all matches in order: gap is the number of code points since the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # one piece more than matches: the last has no match behind it
    numbered = F.transform(F.filter(F.arrays_zip(matches.alias("value"), gaps.alias("gap")), lambda z: z["value"].isNotNull()), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["value"].alias("value"), z["gap"].alias("gap")))
    return numbered


def _located(rows: DataFrame) -> DataFrame:
    """uid, kind, start, end, value of rows(uid, kind, i, value, gap): positions from the lengths before."""
    w = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    width = F.length("value")
    end = F.sum(F.col("gap") + width).over(w)
    return rows.select("uid", "kind", (end - width).cast("int").alias("start"), end.cast("int").alias("end"), "value")


def _entity(kind: Column, value: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)
    return F.concat_ws(":", name, F.when(name.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def base(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(uid, doc_id, hits, text) of every row; hits are the matches of all kinds, valid or not; text stays only where there are any."""
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), quoted(id_column).cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<struct<kind:int,i:int,value:string,gap:int>>")
    found = [F.when(F.contains("text", F.lit(NEEDS[k])) & F.col("text").rlike(PATTERNS[k]), _hits(F.col("text"), PATTERNS[k], n)).otherwise(none) for n, k in enumerate(KINDS)]
    rows = rows.withColumn("hits", F.concat(*found))
    return rows.withColumn("text", F.when(F.size("hits") > 0, F.col("text")))


def base_spans(held: DataFrame) -> DataFrame:
    """(uid, kind, start, end, value, entity) of the valid matches."""
    rows = _located(held.select("uid", F.inline("hits")))
    valid = F.lit(True)
    for n, kind in enumerate(KINDS):
        valid = F.when(F.col("kind") == n, _valid(kind, F.col("value"))).otherwise(valid)
    return rows.where(valid).withColumn("entity", _entity(F.col("kind"), F.col("value")))


def pieces(held: DataFrame, margin: int) -> DataFrame:
    """(uid, piece, chars, before, after): the texts in pieces of PIECE characters, with ``margin`` characters around each."""
    cut = held.select("uid", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))).alias("piece", "chars"))
    w = Window.partitionBy("uid").orderBy("piece")
    around = cut
    # a margin may be longer than a piece
    n = -(-margin // PIECE)
    before = F.concat(*[F.coalesce(F.lag("chars", k).over(w), F.lit("")) for k in range(n, 0, -1)])
    after = F.concat(*[F.coalesce(F.lead("chars", k).over(w), F.lit("")) for k in range(1, n + 1)])
    return around.withColumns({"before": F.right(before, F.lit(margin)), "after": F.left(after, F.lit(margin))})


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _near(spans: DataFrame, cut: DataFrame, reach: int) -> DataFrame:
    """(uid, entity, term): words within reach of a span; one that the reach cuts is left out.

    One character more than the reach shows whether a word goes on beyond it.
    """
    run = r"[\p{L}\p{N}]"
    piece = lambda c: F.floor(F.col(c) / PIECE).cast("int")
    left = spans.select("uid", "entity", "start", piece("start").alias("piece")).join(cut, ["uid", "piece"])
    offset = F.col("start") - F.col("piece") * PIECE
    context = F.right(F.concat("before", F.left("chars", offset)), F.lit(reach + 1))
    context = F.when(F.col("start") > reach, F.regexp_replace(context, f"^(?:{run}+|(?s:.))", "")).otherwise(context)
    left = left.select("uid", "entity", F.explode(_words(context)).alias("term"))
    right = spans.select("uid", "entity", "end", piece("end").alias("piece")).join(cut, ["uid", "piece"])
    offset = F.col("end") - F.col("piece") * PIECE
    context = F.left(F.concat(F.substring("chars", offset + 1, F.lit(PIECE)), F.col("after")), F.lit(reach + 1))
    context = F.when(F.length(context) > reach, F.regexp_replace(context, f"(?:{run}+|(?s:.))$", "")).otherwise(context)
    right = right.select("uid", "entity", F.explode(_words(context)).alias("term"))
    return left.unionAll(right).distinct()


def _joined_to(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, spread: str) -> DataFrame:
    """rows joined to the one row of their key, which goes to all tasks where there are few keys; else hot keys are salted."""
    if groups.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(groups), keys)
    return attach(rows, groups, keys, count, total, spread)


def pairs(held: DataFrame, spans: DataFrame, cut: DataFrame, entities: DataFrame, reach: int, far: float, generalise: float) -> DataFrame:
    """(uid, entity, term, w, k): weights and documents of a pair add up over the rows of a document.

    ``entities``: (entity, df_c), written. Entities of so few documents that a
    word far from them can't reach ``generalise`` have near words only.
    """
    least = generalise / (1 - generalise) / far
    wide = entities.where(F.col("df_c") >= least)
    said = spans.select("uid", "entity").distinct()
    wide = written(_joined_to(said, wide, ["entity"], "df_c", held.count(), "uid").select("uid", "entity", F.lit(True).alias("also")))
    near = _near(spans, cut, reach).join(wide, ["uid", "entity"], "left")
    # a near word of a wide entity is among the words of the whole text, too
    near = near.select("uid", "entity", "term", F.when(F.col("also"), 1 - far).otherwise(1.0).alias("w"), F.when(F.col("also"), 0).otherwise(1).alias("k"))
    words = held.join(wide.select("uid").distinct(), "uid", "left_semi").select("uid", F.explode(_words(F.col("text"))).alias("term"))
    whole = wide.join(words, "uid").select("uid", "entity", "term", F.lit(far).alias("w"), F.lit(1).alias("k"))
    return near.unionAll(whole)


def share(n: int) -> Column:
    """The discounted share of columns co, df_c and df_t."""
    pmi = F.log2(F.col("co") * F.lit(float(n)) / (F.col("df_c") * F.col("df_t")))
    m = F.least("df_c", "df_t")
    discount = F.col("co") / (F.col("co") + 1) * m / (m + 1)
    return F.when(F.col("df_c") < n, discount * pmi / F.log2(F.lit(float(n)) / F.col("df_c"))).otherwise(0.0)


def disclosures(docs: DataFrame, held: DataFrame, found: DataFrame, entities: DataFrame, text_column: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, docs, share) of the terms that disclose ``generalise`` or more of an entity. held: base(), found: pairs(), both written."""
    n = held.count()
    both = found.groupBy("entity", "term").agg(F.sum("w").alias("co"), F.sum("k").alias("docs"))
    # a term is in as many documents as the pair at least; what stays below even then is no candidate
    both = both.join(entities, "entity").withColumn("df_t", F.col("docs")).where(share(n) >= generalise)
    both = written(both.drop("df_t"))
    wanted = written(both.select("term").distinct())
    terms = docs.select(F.explode(_words(quoted(text_column).cast("string"))).alias("term"))
    if wanted.count() <= MOST_BROADCAST:
        terms = terms.join(F.broadcast(wanted), "term", "left_semi")
    # counted by each task first, so a word arrives once a task
    counts = terms.groupBy("term").agg(F.count("*").alias("df_t"))
    return both.join(counts, "term").withColumn("share", share(n)).where(F.col("share") >= generalise).select("entity", "term", "docs", "share")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH, far: float = FAR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_sha256, spans, and ``sanitised``, the text without what the spans cover (null: unchanged)."""
    held = written(base(docs, id_column, text_column))
    spans = written(base_spans(held))
    told = held.join(spans.select("uid").distinct(), "uid", "left_semi")
    cut = written(pieces(told, reach + 1))
    entities = written(spans.select("uid", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df_c")))
    found = written(pairs(held, spans, cut, entities, reach, far, generalise))
    treated = written(disclosures(docs, held, found, entities, text_column, generalise))
    own = _joined_to(found.select("uid", "entity", "term").distinct(), treated, ["entity", "term"], "docs", held.count(), "uid")
    shares = own.groupBy("uid", "term").agg(F.max("share").alias("share"))
    more = term_spans(held, spans, shares)
    every = written(spans.select("uid", "kind", "start", "end", F.lit(0.0).alias("share")).unionByName(more))
    name = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), F.col("kind") + 1)
    said = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    listed = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("kind", "start", said.alias("said"))))), lambda x: x["said"]), ",")
    counts = [F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    by_text = every.groupBy("uid").agg(*counts, listed(F.col("kind") < len(KINDS)).alias("base"), listed(F.lit(True)).alias("spans"))
    out = held.select("uid", "doc_id").join(by_text, "uid", "left").join(_sanitised(cut, every, remove), "uid", "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "sanitised")


def term_spans(held: DataFrame, spans: DataFrame, shares: DataFrame) -> DataFrame:
    """(uid, kind, start, end, share) of the words of each text that are among its terms, shares(uid, term, share), and touch none of its spans."""
    rows = held.join(shares.select("uid").distinct(), "uid", "left_semi")
    words = _located(rows.select("uid", F.inline(_hits(F.col("text"), WORD, len(KINDS)))))
    words = words.withColumn("term", F.lower("value")).join(shares, ["uid", "term"]).select("uid", "kind", "start", "end", "share")
    both = words.withColumn("place", F.col("end") - 0.5).unionByName(spans.select("uid", F.lit(-1).alias("kind"), "start", "end", F.lit(None).cast("double").alias("share"), F.col("start").cast("double").alias("place")))
    # the furthest end of the spans that begin before a word's end
    w = Window.partitionBy("uid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(F.when(F.col("kind") < 0, F.col("end"))).over(w)
    return both.withColumn("reached", F.coalesce(reached, F.lit(0))).where("kind >= 0 and reached <= start").select("uid", "kind", "start", "end", "share")


def _sanitised(cut: DataFrame, spans: DataFrame, remove: float) -> DataFrame:
    """(uid, sanitised): each span replaced by its kind in angle brackets, or by nothing from ``remove`` on.

    A span is dealt to all pieces that it covers, and named in the one in which it
    begins. Where spans overlap the later one covers what is left.
    """
    # what an earlier span covers of a later one is cut from it
    w = Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("start", F.coalesce(F.max("end").over(w), F.lit(0)))
    name = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), F.col("kind") + 1)
    put = F.when(F.col("share") >= remove, "").otherwise(F.concat(F.lit("<"), name, F.lit(">")))
    rows = spans.select("uid", "start", "end", "kind", begin.alias("begin"), put.alias("put"))
    rows = rows.withColumn("till", F.greatest("begin", "end"))
    first, last = (F.floor(c / PIECE).cast("int") for c in (F.col("begin"), F.greatest("begin", F.col("till") - 1)))
    dealt = rows.withColumn("piece", F.explode(F.sequence(first, last)))
    edge = F.col("piece") * PIECE
    inside = F.struct(
        F.greatest(F.col("begin") - edge, F.lit(0)).alias("begin"), "start", "end", "kind",
        F.least(F.col("till") - edge, F.lit(PIECE)).alias("till"), F.when(F.col("piece") == first, F.col("put")).otherwise("").alias("put"),
    )
    marks = dealt.groupBy("uid", "piece").agg(F.array_sort(F.collect_list(inside)).alias("marks"))
    # a span that an earlier one covers to the end of the text begins behind the last piece
    whole = cut.select("uid", "piece", "chars").join(marks, ["uid", "piece"], "full_outer").withColumn("chars", F.coalesce("chars", F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, m: Column) -> Column:
        kept = F.substring(F.col("chars"), state["at"] + 1, F.greatest(m["begin"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(m["till"], state["at"]).alias("at"), F.concat(state["out"], kept, m["put"]).alias("out"))

    text = F.aggregate("marks", start, step, lambda s: F.concat(s["out"], F.substring(F.col("chars"), s["at"] + 1, F.lit(PIECE))))
    done = whole.select("uid", "piece", F.when(F.col("marks").isNull(), F.col("chars")).otherwise(text).alias("text"))
    return done.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("sanitised"))
