"""Spelling variants by letter-parity masks: equal bands find words one edit apart, chains of forms lead to a root.

A word's mask has one bit for each letter (some letters share one): whether the
letter occurs an odd number of times. One edit flips at most two bits, so of the
mask's three bands at least one stays equal. How many do depends on the edit:

* An inserted or deleted letter flips one bit, and so does a replaced one whose
  two bits lie in one band (or none, if both letters have the same bit): two
  bands are equal. Words meet by each pair of bands and the shorter length.
* A replaced letter whose bits lie in two bands leaves one band equal and one bit
  different in each of the others. Words of one length meet by the equal band
  and the next one, in which the word that has the bit set also goes without it.

So a word is sent under its bands and its few odd letters, and meets only words
that agree in two bands of the mask; what meets is verified by edit distance. A
pair is found exactly once. Keys of very many words are salted.

Defined cases: a null or empty text has no words; very long texts are read whole;
repeated rows count as often as they occur; of near words with equal counts the
first in code-point order is the form; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import quoted, written

#: What a word is made of, and the fewest letters of one that counts.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
#: Parameters of ``variants``: occurrences from which a word counts, and how many times as frequent its form must be.
LEAST_COUNT = 5
RATIO = 5
BAND_BITS = 21
BANDS = 3
#: Words of one key that are met by one task, at least.
HOT = 5_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, word): the runs of ``least`` letters or more of every text, A-Z in lower case."""
    # shorter runs match at none of their letters, longer ones at the first
    found = F.regexp_extract_all(quoted(text_column).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    out = docs.select(quoted(id_column).cast("string").alias("doc_id"), F.explode(found).alias("word"))
    return out.withColumn("word", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", _UPPER, _LOWER)).otherwise(F.col("word")))


def misspell(occurrences: DataFrame, every: int) -> DataFrame:
    """(word) of runs(); of those whose hash with their document is divisible by ``every`` one letter is missing."""
    draw = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    rows = occurrences.select("word", draw.alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(words: DataFrame, least_count: int = LEAST_COUNT, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of the words of ``least`` letters and ``least_count`` occurrences or more."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def mask(word: Column) -> Column:
    """63 bits in three bands: the parity of each letter. Neighbours of the alphabet lie in different bands."""
    place = lambda c: F.ascii(c) % BANDS * BAND_BITS + F.floor(F.ascii(c) / BANDS).cast("int") % BAND_BITS
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(bit(c))))


def _band(m: Column, b: int) -> Column:
    return F.shiftright(m, b * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _key(kind: int, length: Column, one: Column, other: Column) -> Column:
    """Two bands, what they are and a length as one number."""
    return F.shiftleft((length % 65536).cast("long"), 45).bitwiseOR(F.lit(kind << 42)).bitwiseOR(F.shiftleft(one, BAND_BITS)).bitwiseOR(other)


def _pairs_of(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of words one edit apart, each pair once. words: (word, n), written."""
    rows = words.withColumn("mask", mask(F.col("word"))).withColumn("length", F.length("word"))
    bands = [_band(F.col("mask"), b) for b in range(BANDS)]
    twos = [(0, 1), (0, 2), (1, 2)]
    nexts = [(b, (b + 1) % BANDS) for b in range(BANDS)]
    length = F.col("length")
    home = [_key(k, length, bands[a], bands[b]) for k, (a, b) in enumerate(twos)]
    home += [_key(3 + k, length, bands[a], bands[b]) for k, (a, b) in enumerate(nexts)]
    met = [_key(k, length - d, bands[a], bands[b]) for k, (a, b) in enumerate(twos) for d in (0, 1)]

    def without(k: int, a: int, b: int) -> Column:
        # the next band without one of its set bits
        set_bits = F.filter(F.array(*[F.lit(1 << i) for i in range(BAND_BITS)]), lambda bit: bands[b].bitwiseAND(bit) != 0)
        return F.transform(set_bits, lambda bit: _key(3 + k, length, bands[a], bands[b].bitwiseXOR(bit)))

    left = rows.select(F.explode(F.array(*home)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"))
    every = reduce(F.concat, [without(k, a, b) for k, (a, b) in enumerate(nexts)], F.array(*met))
    right = rows.select(F.explode(every).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"))
    left, right = _salted(left, right, words.count())
    kind = F.shiftright("key", 42).bitwiseAND(F.lit(7))
    differ = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    same_length = F.length("a") == F.length("b")
    # words of one length meet twice under two equal bands, and under each two if all are equal
    once = F.when(kind < 3, ((kind == 0) | (differ != 0)) & (~same_length | (F.col("a") < F.col("b")))).otherwise(F.bit_count(differ) == 2)
    near = once & (F.bit_count(differ) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, ["key", "salt"]).where(near).select("a", "n_a", "b", "n_b")


def _salted(left: DataFrame, right: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column salt; words of a hot key are dealt out on the left and go to each share on the right."""
    hot = max(HOT, 2 * BANDS * words // 1024)
    # at most 1,024 keys are hot
    many = written(left.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("key", F.ceil(F.col("rows") / hot).cast("int").alias("shares")))
    left, right = (x.join(F.broadcast(many), "key", "left") for x in (left, right))
    left = left.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return left, right


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of forms(word, form), by steps of doubled length along the forms.

    A form is RATIO times as frequent as its word, so chains are short and end.
    """
    current = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = current.join(ahead, "root", "left")
        if stepped.where("further is not null").isEmpty():
            return current
        current = written(stepped.select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n): the most frequent word one edit away, where it is ``ratio`` times as frequent."""
    words = written(words)
    pairs = _pairs_of(words)
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word"))).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
