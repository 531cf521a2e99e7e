"""Document fingerprints by improved consistent weighted sampling (Ioffe, 2010).

A document is the weighted set of its lower-cased words, a word weighing as
often as it occurs. For sample k a word has r and c drawn from Gamma(2, 1) and
b from U(0, 1), all functions of word and k. With ``t = floor(ln(weight) / r +
b)`` the word's value is ``ln c - r * (t - b + 1)``; the least value's (word, t)
is the sample. Two documents have the same sample with a probability equal to
their generalised Jaccard similarity (sum of minima over sum of maxima of the
weights). A fingerprint is SAMPLES samples of 16 bits, in hexadecimal.

Defined cases: null and empty texts and those without words have the fingerprint
of SAMPLES zeros, like each other and nothing else; equal texts have equal
fingerprints; very long texts are read whole; of equal values the word of the
least hash is the sample; repeated rows are fingerprinted each; other columns,
whatever their names, make no difference; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow, quoted, written
from .text import Words, mix, slices

SAMPLES = 64
#: Words whose draws a Python worker keeps, 768 bytes each.
KEPT_WORDS = 1 << 16


def _uniform(words: np.ndarray, samples: int, salt: int) -> np.ndarray:
    """(words, samples) numbers in (0, 1), each a hash of word, sample and salt."""
    k = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    x = mix(words[:, None] ^ k[None, :])
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


class Sampler:
    """Draws for words, made once for each word while there is room."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.words = np.zeros(0, np.uint64)
        self.draws = np.zeros((3, 0, samples), np.float32)

    def _make(self, words: np.ndarray) -> np.ndarray:
        u = [_uniform(words, self.samples, salt) for salt in range(1, 6)]
        return np.stack([-np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]])  # r, ln c, b

    def of(self, words: np.ndarray) -> np.ndarray:
        """Draws for ascending distinct words."""
        place = np.searchsorted(self.words, words)
        place[place == len(self.words)] = 0
        known = self.words[place] == words if len(self.words) else np.zeros(len(words), bool)
        if known.all():
            return self.draws[:, place]
        out = np.empty((3, len(words), self.samples), np.float32)
        out[:, known] = self.draws[:, place[known]]
        fresh = words[~known]
        for at in range(0, len(fresh), 4096):
            out[:, np.flatnonzero(~known)[at : at + 4096]] = self._make(fresh[at : at + 4096])
        if len(self.words) + len(fresh) > KEPT_WORDS:
            self.words, self.draws = self.words[:0], self.draws[:, :0]
        if len(fresh) <= KEPT_WORDS - len(self.words):
            merged = np.concatenate([self.words, fresh])
            order = np.argsort(merged)
            self.words, self.draws = merged[order], np.concatenate([self.draws, out[:, ~known]], axis=1)[:, order]
        return out

    def signatures(self, col: pa.Array) -> np.ndarray:
        """(rows, samples) 16-bit samples of a column of texts."""
        words = Words(col)
        out = np.zeros((words.rows, self.samples), np.uint16)
        hashes = words.hashes()
        if not len(hashes):
            return out
        own, back = np.unique(hashes, return_inverse=True)
        pair, weight = np.unique(words.row * len(own) + back, return_counts=True)
        row, word = pair // len(own), pair % len(own)
        r, lnc, b = self.of(own)
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])).tolist() + [len(row)]
        logs = np.log(weight).astype(np.float32)
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            w = word[a:z]
            rw = r[w]
            t = np.floor(logs[a:z, None] / rw + b[w])
            value = lnc[w] - rw * (t - b[w] + 1)
            best = value.argmin(axis=0)
            chosen = t[best, np.arange(self.samples)].astype(np.int64).astype(np.uint64)
            code = mix(own[w[best]] ^ mix(chosen + np.uint64(0x1234567))) >> np.uint64(48)
            out[row[a]] = np.maximum(code, 1).astype(np.uint16)
        return out


def as_hex(signatures: np.ndarray) -> list[str]:
    return [s.astype(">u2").tobytes().hex() for s in signatures]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``other``."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(as_hex(sampler.signatures(part.column("text"))))], ["doc_id", "fingerprint"])

    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, fingerprint string")


def against_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, which takes from the next document in order of doc_id.

    Order: doc_id, nulls last, then a hash of the text. Rows are dealt to ranges
    of this order, each row once; the first row of a range also goes, marked, to
    the range before it (that of the first range to the last one), so that every
    row meets its next one in its own task. Bounds of ranges are quantiles of all
    doc_ids; only one small row for each range is broadcast.
    """
    spark = docs.sparkSession
    order = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    size = order.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    ranges = max(1, min(20_000, int((size[0] or 0) // (8 << 20)) + 1))
    bounds = sorted(set(order.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 and size[1] else []
    edges = spark.sparkContext.broadcast(np.array(bounds, float))

    @F.pandas_udf("int")
    def by_id(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(edges.value, ids.to_numpy(dtype=float, na_value=np.nan), side="right").astype(np.int32))

    # null doc_ids have ranges of their own, by hash
    by_hash = F.floor((F.shiftright("h", 32) + 2**31) / 2.0**32 * ranges)
    dealt = order.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + by_hash).otherwise(by_id("doc_id")).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("h"))
    firsts = written(dealt.groupBy("range").agg(F.min(place).alias("first")))
    rows = sorted((r["range"], tuple(r["first"])) for r in firsts.collect())  # one for each range, 40,001 at most
    if not rows:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {rows[k][0]: rows[k - 1][0] for k in range(len(rows))}
    heads = spark.createDataFrame([(g, f[0], f[1], f[2], before[g], int(g == rows[0][0])) for g, f in rows], "range int, hz boolean, hi long, hh long, before int, wraps int")
    is_head = (F.col("doc_id").isNull() == F.col("hz")) & (F.coalesce("doc_id", F.lit(0)) == F.col("hi")) & (F.col("h") == F.col("hh"))
    joined = dealt.join(F.broadcast(heads), "range")
    # own: (range, 0, is it a copy for the range before); a copy sorts behind all rows of that range
    copies = F.when(is_head, F.array(F.struct(F.col("range").alias("g"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("g"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("range").alias("g"), F.lit(False).alias("copy"))))
    sent = joined.select("doc_id", "text", "h", F.explode(copies).alias("c")).select(F.col("c.g").alias("g"), F.col("c.copy").alias("copy"), F.col("doc_id").isNull().alias("z"), "doc_id", "h", "text")
    sent = sent.repartition(max(len(rows), 1), "g").sortWithinPartitions("g", "copy", "z", "doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held = None  # the row that waits for its next one
        for batch in batches:
            for part in slices(batch.select(["g", "copy", "doc_id", "text"]), "text"):
                groups, copy, ids = (part.column(c).to_pylist() for c in ("g", "copy", "doc_id"))
                texts = [t or "" for t in part.column("text").to_pylist()]
                own = sampler.signatures(pa.array(texts, pa.string()))
                todo = []
                for k, g in enumerate(groups):
                    row = (g, copy[k], ids[k], texts[k], own[k])
                    # a row's next one is in the same group; of several copies the first counts
                    if held is not None and held[0] == g and not held[1]:
                        todo.append((held, texts[k], own[k]))
                    held = row
                if todo:
                    yield _result(sampler, todo)

    return map_arrow(sent, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _result(sampler: Sampler, todo: list) -> pa.RecordBatch:
    texts = [edited(row[3], other) for row, other, _ in todo]
    own, following = np.stack([row[4] for row, _, _ in todo]), np.stack([x for _, _, x in todo])
    changed = sampler.signatures(pa.array(texts, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[2] for row, _, _ in todo], pa.int64()),
            pa.array([len(row[3]) for row, _, _ in todo], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
            pa.array(as_hex(own)),
            pa.array(as_hex(changed)),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, following)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
