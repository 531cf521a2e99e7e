"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of each sees the text's
features and the probabilities of all categories before it. In training those
probabilities are out-of-fold: for each of FOLDS folds a model learnt on the
others gives them, so a later model meets probabilities as unsure as those it
will be given for new texts.

Features are distinct words (letters and digits, A-Z lower-cased, hashed to
2^BITS) that are associated with the category (signed chi-square above
ASSOCIATED on the training rows of the fold), and a few shares of the whole text
(digits, upper case, other signs, spaces, repeated words, length).

Training uses a bounded sample of labelled rows, the most_rows of least hash of
doc_id, and the MOST_WORDS words most associated with a category; every document
is then classified over its whole text.

Defined cases: a null text is an empty one; very long texts are read whole, in
training too; a null label leaves its row out; of several label rows of one
doc_id the least in order counts, and of several texts that of the least hash;
with no labelled row or one class only the probability is that class' share (0
without rows); words of equal association are taken in order of their bucket;
repeated rows are classified each; other columns, whatever their names, make no
difference; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow, quoted
from .text import ALNUM, Words, list_column, slices

BITS = 20
MOST_ROWS = 8_000
FOLDS = 5
ASSOCIATED = 20.0
MOST_WORDS = 500


def buckets(words: Words) -> np.ndarray:
    return (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)


_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _KIND[_b] = 0 if 48 <= _b <= 57 else 1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 or _b >= 128 else 3 if _b in b" \t\n\r\v\f" else 4


def shares(words: Words, ids: np.ndarray) -> np.ndarray:
    """(rows, 6) dense features of whole texts."""
    sizes = np.diff(words.offsets)
    row = np.repeat(np.arange(words.rows), sizes)
    kinds = np.bincount(row * 5 + _KIND[words.data], minlength=words.rows * 5).reshape(-1, 5)
    part = kinds[:, [0, 1, 3, 4]] / np.maximum(1, sizes)[:, None]
    pair = np.unique(words.row * (1 << BITS) + ids) if len(ids) else ids
    different = np.bincount(pair >> BITS, minlength=words.rows) / np.maximum(1, words.counts)
    return np.column_stack([part, different, np.log1p(words.counts)])


class Rows:
    """Sparse rows: ids[bounds[i]:bounds[i + 1]] are the distinct words of row i; and their dense features."""

    def __init__(self, lists: list[np.ndarray], dense: np.ndarray):
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(int)
        self.ids = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.bounds))
        self.dense = dense

    def present(self, words: np.ndarray) -> np.ndarray:
        """(rows, words) 0/1 matrix for a few words."""
        place = np.full(1 << BITS, -1)
        place[words] = np.arange(len(words))
        hit = place[self.ids] >= 0
        out = np.zeros((len(self.bounds) - 1, len(words)), np.float32)
        out[self.row[hit], place[self.ids[hit]]] = 1
        return out


class Linear:
    """Logistic regression over chosen words and standardised dense features."""

    def __init__(self, rows: Rows, extra: np.ndarray, y: np.ndarray, pick: np.ndarray):
        self.words, self.weights, self.dense_weights = np.zeros(0, int), np.zeros(0), np.zeros(rows.dense.shape[1] + extra.shape[1])
        self.mean, self.scale = np.zeros(len(self.dense_weights)), np.ones(len(self.dense_weights))
        share = float(y[pick].mean()) if len(pick) else 0.0
        self.constant = share
        self.fitted = 0 < share < 1
        if not self.fitted:
            return
        inside = np.zeros(len(y), bool)
        inside[pick] = True
        n, positive = len(pick), y[pick].sum()
        seen = np.bincount(rows.ids[inside[rows.row]], minlength=1 << BITS).astype(float)
        with_y = np.bincount(rows.ids[(inside & (y > 0))[rows.row]], minlength=1 << BITS)
        expected = seen * positive / n
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = np.nan_to_num((with_y - expected) ** 2 * n * n / np.maximum(expected * (n - positive) * (n - seen), 1e-9))
        chi[seen < 3] = 0
        best = np.argsort(-chi, kind="stable")[:MOST_WORDS]
        self.words = np.sort(best[chi[best] > ASSOCIATED])
        dense = np.column_stack([rows.dense, extra])[pick]
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-9
        x = np.column_stack([rows.present(self.words)[pick], (dense - self.mean) / self.scale, np.ones(n)]).astype(np.float32)
        w = np.zeros(x.shape[1])
        w[-1] = np.log(share / (1 - share))
        penalty = np.full(len(w), 0.1)
        penalty[-1] = 0
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, 151):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y[pick]) + penalty * w
            g /= n
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        k = len(self.words)
        self.weights, self.dense_weights, self.bias = w[:k], w[k:-1], w[-1]

    def probability(self, sums: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """``sums``: the weights of each row's words, added up."""
        if not self.fitted:
            return np.full(len(dense), self.constant)
        z = sums + ((dense - self.mean) / self.scale) @ self.dense_weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def of_rows(self, rows: Rows, extra: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.words] = self.weights
        sums = np.bincount(rows.row, table[rows.ids], minlength=len(rows.dense))
        return self.probability(sums, np.column_stack([rows.dense, extra]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which out-of-fold probabilities reach the best F1; 0.5 if there is one class only."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal probabilities
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


class Chain:
    """One linear model for each category, in order."""

    def __init__(self, categories: Sequence[str], rows: Rows, labels: np.ndarray):
        self.categories, self.models = list(categories), []
        extra = np.zeros((len(labels), 0))
        fold = np.arange(len(labels)) % FOLDS
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            out = np.zeros(len(y))
            for f in range(FOLDS):
                part = Linear(rows, extra, y, np.flatnonzero(fold != f))
                own = part.of_rows(rows, extra)
                out[fold == f] = own[fold == f]
            self.threshold = best_threshold(out, y)  # the last category's stays
            self.models.append(Linear(rows, extra, y, np.arange(len(y))))
            extra = np.column_stack([extra, out])
        self.tables = [np.zeros(1 << BITS) for _ in self.models]
        for table, model in zip(self.tables, self.models, strict=True):
            table[model.words] = model.weights

    def probabilities(self, col: pa.Array) -> np.ndarray:
        """(rows, categories) for a column of texts."""
        words = Words(col, ALNUM)
        ids = buckets(words)
        dense = shares(words, ids)
        used = np.zeros(1 << BITS, bool)
        for model in self.models:
            used[model.words] = True
        hit = used[ids]
        pair = np.unique(words.row[hit] * (1 << BITS) + ids[hit])
        row, word = pair >> BITS, pair & ((1 << BITS) - 1)
        for table, model in zip(self.tables, self.models, strict=True):
            dense = np.column_stack([dense, model.probability(np.bincount(row, table[word], minlength=words.rows), dense)])
        return dense[:, -len(self.models) :]


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_column: str = "doc_id", text_column: str = "text", most_rows: int = MOST_ROWS) -> Chain:
    """A chain learnt from ``labels`` (id, a 0/1 column for each category) and the texts they name."""
    names = [f"y{k}" for k in range(len(categories))]
    wanted = labels.select(quoted(id_column).cast("long").alias("id"), *[quoted(c).cast("int").alias(n) for n, c in zip(names, categories, strict=True)]).na.drop()
    wanted = wanted.groupBy("id").agg(F.min(F.struct(*names)).alias("y")).select("id", "y.*")
    # at most most_rows rows, so they may be broadcast
    wanted = wanted.orderBy(F.xxhash64("id"), "id").limit(most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                ids = buckets(words)
                pair = np.unique(words.row * (1 << BITS) + ids)
                dense = shares(words, ids)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), *[part.column(c) for c in names], list_column((pair & ((1 << BITS) - 1)).astype(np.int32), np.bincount(pair >> BITS, minlength=words.rows)), list_column(dense.ravel(), np.full(words.rows, dense.shape[1]))], ["id", "h", *names, "ids", "dense"])

    texts = docs.select(quoted(id_column).cast("long").alias("id"), quoted(text_column).cast("string").alias("text")).join(F.broadcast(wanted), "id")
    kinds = ", ".join(f"{c} int" for c in names)
    got = map_arrow(texts.select("id", F.xxhash64("text").alias("h"), "text", *names), run, f"id long, h long, {kinds}, ids array<int>, dense array<double>").toArrow().to_pandas()
    got = got.sort_values(["id", "h"], kind="stable").drop_duplicates("id")
    lists = [np.asarray(x, np.int64) for x in got["ids"]]
    dense = np.stack(got["dense"].to_list()) if len(got) else np.zeros((0, 6))
    return Chain(categories, Rows(lists, dense), got[names].to_numpy())


def classify(docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text", threshold: float | None = None) -> DataFrame:
    """doc_id, the probability of each category, and is_<last category> (by default from the best out-of-fold F1 on); no shuffle."""
    threshold = chain.threshold if threshold is None else threshold
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    last = f"is_{chain.categories[-1]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = sent.value.probabilities(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(x) for x in p.T], pa.array(p[:, -1] >= threshold)], [id_column, *names, last])

    rows = docs.select(quoted(id_column).cast("long").alias("id"), quoted(text_column).cast("string").alias("text"))
    return map_arrow(rows, run, ", ".join([f"`{id_column}` long", *[f"{c} double" for c in names], f"{last} boolean"]))
