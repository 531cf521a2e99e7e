"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are cut into windows of WINDOW bytes. Two recurrent layers of HIDDEN gated
units read a window's bytes forwards and backwards; at every position both states
give a probability for each language, and a document's probability is the mean
over all positions of its whole text. Gates are ``clip(x + 0.5, 0, 1)`` and the
candidate state is ``x / (1 + |x|)``, both without exponentials.

Training: backpropagation through time with Adam, over all windows of at most
docs_each labelled documents of each language and most_docs in all (those with
the least hash of doc_id). This is the bounded sample of labelled rows a
classifier may be fitted on; every document is then labelled.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0, and so are all texts if no row is labelled; a row without doc_id or
label is not learnt from; NUL bytes are skipped; very long texts are read whole,
in training too; ties go to the language first in order; repeated rows are
labelled each; other columns, whatever their names, make no difference; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import annotate, map_arrow, quoted
from .text import binary, slices

HIDDEN = 8
WINDOW = 96
DOCS_EACH = 200
MOST_DOCS = 20_000
#: All windows are gone through once at least, and few ones more often, in smaller lots, until this many steps are made.
LEAST_STEPS = 400
BATCH = 256
_LETTER = re.compile(r"[^\W\d_]")


class Network:
    """Parameters: for each direction x (3H, 256) and u (3H, H), gates in order update, reset, candidate; v, c for labels."""

    def __init__(self, labels: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"v": draw(len(labels), 2 * hidden, scale=0.3), "c": np.zeros(len(labels), np.float32)}
        for k in "fb":
            self.p[f"x{k}"] = draw(3 * hidden, 256, scale=0.3)
            self.p[f"u{k}"] = draw(3 * hidden, hidden, scale=0.5 / np.sqrt(hidden))

    def _input(self, k: str) -> np.ndarray:
        x = self.p[f"x{k}"].copy()
        x[: self.hidden, 0] = -1e9  # NUL is padding: no update
        return x

    def states(self, k: str, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, H, N) states after each step; ``steps`` (steps, N) bytes in the order in which they are read."""
        hidden, (length, n) = self.hidden, steps.shape
        x, u = self._input(k), self.p[f"u{k}"]
        out = np.empty((length, hidden, n), np.float32)
        h = np.zeros((hidden, n), np.float32)
        gx, gh = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
        a, b = 2 * hidden, 3 * hidden
        tmp = np.empty((hidden, n), np.float32)
        for t in range(length):
            np.take(x, steps[t], axis=1, out=gx, mode="clip")
            np.matmul(u, h, out=gh)
            gates = gx[:a]
            gates += gh[:a]
            gates += np.float32(0.5)
            np.clip(gates, 0, 1, out=gates)
            cand = gx[a:b]
            np.multiply(gates[hidden:], gh[a:b], out=tmp)
            cand += tmp
            np.abs(cand, out=tmp)
            tmp += np.float32(1)
            cand /= tmp
            if keep is not None:
                keep.append((h, gates[:hidden].copy(), gates[hidden:].copy(), cand.copy(), gh[a:b].copy()))
            np.subtract(cand, h, out=tmp)
            tmp *= gates[:hidden]
            np.add(h, tmp, out=out[t])
            h = out[t]
        return out

    def label(self, steps: np.ndarray) -> np.ndarray:
        """(steps, labels, N) probabilities at every position of the windows."""
        forward = self.states("f", steps)
        back = self.states("b", steps[::-1])[::-1]
        v = self.p["v"]
        logits = np.matmul(v[:, : self.hidden], forward)
        logits += np.matmul(v[:, self.hidden :], back)
        logits += self.p["c"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, steps: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean cross-entropy of all positions) and gradients for windows of known labels."""
        length, n = steps.shape
        kept = {"f": [], "b": []}
        forward, back = self.states("f", steps, kept["f"]), self.states("b", steps[::-1], kept["b"])[::-1]
        both = np.concatenate([forward, back], axis=1)
        logits = np.matmul(self.p["v"], both) + self.p["c"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        real = (steps > 0).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(prob[:, target, np.arange(n)] + 1e-9) * real).sum()) / total
        prob[:, target, np.arange(n)] -= 1
        prob *= real[:, None, :] / total
        flat = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        grads = {"v": flat(prob) @ flat(both).T, "c": prob.sum(axis=(0, 2))}
        above = np.matmul(self.p["v"].T, prob)
        grads |= self._through_time("f", steps, kept["f"], above[:, : self.hidden])
        grads |= self._through_time("b", steps[::-1], kept["b"], above[::-1, self.hidden :])
        return loss, grads

    def _through_time(self, k: str, steps: np.ndarray, kept: list, above: np.ndarray) -> dict[str, np.ndarray]:
        hidden, (length, n) = self.hidden, steps.shape
        u = self.p[f"u{k}"]
        du = np.zeros_like(u)
        inputs = np.empty((length, 3 * hidden, n), np.float32)
        dh = np.zeros((hidden, n), np.float32)
        for t in range(length - 1, -1, -1):
            before, z, r, cand, gh = kept[t]
            dh = dh + above[t]
            da = dh * z * (1 - np.abs(cand)) ** 2
            dz = dh * (cand - before) * ((z > 0) & (z < 1))
            dr = da * gh * ((r > 0) & (r < 1))
            inputs[t, :hidden], inputs[t, hidden : 2 * hidden], inputs[t, 2 * hidden :] = dz, dr, da
            down = np.concatenate([dz, dr, da * r])
            du += down @ before.T
            dh = dh * (1 - z) + u.T @ down
        order = np.argsort(steps.ravel(), kind="stable")
        seen, first = np.unique(steps.ravel()[order], return_index=True)
        dx = np.zeros((3 * hidden, 256), np.float32)
        dx[:, seen] = np.add.reduceat(inputs.transpose(1, 0, 2).reshape(3 * hidden, -1)[:, order], first, axis=1)
        return {f"x{k}": dx, f"u{k}": du}

    def fit(self, windows: np.ndarray, targets: np.ndarray, seed: int, rate: float = 0.01) -> float:
        """windows (count, WINDOW) bytes; returns the last epoch's loss."""
        rng = np.random.default_rng(seed)
        lot = min(BATCH, max(32, len(windows) // 8))
        each = -(-len(windows) // lot)
        epochs = -(-LEAST_STEPS // each)
        last = 0.75 * epochs * each  # the steps after it are smaller
        first, second, step, loss = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, 0.0
        for _ in range(epochs):
            order, losses = rng.permutation(len(windows)), []
            for at in range(0, len(order), lot):
                pick = order[at : at + lot]
                loss, grads = self.gradients(np.ascontiguousarray(windows[pick].T), targets[pick])
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    pace = rate * (0.3 if step > last else 1.0)
                    self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def windows_of(offsets: np.ndarray, data: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(steps (size, N), row of each window): all windows of all texts, zeros behind a text's end."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + nth * size
    at = start[None, :] + np.arange(size)[:, None]
    inside = at < offsets[row + 1][None, :]
    steps = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros((size, 0), np.uint8)
    return np.where(inside, steps, np.uint8(0)), row


def predict(network: Network | None, col: pa.Array) -> tuple[list[str], np.ndarray]:
    """Label and score of each text of a slice."""
    texts = col.to_pylist()
    scores = np.zeros(len(texts))
    names = ["und"] * len(texts)
    if network is None:
        return names, scores
    offsets, data = binary(col)
    steps, row = windows_of(offsets, data)
    sums = np.zeros((len(texts), len(network.labels)))
    lot = max(64, 32_768 // max(4, len(network.labels)))  # bounds the probabilities of a lot
    for at in range(0, len(row), lot):
        part = np.ascontiguousarray(steps[:, at : at + lot])
        prob = network.label(part)
        prob *= (part > 0)[:, None, :]
        np.add.at(sums, row[at : at + lot], prob.sum(axis=0, dtype=np.float64).T)
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    for i, text in enumerate(texts):
        if text and total[i] > 0 and _LETTER.search(text):
            names[i], scores[i] = network.labels[best[i]], sums[i, best[i]] / total[i]
    return names, np.clip(scores, 0, 1)


def train(docs: DataFrame, use=None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", hidden: int = HIDDEN, docs_each: int = DOCS_EACH, most_docs: int = MOST_DOCS, seed: int = 11) -> Network | None:
    """A network learnt from labelled rows of ``docs`` for which the boolean Column ``use`` holds; None without any."""
    rows = docs.where(F.coalesce(use, F.lit(False))) if use is not None else docs
    rows = rows.select(quoted(id_column).cast("long").alias("id"), quoted(label_column).cast("string").alias("label"), quoted(text_column).cast("string").alias("text"))
    rows = rows.where("label is not null and id is not null")
    order = F.xxhash64("id", F.lit(seed))
    best = rows.where(F.octet_length("text") > 0).select("id", "label", order.alias("h")).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "id")))
    chosen = best.where(F.col("k") <= docs_each).orderBy("k", "label").limit(most_docs).select("id", "label").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, out = [], []
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                for at in range(0, len(raw), WINDOW):
                    labels.append(label)
                    out.append(raw[at : at + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(out, pa.binary())], ["label", "window"])

    # at most most_docs rows, so they may be broadcast
    sample = map_arrow(rows.join(F.broadcast(chosen), ["id", "label"]), cut, "label string, window binary").toArrow()
    pairs = sorted(zip(sample.column("label").to_pylist(), sample.column("window").to_pylist(), strict=True))
    if not pairs:
        return None
    labels = sorted({p[0] for p in pairs})
    network = Network(labels, hidden, seed)
    windows = np.frombuffer(b"".join(p[1] for p in pairs), np.uint8).reshape(-1, WINDOW)
    network.fit(windows, np.array([labels.index(p[0]) for p in pairs]), seed)
    return network


def identify(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns kept, lang_pred and score of every row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                names, scores = predict(sent.value, part.column("_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*part.schema.names[:-1], "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    names = [f"_{k}" for k in range(len(keep))]
    schema = ", ".join([f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True)] + ["lang_pred string", "score double"])
    out = map_arrow(docs.select(*[quoted(c).alias(n) for n, c in zip(names, keep, strict=True)], quoted(text_column).cast("string").alias("_text")), run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score")


def keep_identified(docs: DataFrame, network: Network | None, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def score(text: pa.Array) -> list[pa.Array]:
        parts = [predict(sent.value, p.column(0)) for p in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text")]
        return [pa.array([s if name != "und" else -1.0 for names, scores in parts for name, s in zip(names, scores.tolist(), strict=True)], pa.float64())]

    scored, (name,) = annotate(docs, text_column, score, {"score": "double"})
    return scored.where(F.col(name) >= least).select(*[quoted(c) for c in docs.columns])
