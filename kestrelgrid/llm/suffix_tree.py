"""Language-model scoring by a probabilistic suffix tree over bytes.

A text is the bytes of its A-Z-lower-cased words, each followed by one space,
and one end symbol: the same events as its words and one end token, so scores
of both models compare. Contexts are the bytes before a position, up to DEPTH.

* Counting: every task counts the (DEPTH + 1)-grams of its training texts and its
  training words; only (gram, count) and (word, count) rows shuffle. Lower orders
  are sums of higher ones.
* Candidates are contexts of SUPPORT occurrences or more, whatever the corpus'
  size: the tree grows with it. A context is retained if the distribution of its
  next symbol diverges from that of its suffix by DIVERGENCE nats or more
  (Kullback-Leibler), or if one that is retained ends in it.
* Contexts that end in the same two symbols are tested in one group, as their
  suffixes are there too. The retained ones are a table.
* A state's distribution is its counts plus its suffix' distribution with WEIGHT
  times the weight of its number of kinds of next symbols; the root has one count
  more for each symbol. So each of the 257 symbols has a probability in each
  state. Most contexts of few occurrences reach over a word's beginning and tell
  little, so their suffix weighs much.
* Scoring looks up each distinct gram of a lot of text in the retained contexts,
  from the shortest to the longest, and adds up log10 probabilities. Contexts go
  to the tasks in parts of about PART rows, of which a task holds one at a time.
  ``Tree`` is the same model in memory, as an automaton.

The unigram base needs a count for every word. Words of count N/2^20 or more, at
most 2^20 of them, go to all tasks; only pairs of document and rarer word
shuffle, to be joined with the counts of all words.

Defined cases: null and empty texts are one end token; a null doc_id is never
held out; with no training text every symbol has probability 1/257 and every
word count 0; very long texts are read whole; repeated rows are learnt from and
scored each; other columns, whatever their names, make no difference; an empty
table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Tags, map_arrow, quoted, written
from .text import _LOWER, _NONWHITE, Words, list_column, slices

DEPTH = 6
SUPPORT = 2
DIVERGENCE = 0.01
WEIGHT = 6
END = 0xFF  # no byte of UTF-8
WINDOW = 192
HEAD = 1 << 20
LOT = 8_000_000
PART = 4_000_000
#: Hash of the end token, no word's but by chance.
END_WORD = np.uint64(0x6B65737472656C21)


def symbols(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(stream, firsts): for each row ``depth`` END, its symbols from firsts[row] on, and END."""
    data, rows = words.data, words.rows
    size = words.end - words.start + 1
    sums = np.concatenate([[0], np.cumsum(size)])
    lengths = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
    firsts = np.concatenate([[0], np.cumsum(lengths + depth + 1)])[:-1] + depth
    out = np.full(int(lengths.sum()) + rows * (depth + 1), END, np.uint8)
    # place of each byte: its row's first, its word's place in the row, its place in the word
    at = np.repeat(firsts - sums[words.bounds[:-1]], words.counts) + sums[:-1]
    inside = _NONWHITE[data]
    out[np.repeat(at - words.start, size - 1) + np.flatnonzero(inside)] = _LOWER[data[inside]]
    out[at + size - 1] = 0x20
    return out, firsts


def grams(stream: np.ndarray, firsts: np.ndarray, depth: int) -> np.ndarray:
    """Code of each predicted symbol: its depth symbols of context and itself, eight bits each, itself lowest."""
    wide = stream.astype(np.uint64)
    code = wide[depth:].copy()
    for k in range(1, depth + 1):
        code |= wide[depth - k : len(wide) - k] << np.uint64(8 * k)
    real = np.ones(len(stream), bool)
    for k in range(1, depth + 1):
        real[firsts - k] = False
    return code[real[depth:]]


class Tally:
    """Counts of 64-bit keys, lot by lot: LOT keys are sorted in place and their runs counted."""

    def __init__(self, kind: int):
        self.kind, self.waiting, self.held = kind, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(keys)
        self.held += len(keys)
        if self.held >= LOT:
            yield from self.drain()

    def drain(self) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        self.waiting, self.held = [], 0
        keys.sort()
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        counts = np.diff(np.concatenate([edge, [len(keys)]]))
        keys = keys[edge].view(np.int64)
        for at in range(0, len(keys), 100_000):
            part = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.kind, np.int8)), pa.array(part), pa.array(counts[at : at + 100_000])], ["kind", "key", "n"])


def _count_rows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tokens = Tally(0), Tally(1)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                yield from codes.add(grams(*symbols(words, depth), depth))
                yield from tokens.add(np.concatenate([words.hashes(), np.full(words.rows, END_WORD)]))
        yield from codes.drain()
        yield from tokens.drain()

    return run


class Tree:
    """States and automaton. Symbols that training never saw share one class, which splits its probability evenly."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], divergence: float, weight: float = WEIGHT):
        """levels[d]: (context code, next symbol, count) of the candidates of depth d, ascending."""
        root = np.zeros(256, np.float64)
        if levels and len(levels[0][0]):
            root[levels[0][1]] = levels[0][2]
        seen = np.flatnonzero(root)
        self.symbol = np.full(256, len(seen), np.int64)
        self.symbol[seen] = np.arange(len(seen))
        width = len(seen) + 1
        missing = 257 - len(seen)
        top = np.concatenate([root[seen] + 1, [missing]]) / (root.sum() + 257)
        self.spread = np.log10(missing)
        # candidates by depth: their smoothed distributions, and whether they are retained
        codes, dists, keeps = [np.zeros(1, np.uint64)], [top[None, :]], [np.ones(1, bool)]
        for d in range(1, len(levels)):
            ctx, nxt, n = levels[d]
            if not len(ctx):
                break
            edge = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            own = ctx[edge]
            parent = np.searchsorted(codes[-1], own & np.uint64((1 << 8 * (d - 1)) - 1))
            base = dists[-1][parent]
            which = np.repeat(np.arange(len(own)), np.diff(np.concatenate([edge, [len(ctx)]])))
            counts = np.zeros((len(own), width))
            np.add.at(counts, (which, self.symbol[nxt]), n)
            total, above = counts.sum(1, keepdims=True), weight * (counts > 0).sum(1, keepdims=True)
            dist = (counts + above * base) / (total + above)
            codes.append(own)
            dists.append(dist)
            keeps.append((dist * np.log(dist / base)).sum(1) >= divergence)
        for d in range(len(codes) - 1, 1, -1):  # suffixes of retained contexts stay
            low = codes[d][keeps[d]] & np.uint64((1 << 8 * (d - 1)) - 1)
            keeps[d - 1][np.searchsorted(codes[d - 1], low)] = True
        self.retained = [c[k] for c, k in zip(codes, keeps, strict=True)]
        self._automaton(codes, dists, keeps, width)

    def _automaton(self, codes, dists, keeps, width: int) -> None:
        """States are the retained contexts and their prefixes; a state's output is its longest retained suffix'."""
        depth = len(codes) - 1
        names = [set() for _ in range(depth + 1)]
        for d in range(depth, 0, -1):
            names[d] |= set(codes[d][keeps[d]].tolist())
            names[d - 1] |= {c >> 8 for c in names[d]}
        names[0] = {0}
        order = [np.array(sorted(x), np.uint64) for x in names]
        first = np.concatenate([[0], np.cumsum([len(x) for x in order])])
        states = int(first[-1])
        go = np.zeros((states, width), np.int32)
        fail = np.zeros(states, np.int64)
        out = np.zeros((states, width), np.float32)
        with np.errstate(divide="ignore"):
            out[0] = np.log10(dists[0][0])
        for d in range(depth + 1):
            if d:
                own = order[d]
                ids = first[d] + np.arange(len(own))
                above = first[d - 1] + np.searchsorted(order[d - 1], own >> np.uint64(8))
                last = self.symbol[(own & np.uint64(255)).astype(int)]
                # the link of a state of depth 1 is the root; go of its parent still holds the link's way here
                fail[ids] = 0 if d == 1 else go[fail[above], last]
                go[ids] = go[fail[ids]]
                out[ids] = out[fail[ids]]
                place = np.searchsorted(codes[d], own)
                place[place == len(codes[d])] = 0
                hit = (codes[d][place] == own) & keeps[d][place]
                out[ids[hit]] = np.log10(dists[d][place[hit]])
            if d < depth and len(order[d + 1]):
                child = order[d + 1]
                above = first[d] + np.searchsorted(order[d], child >> np.uint64(8))
                go[above, self.symbol[(child & np.uint64(255)).astype(int)]] = first[d + 1] + np.arange(len(child))
        out[:, -1] -= self.spread
        self.width, self.depth = width, depth
        self.go, self.out = (go.astype(np.int64) * width).astype(np.int32).ravel(), out.ravel()
        symbol = np.arange(states) * width
        assert symbol[-1] < 2**31

    def score(self, stream: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """log10 probability of each row of a stream whose rows begin with at least ``depth`` END."""
        n = len(stream)
        if not n:
            return np.zeros(0)
        window = min(WINDOW, n)
        lots = -(-n // window)
        padded = np.full(lots * window + self.depth, self.symbol[END], np.int32)
        padded[self.depth : self.depth + n] = self.symbol[stream]
        # row t holds what the windows read at step t; each begins depth symbols early to reach its state
        steps = np.lib.stride_tricks.as_strided(padded, (window + self.depth, lots), (padded.itemsize, window * padded.itemsize))
        at, logs = np.zeros(lots, np.int32), np.empty((window, lots), np.float32)
        place = np.empty(lots, np.int32)
        for t in range(window + self.depth):
            np.add(at, steps[t], out=place)
            if t >= self.depth:
                self.out.take(place, out=logs[t - self.depth], mode="clip")
            self.go.take(place, out=at, mode="clip")
        flat = np.concatenate([[0.0], np.cumsum(logs.T.ravel()[:n], dtype=np.float64)])
        ends = np.concatenate([firsts[1:] - (firsts[0]), [n]])
        return flat[ends] - flat[firsts]


def _low(code: np.ndarray, symbols: int) -> np.ndarray:
    return code & np.uint64((1 << 8 * symbols) - 1)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return place, keys[place] == wanted


class Level:
    """Candidates of a depth: their codes with the weight of their suffix, and (code, next) with its probability, ascending."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, support: int, base, divergence: float, weight: float):
        """pairs: (code, next), sorted; base: gives the probability of the same next symbol after the suffix."""
        ctx = pairs >> np.uint64(8)
        edge = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, int)
        kinds = np.diff(np.concatenate([edge, [len(ctx)]]))
        total = np.add.reduceat(n, edge) if len(edge) else np.zeros(0)
        often = total >= support
        which = np.repeat(often, kinds)
        self.codes, kinds, total = ctx[edge][often], kinds[often], total[often]
        self.pairs, n = pairs[which], n[which]
        self.of = np.repeat(np.arange(len(kinds)), kinds)
        above = weight * kinds
        self.weight = above / (total + above)
        below = base(self.pairs)
        self.p = (n + above[self.of] * below) / (total + above)[self.of]
        # symbols that never follow have the weight's share of the suffix' probability
        seen = np.bincount(self.of, self.p * np.log(self.p / below), len(kinds))
        rest = 1 - np.bincount(self.of, below, len(kinds))
        self.keeps = seen + self.weight * np.log(self.weight) * rest >= divergence

    def probability(self, pairs: np.ndarray) -> np.ndarray:
        return self.p[np.searchsorted(self.pairs, pairs)]


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[edge], np.add.reduceat(n, edge)


def _group(depth: int, support: int, divergence: float, weight: float, first: Level):
    """For the grams whose contexts end in the same two symbols: the retained contexts of depth 2 and more."""

    def run(table: pa.Table) -> pa.Table:
        key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
        levels = [first]
        for d in range(2, depth + 1):
            below = levels[-1]
            level = Level(*_summed(_low(key, d + 1), n), support, lambda pairs, d=d, below=below: below.probability(_low(pairs, d)), divergence, weight)
            if not len(level.codes):
                break
            levels.append(level)
        for d in range(len(levels), 2, -1):  # suffixes of retained contexts stay
            low = _low(levels[d - 1].codes[levels[d - 1].keeps], d - 1)
            levels[d - 2].keeps[np.searchsorted(levels[d - 2].codes, low)] = True
        out = []
        for d, x in enumerate(levels[1:], 2):
            kept = x.keeps[x.of]
            out += [(d, False, x.codes[x.keeps], x.weight[x.keeps]), (d, True, x.pairs[kept], x.p[kept])]
        suffix = int(_low(key[:1] >> np.uint64(8), 2)[0])
        rows = np.array([len(c) for _, _, c, _ in out], np.int64)
        codes = np.concatenate([np.zeros(0, np.uint64), *[c for _, _, c, _ in out]])
        values = np.concatenate([np.zeros(0), *[v for *_, v in out]])
        return pa.table({
            "suffix": pa.array(np.full(len(codes), suffix, np.int32)), "depth": pa.array(np.repeat(np.array([d for d, *_ in out], np.int8), rows)), "pair": pa.array(np.repeat(np.array([x for _, x, *_ in out], bool), rows)),
            "code": pa.array(codes.view(np.int64)), "log": pa.array(np.log10(values).astype(np.float32)),
        })

    return run


class Top:
    """The contexts of no and of one symbol, at most 257, and which part has the longer ones that end in two given symbols."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, support: int, divergence: float, weight: float):
        """pairs: (symbol before, symbol), sorted."""
        ones = np.bincount((pairs & np.uint64(255)).astype(int), n, 256)
        root = (ones + 1) / (ones.sum() + 257)
        self.level = Level(pairs, n, support, lambda x: root[(x & np.uint64(255)).astype(int)], divergence, weight)
        self.root = np.log10(root).astype(np.float32)

    def close(self, suffixes: np.ndarray, part: np.ndarray) -> None:
        """suffixes: the two symbols in which retained contexts end; part: of each."""
        level = self.level
        level.keeps[np.searchsorted(level.codes, np.unique(suffixes & 255).astype(np.uint64))] = True
        self.parts = np.full(1 << 16, -1, np.int32)
        self.parts[suffixes] = part
        self.kept, self.weight = np.zeros(256, bool), np.zeros(256, np.float32)
        self.kept[level.codes[level.keeps].astype(int)] = True
        self.weight[level.codes.astype(int)] = np.log10(level.weight)
        self.pair = np.full(1 << 16, np.nan, np.float32)
        self.pair[level.pairs.astype(int)] = np.log10(level.p)

    def score(self, grams: np.ndarray, parts) -> np.ndarray:
        """log10 probability of each gram. parts(k): (codes, weights, pairs, probabilities) of part k by depth from 2 on."""
        before = (grams >> np.uint64(8) & np.uint64(255)).astype(np.int64)
        out = self.root[(grams & np.uint64(255)).astype(np.int64)]
        pair = self.pair[(grams & np.uint64(65535)).astype(np.int64)]
        out = np.where(self.kept[before], np.where(np.isnan(pair), out + self.weight[before], pair), out)
        part = self.parts[(grams >> np.uint64(8) & np.uint64(65535)).astype(np.int64)]
        for k in np.unique(part[part >= 0]).tolist():
            live = np.flatnonzero(part == k)
            for d, (codes, weights, pairs, logs) in enumerate(parts(k), 2):
                own = _low(grams[live], d + 1)
                place, seen = _at(pairs, own)
                out[live[seen]] = logs[place[seen]]
                place, known = _at(codes, own[~seen] >> np.uint64(8))
                rest = live[~seen][known]
                out[rest] += weights[place[known]]
                stay = seen.copy()
                stay[~seen] = known
                live = live[stay]
                if not len(live):
                    break
        return out


def _sorted_part(table: pa.Table, depth: int) -> list[tuple[np.ndarray, ...]]:
    d, pair = table.column("depth").to_numpy(), table.column("pair").to_numpy()
    code, log = table.column("code").to_numpy().view(np.uint64), table.column("log").to_numpy()
    out = []
    for k in range(2, depth + 1):
        level = ()
        for x in (False, True):
            here = np.flatnonzero((d == k) & (pair == x))
            here = here[np.argsort(code[here])]
            level += (code[here], log[here])
        out.append(level)
    return out


def train(texts: DataFrame, depth: int, support: int, divergence: float, part: int = PART, weight: float = WEIGHT) -> tuple[DataFrame, Top, list]:
    """(words(key, n), the short contexts, the parts of the longer ones as broadcasts) from the texts of texts(text)."""
    spark = texts.sparkSession
    counted = map_arrow(texts.select("text"), _count_rows(depth), "kind byte, key long, n long")
    counted = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    level = counted.where("kind = 0").select("key", "n")
    # at most 2^16 rows
    ones = level.groupBy(F.col("key").bitwiseAND(65535).alias("pair")).agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    top = Top(ones.column("pair").to_numpy().astype(np.uint64), ones.column("n").to_numpy(), support, divergence, weight)
    grouped = level.withColumn("suffix", F.shiftrightunsigned("key", 8).bitwiseAND(65535)).groupBy("suffix")
    kept = written(grouped.applyInArrow(_group(depth, support, divergence, weight, top.level), "suffix int, depth byte, pair boolean, code long, log float"))
    sizes = kept.groupBy("suffix").agg(F.count("*").alias("n")).orderBy("suffix").toArrow()
    suffixes, n = sizes.column("suffix").to_numpy(), sizes.column("n").to_numpy()
    # neighbours share a part
    number = (np.cumsum(n) - n) // part
    number = np.unique(number, return_inverse=True)[1]
    top.close(suffixes, number)
    parts = []
    for k in range(number.max(initial=-1) + 1):
        mine = suffixes[number == k]
        parts.append(spark.sparkContext.broadcast(_sorted_part(kept.where(F.col("suffix").between(int(mine[0]), int(mine[-1]))).drop("suffix").toArrow(), depth)))
        parts[-1].__dict__.pop("_value", None)  # the driver needs no copy but the one it sends
    return counted.where("kind = 1").select("key", "n"), top, parts


def score(docs: DataFrame, held_out=None, depth: int = DEPTH, support: int = SUPPORT, divergence: float = DIVERGENCE, id_column: str = "doc_id", text_column: str = "text", part: int = PART, weight: float = WEIGHT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean Column of ``docs``; its rows are scored but not learnt from.
    """
    spark = docs.sparkSession
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"), out.alias("held_out"))
    words, top, parts = train(rows.where("not held_out"), depth, support, divergence, part, weight)
    tokens, kinds = words.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    head = words.where(F.col("n") >= max(1.0, tokens / HEAD)).toArrow()
    keys = head.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((top, keys[order], head.column("n").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, keys, counts = sent.value

        def level(k: int):
            value = parts[k].value
            if len(parts) > 1:
                parts[k].__dict__.pop("_value", None)  # one part at a time
            return value

        def scored(waiting: list[tuple[list, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            codes = np.concatenate([x[1] for x in waiting])
            order = np.argsort(codes)
            own = codes[order]
            fresh = np.concatenate([[True], own[1:] != own[:-1]])
            logs = np.empty(len(codes), np.float32)
            logs[order] = top.score(own[fresh], level)[np.cumsum(fresh) - 1]
            at = 0
            for columns, part, lengths in waiting:
                flat = np.concatenate([[0.0], np.cumsum(logs[at : at + len(part)], dtype=np.float64)])
                ends = np.cumsum(lengths)
                at += len(part)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat[ends] - flat[ends - lengths])], ["tag", "doc_id", "held_out", "n_tokens", "sum", "hits", "rare", "times", "score"])

        tags = Tags()
        known = np.append(keys, np.uint64(0))
        logs = np.append(np.log10(counts + 1.0), 0.0)
        waiting, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                stream, firsts = symbols(words, depth)
                codes = grams(stream, firsts, depth)
                lengths = np.diff(np.append(firsts, len(stream) + depth)) - depth
                # of each document's words: those in the head add up here, the rest are sent on
                own, back, times = np.unique(words.hashes(), return_inverse=True, return_counts=True)
                place = np.searchsorted(keys, own)
                found = known[place] == own if len(keys) else np.zeros(len(own), bool)
                place[~found] = len(keys)
                sums = np.concatenate([[0.0], np.cumsum(logs[place][back])])[words.bounds]
                hits = np.concatenate([[0], np.cumsum(found[back])])[words.bounds]
                rare = ~found[back]
                pair = np.stack([words.row[rare], back[rare]])
                pair, n = np.unique(pair[0] * max(1, len(own)) + pair[1], return_counts=True)
                row = pair // max(1, len(own))
                sizes = np.bincount(row, minlength=words.rows)
                columns = [pa.array(tags.take(words.rows), pa.int64()), part.column("doc_id"), part.column("held_out"), pa.array(words.counts + 1), pa.array(np.diff(sums)), pa.array(np.diff(hits)), list_column(own[pair % max(1, len(own))].view(np.int64), sizes), list_column(n.astype(np.int32), sizes)]
                waiting.append((columns, codes, lengths))
                held += len(codes)
                if held >= LOT // 2:
                    yield from scored(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from scored(waiting)

    scored = written(map_arrow(rows, run, "tag long, doc_id long, held_out boolean, n_tokens long, sum double, hits long, rare array<long>, times array<int>, score double"))
    pairs = scored.select("tag", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("tag", F.col("p.rare").alias("key"), F.col("p.times").alias("times"))
    # a word of the tail has less than N/2^20 occurrences: no hot key on either side
    found = pairs.join(words, "key").groupBy("tag").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_sum"), F.sum("times").alias("more_hits"))
    end = words.where(F.col("key") == int(np.int64(END_WORD))).agg(F.max("n")).first()[0] or 0
    floor = float(np.log10(tokens + kinds + 1))
    total = F.col("sum") + F.coalesce("more_sum", F.lit(0.0)) + float(np.log10(end + 1))
    return scored.drop("rare", "times").join(found, "tag", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0)) + (1 if end else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
