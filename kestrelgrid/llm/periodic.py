"""Runs of periodic text by the linear-time tandem repeat method of Gusfield and Stoye (2004), over words.

Each document is a string of words, and a slice of documents is treated at once:
a word's symbol is told apart by document, so no repeat crosses documents.

1. Suffix tree. Suffixes are ordered by doubling; only those that aren't alone
   yet go on to the next level. The classes of each level are kept: two places
   have equal classes at level L if their next 2^L words are equal, so common
   extensions in either direction come from a descent over the levels, and those
   of neighbours in suffix order are the depths of the tree's inner nodes. A
   document whose tree has no inner node as deep as a run needs goes no further.
2. Lempel-Ziv blocks: each is the longest piece that occurs earlier, or one word.
3. Leftmost-covering repeats: at each block's begin h, a period k is tested by the
   common extensions of h with h - k (k up to the last block's length) and with
   h + k (k up to this and the next block's length), forward and backward. They
   give the whole stretch of period k around h. The leftmost occurrence of every
   run crosses such a begin (Main's theorem).
4. Vocabulary: from the first square of a stretch suffix links lead to its
   rotations. The suffix link of the leaf of i is the leaf of i + 1, so the r-th
   rotation's node is the ancestor at depth 2k of the leaf of start + r; ancestors
   are found by jumps over the minima of the tree's depths.
5. All leaves below these nodes are the occurrences of all squares; consecutive
   ones of one period merge into runs, and those that are long enough stay.

Memory is about 300 bytes a word of a slice; a slice has SLICE_BYTES or one text.

Defined cases: a null or empty text has no words and no runs; very long texts are
read whole; repeated rows are reported each; of runs with equal exponents the
first, then the shortest period counts; an empty table gives no rows; columns
other than id and text, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow, quoted
from .text import Words, mix, slices

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS = 24
LEAST_TIMES = 3


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(begin, period) from which a document of n words repeats itself, for one document in ten by hash."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    begin = g % n
    return begin, 1 + (n - begin) // (3 + g % 8)


class SuffixTree:
    """Suffixes of the strings of a slice in order, the classes of each level of doubling, and the depths between neighbours."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, most_level: int | None = None):
        """``symbols``: differ between strings; ``ends``: for each place where its string ends."""
        n = len(symbols)
        order = np.argsort(symbols)
        self.symbols, self.n = symbols, n
        new = np.ones(n, bool)
        new[1:] = symbols[order][1:] != symbols[order][:-1]
        firsts = np.flatnonzero(new)
        sizes = np.diff(firsts, append=n)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(firsts, sizes)
        #: class of each place: number of suffixes in lower classes
        self.levels = [rank.astype(np.int32)]
        alone = np.empty(n, bool)
        alone[order] = np.repeat(sizes == 1, sizes)
        active, width = np.flatnonzero(~alone), 1
        while len(active) and (most_level is None or len(self.levels) <= most_level):
            further = active + width
            inside = further < ends[active]
            second = np.zeros(len(active), np.int64)  # 0: the string ends there, as at one place of a class at most
            second[inside] = rank[further[inside]] + 1
            key = rank[active] * (n + 1) + second
            by = np.argsort(key)
            active, key, base = active[by], key[by], rank[active[by]]
            whole = np.flatnonzero(np.diff(base, prepend=-1))
            part = np.flatnonzero(np.diff(key, prepend=-1))
            sizes = np.diff(part, append=len(key))
            offset = np.arange(len(key)) - np.repeat(whole, np.diff(whole, append=len(key)))
            rank[active] = base + np.repeat(offset[part], sizes)
            self.levels.append(rank.astype(np.int32))
            active, width = active[np.repeat(sizes > 1, sizes)], width * 2
        #: places that share their next 2^level words with another one
        self.active = active
        self.rank = rank

    def finish(self) -> None:
        """suffixes: places in order; depth[i]: common words of the suffixes i - 1 and i."""
        self.suffixes = np.empty(self.n, np.int64)
        self.suffixes[self.rank] = np.arange(self.n)
        self.depth = np.zeros(self.n, np.int64)
        self.depth[1:] = self.forward(self.suffixes[:-1], self.suffixes[1:])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on; i and j are of one string and differ."""
        i, j, begin = i.copy(), j.copy(), i
        on = np.arange(len(i))
        # places whose next word differs need no descent
        on = on[self._same(0, i, j)]
        for level in range(len(self.levels) - 1, -1, -1):
            same = self._same(level, i[on], j[on])
            step = np.where(same, 1 << level, 0)
            i[on] += step
            j[on] += step
        return i - begin

    def _same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (i < self.n) & (j < self.n)
        classes = self.levels[level]
        return ok & (classes[np.minimum(i, self.n - 1)] == classes[np.minimum(j, self.n - 1)])

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before i and j."""
        i, j, begin = i.copy(), j.copy(), i
        for level in range(len(self.levels) - 1, -1, -1):
            width = 1 << level
            ok = (i >= width) & (j >= width)
            classes = self.levels[level]
            same = ok & (classes[np.maximum(i - width, 0)] == classes[np.maximum(j - width, 0)])
            step = np.where(same, width, 0)
            i -= step
            j -= step
        return begin - i


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of the next 2^level values from each place on (those that there are)."""
    out, width = [values], 1
    while width < len(values):
        last = out[-1]
        now = last.copy()
        now[:-width] = np.minimum(last[:-width], last[width:])
        out.append(now)
        width *= 2
    return out


def _before(minima: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first place from which on all values up to ``at`` (exclusive) are ``least`` or more."""
    at = at.copy()
    for level in range(len(minima) - 1, -1, -1):
        width = 1 << level
        ok = (at >= width) & (minima[level][np.maximum(at - width, 0)] >= least)
        at = np.where(ok, at - width, at)
    return at


def _after(minima: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first place from ``at`` on whose value is below ``least``, or the end."""
    n = len(minima[0])
    at = at.copy()
    for level in range(len(minima) - 1, -1, -1):
        width = 1 << level
        ok = (at + width <= n) & (minima[level][np.minimum(at, n - 1)] >= least)
        at = np.where(ok, at + width, at)
    return at


def blocks(tree: SuffixTree, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Begins of the Lempel-Ziv blocks of all strings, in order."""
    # the nearest suffixes in order that begin earlier: whichever is nearer in depth is the longest earlier occurrence
    places = tree.suffixes
    minima = _minima(places)
    at = np.arange(tree.n)
    left = _before(minima, at, places + 1) - 1
    right = _after(minima, at, places)
    longest = np.ones(tree.n, np.int64)
    for other, ok in ((left, left >= 0), (right, right < tree.n)):
        i, j = places[ok], places[other[ok]]
        alike = tree.symbols[i] == tree.symbols[j]  # else of another string, or nothing in common
        length = np.zeros(len(i), np.int64)
        length[alike] = tree.forward(i[alike], j[alike])
        longest[i] = np.maximum(longest[i], length)
    out, steps = [], longest.tolist()
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        while begin < end:
            out.append(begin)
            begin += steps[begin]
    return np.array(out, np.int64)


def _stretches(tree: SuffixTree, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the leftmost-covering repeats that are long enough to be runs, with their least periods."""
    block = blocks(tree, begins, ends)
    string_end = ends[np.searchsorted(begins, block, side="right") - 1]
    block_end = np.minimum(np.append(block[1:], tree.n), string_end)
    of = np.repeat(np.arange(len(block)), block_end - block)  # block of each place
    at = np.arange(tree.n)
    follows = np.append(block[1:], tree.n)[of]
    pairs = [(follows, at, follows < string_end[of])]  # the next block's begin with each place of this one
    pairs.append((block[of], at, at > block[of]))  # this block's begin with each further place of it
    previous = np.maximum(of - 1, 0)
    pairs.append((block[previous], at, (of > 0) & (string_end[previous] == string_end[of])))  # and the one before's
    found = []
    for h, q, ok in pairs:
        h, q = h[ok], q[ok]
        same = tree.symbols[h] == tree.symbols[q]
        h, q = h[same], q[same]
        k = np.abs(h - q)
        ahead = tree.forward(h, q)
        long = ahead + k + np.minimum(h, q) >= np.maximum(LEAST_WORDS, LEAST_TIMES * k)
        h, q, k, ahead = h[long], q[long], k[long], ahead[long]
        back = tree.backward(h, q)
        start = np.minimum(h, q) - back
        end = np.maximum(h, q) + ahead
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * k)
        found.append((start[long], end[long], k[long]))
    start, end, k = (np.concatenate(x) for x in zip(*found, strict=True))
    return _least_period(start, end, k)


def _least_period(start: np.ndarray, end: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period, in order."""
    by = np.lexsort((k, end, start))
    start, end, k = start[by], end[by], k[by]
    new = np.ones(len(k), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], k[new]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): first, first + 1, ... of each, as many as its count."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def runs(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the strings begins[i]:ends[i] of ``symbols``, which differ between strings; none is empty."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    tree = SuffixTree(symbols, np.repeat(ends, ends - begins))
    tree.finish()
    start, end, k = _stretches(tree, begins, ends)
    if not len(start):
        return none, none, none
    # rotations of the first square of each stretch, along suffix links, and their nodes
    which, place = _spread(start, k)
    period = k[which]
    minima = _minima(tree.depth)
    at = tree.rank[place]
    low = _before(minima, at + 1, 2 * period) - 1
    high = _after(minima, at + 1, 2 * period)
    nodes = np.unique(np.stack([period, low, high]), axis=1)
    # all leaves below a node begin with its square
    which, leaf = _spread(nodes[1], nodes[2] - nodes[1])
    period, place = nodes[0][which], tree.suffixes[leaf]
    by = np.lexsort((place, period))
    period, place = period[by], place[by]
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(place)) - 1
    start, k = place[firsts], period[firsts]
    end = place[lasts] + 2 * k
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * k)
    return _least_period(start[long], end[long], k[long])


class Slice:
    """The words of a slice of texts after an edit, and the runs among them."""

    def __init__(self, ids: list[int | None], texts: pa.Array, edit: Callable | None):
        words = Words(texts)
        self.words, self.bounds = words, words.bounds
        #: for each word the original word that stands there
        self.source = np.arange(len(words.start))
        self.edited = np.zeros(words.rows, bool)
        for row, (doc_id, n) in enumerate(zip(ids, words.counts.tolist(), strict=True)):
            if edit and (change := edit(doc_id, n)):
                begin, period = change
                first = int(self.bounds[row])
                tail = np.arange(n - begin)
                self.source[first + begin : first + n] = first + begin + tail % period
                self.edited[row] = True
        self.start, self.end, self.period = self._runs()

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, bounds = self.words, self.bounds
        symbols = mix(words.hashes(fold=False)[self.source] + mix(words.row.astype(np.uint64) + np.uint64(1)))
        # a run of least length agrees with itself one period on for so many words
        level = int(np.log2(LEAST_WORDS * (LEAST_TIMES - 1) // LEAST_TIMES))
        top = SuffixTree(symbols, np.repeat(bounds[1:], words.counts), level)
        rows = np.unique(words.row[top.active]) if len(top.levels) > level else np.zeros(0, np.int64)
        del top
        counts = words.counts[rows]
        _, places = _spread(bounds[rows], counts)
        ends = np.cumsum(counts)
        start, end, period = runs(symbols[places], ends - counts, ends)
        return places[start] if len(start) else start, places[end - 1] + 1 if len(end) else end, period

    def dropped(self) -> np.ndarray:
        """For each word whether a run holds it after the run's first period."""
        edges = np.zeros(len(self.source) + 1, np.int64)
        np.add.at(edges, self.start + self.period, 1)
        np.add.at(edges, self.end, -1)
        return np.cumsum(edges[:-1]) > 0

    def rows(self) -> list[tuple]:
        """(n_runs, start, length, period, exponent_milli, runs, collapsed) of each document."""
        words, bounds = self.words, self.bounds.tolist()
        data = words.data.tobytes()
        offsets = words.offsets.tolist()
        gone = self.dropped()
        by_row = np.searchsorted(self.start, self.bounds).tolist()
        all_runs = list(zip(self.start.tolist(), (self.end - self.start).tolist(), self.period.tolist(), strict=True))
        out = []
        for row in range(words.rows):
            first, last = bounds[row], bounds[row + 1]
            found = sorted((s - first, n, q) for s, n, q in all_runs[by_row[row] : by_row[row + 1]])
            found.sort(key=lambda r: (r[0], r[2]))
            if found or self.edited[row]:
                kept = self.source[first:last][~gone[first:last]]
                collapsed = b" ".join([data[a:b] for a, b in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)])
            else:
                collapsed = b" ".join(data[offsets[row] : offsets[row + 1]].split())
            best = (None,) * 4
            if found:
                # exact: different quotients of numbers below 2^31 differ by far more than 2^-64
                start, length, period = min(found, key=lambda r: (-((r[1] << 64) // r[2]), r[0], r[2]))
                best = (start, length, period, 1000 * length // period)
            out.append((len(found), *best, "".join(f"{s},{n},{q}\n" for s, n, q in found), collapsed))
        return out


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edit: Callable[[int | None, int], tuple[int, int] | None] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, number of runs, the one of greatest exponent, hashes of all runs and of the text without their repeats.

    ``edit``: (doc_id, number of words) -> (begin, period) or None: from ``begin`` on
    the document's words repeat with that period. ``with_text`` adds runs and collapsed.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        names, schema = [*names, "runs", "collapsed"], schema + ", runs string, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                rows = Slice(ids.to_pylist(), part.column("text"), edit).rows()
                columns = list(zip(*rows, strict=True))
                listed, collapsed = columns.pop(-2), columns.pop()
                arrays = [ids, *[pa.array(c, pa.int64()) for c in columns]]
                arrays.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()))
                arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in collapsed], pa.string()))
                if with_text:
                    arrays += [pa.array(listed, pa.string()), pa.array([x.decode("utf-8", "replace") for x in collapsed], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), F.coalesce(quoted(text_column).cast("string"), F.lit("")).alias("text"))
    return map_arrow(rows, run, schema)
