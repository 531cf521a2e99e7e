"""N-gram Jaccard join by T-occurrence search, and near-duplicate groups from its links.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with equal sets are one node. Two nodes link when
``100 * intersection >= percent * union``, so with a set of ``n`` shingles a
linked one shares at least ``T = ceil(percent * n / 100)``.

Blocking, exact at every size (no filter or sketch that could fill up):

1. A node sends the first ``n - T + l`` of its shingles in hash order, where
   ``l = n / SPARE``: linked nodes share l or more of those they both sent. Tasks
   count what they send lot by lot, so a shingle of any frequency reaches the
   shuffle once a lot; the sums are exact numbers of holders, and those of
   shingles with two holders or more go back to their lots.
2. A node with fewer shared shingles than a link needs goes no further. The
   others are keyed by their rarest shared ones, as many as the prefix rule asks
   for, ties in hash order; linked nodes have one of these in common, and shared
   passages come last and don't tie blocks together.
3. Nodes of one key form blocks (connected components of first holders). A block
   of more than MOST_ITEMS shingles is keyed again by whole sets (``l = T``): only
   nodes with T shared shingles stay in it, so texts on one template fall apart.

Inside a block each query is a T-occurrence search by DivideSkip: its inverted
lists are ordered by length; the short ones are merged on a heap, which skips
members that too few lists can hold (MergeSkip with threshold T - L), and what
is found is looked up by binary search in each of the L long lists, dropping
members that can no longer reach their threshold. Counts are exact overlaps.
Only classes are wanted, so nodes of one class aren't compared again, and nodes
of the largest class need no query: a link to one outside is found from outside.

A block beyond MOST_ITEMS shingles goes to several tasks. Each holds one part of
its nodes and the block's pivots, a few nodes that tie the parts' classes
together. After that only nodes outside the block's largest class are sent to
the other parts as queries, so a group of copies of any size costs about its own
size; a block in which few nodes are linked costs up to nodes times parts.

Defined cases: texts that are null or have no words have an empty set, link with
nothing and are their own class; fewer words than the width make one shingle;
very long texts are read whole; a class is named by its smallest doc_id (null if
it has none); repeated rows are one node; an empty table gives an empty result;
other columns, whatever their names, stay untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .cluster import Tags, annotate, attach, components, fields_of, map_arrow, quoted, written
from .text import Words, distinct, list_column, set_hash, slices

#: Shingles in one part of a block; a task holds one part, about 60 bytes a shingle.
MOST_ITEMS = 500_000
#: Shingles that a task counts at a time.
LOT = 1_000_000
SPARE = 16
#: Weight of the merge in choosing how many lists count as long; probes here are vectorised and heap steps are not, so it is low.
MU = 0.002
#: Members that a heap merge should pass at most; the shortest lists that must be merged are merged whatever they hold.
MERGE = 2_000
PIVOTS = 8
#: Places of sets (24 bytes each) that are broadcast, at most.
MOST_PLACES = 1_000_000


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, bounds, set hashes) of a column of texts."""
    values, bounds = distinct(*Words(col).shingles(width))
    return values, bounds, set_hash(values, bounds)


def needed(size, percent: int):
    """The least overlap of a set of this size with any linked set."""
    return -(-percent * size // 100)


def spare(size):
    """How many shared shingles the prefixes of two linked sets hold, if this is the smaller size; never falls as it grows."""
    return np.maximum(1, size // SPARE)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] times, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), column.value_lengths().to_numpy()


class Classes:
    """Classes of 0..n-1; the smaller one is relabelled when two join."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = {k: [k] for k in range(n)}

    def join(self, i: int, others: np.ndarray) -> None:
        for other in np.unique(self.of[others]).tolist():
            mine = int(self.of[i])
            if other != mine:
                small, large = sorted((other, mine), key=lambda c: len(self.members[c]))
                moved = self.members.pop(small)
                self.of[moved] = large
                self.members[large] += moved

    def largest(self) -> int:
        return max(self.members, key=lambda c: len(self.members[c]))


def merge_skip(runs: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """Members of ``least`` or more of the ascending runs and in how many they are: a heap merge that skips.

    When the smallest member is in too few runs, the ``least - 1`` smallest heads
    leave the heap: nothing below the next head can be in enough runs, so their
    runs go on from there.
    """
    n = len(runs)
    heap = [run[0] * n + k for k, run in enumerate(runs) if run]
    heapify(heap)
    at, found, times = [0] * n, [], []
    while len(heap) >= least:
        top, out = heap[0] // n, []
        while heap and heap[0] // n == top:
            out.append(heappop(heap) % n)
        if len(out) >= least:
            found.append(top)
            times.append(len(out))
            goal = top + 1
        else:
            while heap and len(out) < least - 1:
                out.append(heappop(heap) % n)
            if not heap:
                break
            goal = heap[0] // n
        for k in out:
            run = runs[k]
            place = at[k] = bisect_left(run, goal, at[k])
            if place < len(run):
                heappush(heap, run[place] * n + k)
    return found, times


class Index:
    """Inverted lists of sets, each list in ascending order of set number."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.sizes = np.diff(bounds)
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[order]
        values = values[order]
        self.starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
        self.lengths = np.diff(np.append(self.starts, len(values)))
        self.keys = values[self.starts]

    def search(self, query: np.ndarray, percent: int, classes: np.ndarray, own, inside: bool = False) -> np.ndarray:
        """Sets that link with the set ``query``, but for those of class ``own``; ``inside``: it is itself one of the sets."""
        size = len(query)
        least = int(needed(size, percent))
        place = np.searchsorted(self.keys, query)
        place[place == len(self.keys)] = 0
        lists = place[self.keys[place] == query] if len(self.keys) else place[:0]
        lists = lists[self.lengths[lists] > inside]  # a list of one holds the query only
        if len(lists) < least:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.lengths[lists], kind="stable")]
        longest = int(self.lengths[lists[-1]])
        long = min(least - 1, int(least / (MU * np.log2(max(2, longest)) + 1)))
        # more lists count as long while the short ones have more than MERGE members
        fits = int(np.searchsorted(np.cumsum(self.lengths[lists]), MERGE, side="right"))
        short = max(len(lists) - (least - 1), min(len(lists) - long, fits))
        long = len(lists) - short
        starts, lengths = self.starts[lists], self.lengths[lists]
        members = self.owners[_ranges(starts[:short], lengths[:short])]
        run = np.repeat(np.arange(short), lengths[:short])
        # linked sets differ little in size
        low, high = least, 100 * size // percent
        other = np.flatnonzero((classes[members] != own) & (self.sizes[members] >= low) & (self.sizes[members] <= high))
        if len(other) < least - long:
            return np.zeros(0, np.int64)
        members, run = members[other], run[other]
        found, times = merge_skip([x.tolist() for x in np.split(members, np.flatnonzero(run[1:] != run[:-1]) + 1)], least - long)
        found, times = np.array(found, np.int64), np.array(times, np.int64)
        both = size + self.sizes[found]
        goal = -(-percent * both // (100 + percent))  # overlap at which these two link
        for k in range(short, len(lists) + 1):
            stay = times + (len(lists) - k) >= goal
            if not stay.all():
                found, times, goal = found[stay], times[stay], goal[stay]
            if k == len(lists) or not len(found):
                break
            run = self.owners[starts[k] : starts[k] + lengths[k]]
            at = np.searchsorted(run, found)
            at[at == len(run)] = 0
            times += run[at] == found
        return found


def classes(values: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """The class of each of a block's sets: the number of its first member."""
    n = len(bounds) - 1
    own, index = Classes(n), Index(values, bounds)

    def query(q: int) -> None:
        found = index.search(values[bounds[q] : bounds[q + 1]], percent, own.of, own.of[q], inside=True)
        if len(found):
            own.join(q, found)

    for q in np.unique(np.linspace(0, n - 1, min(n, PIVOTS)).astype(int)).tolist():
        query(q)
    anchor = own.members[own.largest()][0]
    for q in range(n):
        # any link of the anchor's class to a set outside is found from outside
        if own.of[q] != own.of[anchor]:
            query(q)
    first = np.full(n, n)
    np.minimum.at(first, own.of, np.arange(n))
    return first[own.of]


class Lots:
    """Numbers of lots and of nodes in them, in the order in which a task meets nodes; a lot is full at LOT shingles."""

    def __init__(self, first: int):
        self.lot, self.held, self.numbers = first, 0, {}

    def take(self, sig: int, items: int) -> int | None:
        """The node's number if it is new in its lot."""
        if sig in self.numbers:
            return None
        if self.held >= LOT:
            self.lot, self.held, self.numbers = self.lot + 1, 0, {}
        self.numbers[sig] = number = len(self.numbers)
        self.held += items
        return number


_SENT = "tag long, doc_id long, sig long, n_shingles long, lot long, number int, keys array<long>"


def _sends(width: int, percent: int):
    """Every row as (tag, doc_id, sig, n_shingles, lot, number, keys): number and keys, what a node sends, with its first row in a lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = Tags()
        lots = Lots(tags.next)
        for b in batches:
            for part in slices(b, "text"):
                values, bounds, sigs = shingle_sets(part.column("text"), width)
                sizes = np.diff(bounds)
                sends = sizes - needed(sizes, percent) + spare(sizes)
                lot, number = np.zeros(len(sizes), np.int64), []
                for i, (sig, size, items) in enumerate(zip(sigs.tolist(), sizes.tolist(), sends.tolist(), strict=True)):
                    number.append(lots.take(sig, items) if size else None)
                    lot[i] = lots.lot
                sends[[x is None for x in number]] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tags.take(len(sizes)), pa.int64()), part.column("doc_id"), pa.array(sigs.view(np.int64), mask=sizes == 0), pa.array(sizes.astype(np.int64)), pa.array(lot), pa.array(number, pa.int32()), list_column(values[_ranges(bounds[:-1], sends)].view(np.int64), sends)],
                    ["tag", "doc_id", "sig", "n_shingles", "lot", "number", "keys"],
                )

    return run


def _sends_whole(wanted):
    """Of sets (sig, shingles) those in a filter of nodes, as rows of the same form, all shingles sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = Lots(Tags().next)
        for b in _kept(wanted)(batches):
            sizes = b.column("shingles").value_lengths().to_numpy()
            number, lot = [], np.zeros(len(sizes), np.int64)
            for i, (sig, size) in enumerate(zip(b.column("sig").to_pylist(), sizes.tolist(), strict=True)):
                number.append(lots.take(sig, size))
                lot[i] = lots.lot
            fresh = pa.array([x is not None for x in number], pa.bool_())
            rows = pa.RecordBatch.from_arrays([b.column("sig"), pa.array(sizes.astype(np.int64)), pa.array(lot), pa.array(number, pa.int32()), b.column("shingles")], ["sig", "n_shingles", "lot", "number", "keys"])
            yield rows.filter(fresh)

    return run


def _kept(wanted):
    """Rows whose sig is in a filter of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(bloom.holds(bitmap, b.column("sig").to_numpy()), pa.bool_()))

    return run


def _lot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, number, lot, more) of runs of rows (lot, number, keys): the holder of a key, or, in ``more``, its holders."""

    def counted(lot: int, keys: np.ndarray, holders: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys, kind="stable")
        keys, holders = keys[order], holders[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(first, len(keys)))
        for at in range(0, len(first), 100_000):
            one, times = first[at : at + 100_000], n[at : at + 100_000]
            several = times > 1
            held = np.where(several, times, 0)
            more = list_column(holders[_ranges(one, held)], held)
            more = pa.ListArray.from_arrays(more.offsets, more.values, mask=pa.array(~several))
            # in this order rows compress best: what differs from row to row stands together
            yield pa.RecordBatch.from_arrays([pa.array(keys[one]), pa.array(holders[one], mask=several), pa.array(np.full(len(one), lot)), more], ["key", "number", "lot", "more"])

    now, waiting = None, []
    drained = lambda: counted(now, np.concatenate([k for k, _ in waiting]), np.concatenate([h for _, h in waiting]))
    for batch in batches:
        values, lengths = _flat(batch.column("keys"))
        holders = np.repeat(batch.column("number").to_numpy(), lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        lots = batch.column("lot").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], lots[1:] != lots[:-1], [True]])) if len(lots) else np.zeros(1, int)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if lots[a] != now and waiting:
                yield from drained()
                waiting = []
            now = int(lots[a])
            waiting.append((values[ends[a] : ends[z]], holders[ends[a] : ends[z]]))
    if waiting:
        yield from drained()


_PICKED = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("other", pa.int64())])


def _picks(percent: int, whole: bool):
    """For a lot's nodes and their shared shingles: (key, sig) of the first holder of each key, and (sig, other) of later holders."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PICKED.empty_table()
        numbers = left.column("number").to_numpy()
        sigs, sizes = np.zeros(numbers.max() + 1, np.int64), np.zeros(numbers.max() + 1, np.int64)
        sigs[numbers], sizes[numbers] = left.column("sig").to_numpy(), left.column("n_shingles").to_numpy()
        single = right.filter(right.column("number").is_valid())
        several = right.filter(right.column("number").is_null())
        holders, times = _flat(several.column("more"))
        row = np.concatenate([single.column("number").to_numpy(), holders]).astype(np.int64)
        keys, df = (np.concatenate([single.column(c).to_numpy(), np.repeat(several.column(c).to_numpy(), times)]) for c in ("key", "df"))
        least = needed(sizes, percent)
        length = np.bincount(row, minlength=len(sigs)) - (least if whole else spare(least)) + 1
        take = np.flatnonzero((length > 0)[row])
        take = take[np.lexsort((keys[take], df[take], row[take]))]  # rarest first
        row, keys = row[take], keys[take]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        pick = nth < length[row]
        keys, owners = keys[pick], sigs[row[pick]]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        holder = np.repeat(owners[first], np.diff(np.append(first, len(keys))))
        links = np.unique(np.stack([owners, holder])[:, owners != holder], axis=1)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.concat_tables([
            pa.Table.from_arrays([pa.array(keys[first]), pa.array(owners[first]), none(len(first))], schema=_PICKED),
            pa.Table.from_arrays([none(links.shape[1]), pa.array(links[0]), pa.array(links[1])], schema=_PICKED),
        ])

    return run


def _blocks(table: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(node, root) of the nodes that may link; linked nodes have the same root."""
    sent = table.where("number is not null")
    counted = map_arrow(sent.select("lot", "number", "keys"), _lot_counts, "key long, number int, lot long, more array<int>")
    # of a key there is one row a lot
    holders = F.sum(F.when(F.col("more").isNull(), 1).otherwise(F.size("more"))).over(Window.partitionBy("key"))
    shared = counted.withColumn("df", holders).where("df > 1")
    picked = written(sent.select("lot", "number", "sig", "n_shingles").groupBy("lot").cogroup(shared.groupBy("lot")).applyInArrow(_picks(percent, whole), "key long, sig long, other long"))
    held = picked.where("other is null").select("sig", F.min("sig").over(Window.partitionBy("key")).alias("other")).where("sig <> other")
    return components(picked.where("other is not null").select("sig", "other").unionAll(held).toDF("a", "b"))


def _sized(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks (node, root) with n_shingles of the node and items (shingles) of the block, written."""
    nodes = written(blocks.join(sizes, "node"))
    return written(nodes.join(nodes.groupBy("root").agg(F.sum("n_shingles").alias("items")), "root"))


def _filter(nodes: DataFrame):
    """A broadcast filter of the column ``node`` of nodes."""
    return nodes.sparkSession.sparkContext.broadcast(bloom.build(nodes, "node", bloom.cells_for(nodes.count()), repeats=False).tobytes())


def groups(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sig (null without words), n_shingles, component_id, first (it stays)."""
    texts = docs.select(quoted(id_column).cast("long").alias("doc_id"), quoted(text_column).cast("string").alias("text"))
    table = written(map_arrow(texts, _sends(width, percent), _SENT))
    sizes = table.where("number is not null").groupBy(F.col("sig").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
    blocks = _sized(_blocks(table, percent, whole=False), sizes)
    sets = written(map_arrow(texts.select("text"), _sets(width, _filter(blocks)), "sig long, shingles array<long>"))
    large = blocks.where(F.col("items") > MOST_ITEMS).select("node", "n_shingles")
    if not large.isEmpty():
        # the filter lets a few others through, which only makes the shared shingles of these more
        again = written(map_arrow(sets, _sends_whole(_filter(large)), "sig long, n_shingles long, lot long, number int, keys array<long>"))
        blocks = written(blocks.where(F.col("items") <= MOST_ITEMS).unionByName(_sized(_blocks(again, percent, whole=True), large)))
        keep = _filter(blocks)
        sets = map_arrow(sets, _kept(keep), "sig long, shingles array<long>")
    return _labelled(table.drop("keys"), _verified(sets, blocks, percent))


def _sets(width: int, wanted):
    """(sig, shingles) of nodes in the filter, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, done = np.frombuffer(wanted.value, np.uint8), set()
        for b in batches:
            for part in slices(b, "text"):
                values, bounds, sigs = shingle_sets(part.column(0), width)
                sizes, take = np.diff(bounds), []
                for i in np.flatnonzero(bloom.holds(bitmap, sigs) & (sizes > 0)).tolist():
                    if (sig := int(sigs[i])) not in done:
                        done.add(sig)
                        take.append(i)
                if take:
                    flat = values[_ranges(bounds[:-1][take], sizes[take])]
                    yield pa.RecordBatch.from_arrays([pa.array(sigs[take].view(np.int64)), list_column(flat.view(np.int64), sizes[take])], ["sig", "shingles"])

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(row without its set, set) of each row (..., shingles)."""
    for batch in batches:
        flat, lengths = _flat(batch.column("shingles"))
        edge = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        rows = zip(*(c.to_pylist() for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "shingles"), strict=True)
        for k, row in enumerate(rows):
            yield row, flat[edge[k] : edge[k + 1]]


def _packed(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def _compare(percent: int):
    """Rows (root, part, sig, shingles), runs of one root and part, to (sig, root, least sig of its class in the part)."""

    def of_part(root: int, held: dict[int, np.ndarray]) -> pa.RecordBatch:
        sigs = np.array(sorted(held, key=lambda s: len(held[s])))
        own = classes(*_packed([held[s] for s in sigs.tolist()]), percent)
        least = sigs.copy()
        np.minimum.at(least, own, sigs)
        return pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(np.full(len(sigs), root)), pa.array(least[own])], ["sig", "root", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}  # several tasks may have sent one node
        for (root, part, sig), shingles in _each(batches):
            if (root, part) != now:
                if len(held) > 1:
                    yield of_part(now[0], held)
                now, held = (root, part), {}
            held[sig] = shingles
        if len(held) > 1:
            yield of_part(now[0], held)

    return run


def _probe(percent: int):
    """Rows (root, part, asks, sig, class, shingles), members before those that ask, to pairs of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index, found = None, {}, None, set()
        for (root, part, asks, sig, own), shingles in _each(batches):
            if (root, part) != now:
                now, held, index = (root, part), {}, None
            if not asks:
                held[sig] = (own, shingles)
                continue
            if index is None:
                of = np.array([c for c, _ in held.values()], np.int64)
                index = Index(*_packed([s for _, s in held.values()])) if held else Index(shingles[:0], np.zeros(1, int))
            found |= {(own, c) for c in of[index.search(shingles, percent, of, own)].tolist()}
            if len(found) > 100_000:
                yield pairs(found)
                found = set()
        if found:
            yield pairs(found)

    def pairs(found: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _dealt(sets: DataFrame, places: DataFrame, *order: str) -> DataFrame:
    """Sets at all their places (sig, root, part, ...), a part in one task. Up to MOST_PLACES places go to all tasks, so sets shuffle once."""
    if places.count() <= MOST_PLACES:
        places = F.broadcast(places)
    return sets.join(places, "sig").repartition("root", "part").sortWithinPartitions("root", "part", *order)


def _verified(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(sig, class) of nodes that link, after exact comparison."""
    parts = F.ceil(F.col("items") / MOST_ITEMS).cast("int")
    nodes = written(blocks.select(F.col("node").alias("sig"), "root", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")))
    most = nodes.agg(F.max("parts")).first()[0] or 0
    spread = nodes.select("sig", "root", "part")
    large = nodes.where("parts > 1")
    others = F.explode(F.expr("filter(sequence(0, parts - 1), p -> p <> part)"))
    if most > 1:
        pivots = large.groupBy("root", F.pmod("sig", F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct("sig", "parts", "part")).alias("p")).select("p.*", "root")
        spread = spread.unionByName(pivots.select("sig", "root", others.alias("part")))
    joined = _dealt(sets, spread).select("root", "part", "sig", "shingles")
    found = written(map_arrow(joined, _compare(percent), "sig long, root long, least long"))
    if most <= 1:
        return found.select("sig", F.col("least").alias("class"))
    # classes of large blocks: parts meet in the pivots
    roots = written(large.select("root").distinct())
    edges = written(found.join(roots, "root", "left_semi").select(F.col("sig").alias("a"), F.col("least").alias("b")))
    tied = components(edges).select(F.col("node").alias("sig"), F.col("root").alias("class"))
    labels = written(large.join(tied, "sig", "left").withColumn("class", F.coalesce("class", "sig")))
    top = labels.groupBy("root", "class").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("top"))
    labels = written(labels.join(top, "root"))
    asking = labels.where("class <> top").select("sig", "root", others.alias("part"), "class", F.lit(1).alias("asks"))
    rows = labels.select("sig", "root", "part", "class", F.lit(0).alias("asks")).unionByName(asking)
    joined = _dealt(sets, rows, "asks").select("root", "part", "asks", "sig", "class", "shingles")
    linked = map_arrow(joined, _probe(percent), "a long, b long")
    last = components(edges.unionAll(linked)).select(F.col("node").alias("sig"), F.col("root").alias("class"))
    return found.join(roots, "root", "left_anti").select("sig", F.col("least").alias("class")).unionByName(last)


def _labelled(table: DataFrame, found: DataFrame) -> DataFrame:
    """Carries classes from nodes to rows; a node of very many rows is salted."""
    place = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("tag").alias("t"))).alias("place")
    nodes = table.where("sig is not null").groupBy("sig").agg(place, F.count("*").alias("rows"))
    nodes = written(nodes.join(found, "sig", "left").withColumn("class", F.coalesce("class", "sig")))
    total, = nodes.agg(F.sum("rows")).first()
    top = nodes.groupBy("class").agg(F.min("place").alias("top"), F.count("*").alias("nodes"))
    nodes = attach(nodes.withColumn("spread", F.xxhash64("sig")), top, ["class"], "nodes", total or 0, "spread").select("sig", "rows", "top")
    rows = attach(table.where("sig is not null").select("tag", "doc_id", "sig", "n_shingles"), nodes, ["sig"], "rows", total or 0, "tag")
    rows = rows.select("doc_id", "sig", "n_shingles", F.col("top.i").alias("component_id"), (F.col("tag") == F.col("top.t")).alias("first"))
    empty = table.where("sig is null").select("doc_id", "sig", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return rows.unionAll(empty)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when of each class only one row of the smallest doc_id does, with all columns.

    Only rows whose set may be among those dropped shuffle; the rest pass
    through. Of rows that share doc_id and set, each task sends one.
    """
    spark = docs.sparkSession
    labels = written(groups(docs, width, percent, id_column, text_column).where("sig is not null").select("doc_id", "sig", "first"))
    gone = written(labels.groupBy("doc_id", "sig").agg(F.max("first").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"))
    n = gone.count()
    if not n:
        return docs
    bits = spark.sparkContext.broadcast(bloom.build(gone, "sig", bloom.cells_for(n), repeats=False).tobytes())

    def test(text: pa.Array) -> list[pa.Array]:
        found, bitmap = [], np.frombuffer(bits.value, np.uint8)
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
            _, bounds, sigs = shingle_sets(part.column(0), width)
            found.append((sigs.view(np.int64), bloom.holds(bitmap, sigs) & (np.diff(bounds) > 0)))
        sigs, maybe = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, bool))
        return [pa.array(sigs), pa.array(maybe)]

    tested, (sig, maybe) = annotate(docs, text_column, test, {"sig": "long", "maybe": "boolean"})
    columns = [quoted(c) for c in docs.columns]
    # rows of one set and doc_id are of one class, which one of them at most may stay for
    rows = tested.where(maybe).select(F.col(sig).alias("_sig"), quoted(id_column).cast("long").alias("_id"), F.struct(F.xxhash64(F.to_json(F.struct(*columns))).alias("h")).alias("order"), F.struct(*columns).alias("row"))
    best = rows.groupBy("_sig", "_id").agg(F.min_by("row", "order").alias("row"))
    gone = gone.where("not stays").select(F.col("doc_id").alias("_gone_id"), F.col("sig").alias("_gone_sig"))
    unsure = best.join(gone, (F.col("_sig") == F.col("_gone_sig")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left_anti")
    return tested.where(f"not {maybe}").select(*columns).unionAll(unsure.select(*fields_of("row", docs.columns)))
