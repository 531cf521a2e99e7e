"""Single passes over sorted rows, where what a row means depends on all rows before it.

Rows are dealt by a key, sorted, and go through a small state over Arrow batches:
memory is the state of one key, not its rows, and a task that is lost is run again.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..sources.shared import written


#: Ranges of a file up to which they are carried one by one: calls of numpy take longer than a few ranges.
FEW = 32


def line_history(hunks: DataFrame, ranges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, file, sha, nth, start, stop): the commits that touched ranges of lines, newest first, each with the range as it was after the commit.

    hunks(file, sha, seq, old_start, old_lines, new_start, new_lines), as diffs
    without context write them (a side without lines names the line before it);
    ``seq`` rises with time and is one a commit. ranges(id, file, start, stop) of the
    newest state, both ends included. Going back through the commits of a file, a
    commit touches a range if a hunk's new lines overlap it, or lines were deleted
    between two lines of it. In the state before, the range is what is left of it,
    moved by the hunks above, together with the old lines of the hunks that touch it;
    it ends where nothing is left. ``most``: commits of a range.

    All ranges of a file are carried through its hunks in one pass, newest first.
    """
    key = {"file": hunks.schema["file"].dataType, "sha": hunks.schema["sha"].dataType, "id": ranges.schema["id"].dataType}
    no = lambda name: F.lit(None).cast(key[name]).alias(name)
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    changes = hunks.where("file is not null").select("file", F.lit(1).alias("kind"), *long("seq", "old_start", "old_lines", "new_start", "new_lines"), "sha", no("id"), *none("start", "stop"))
    wanted = ranges.where("start <= stop").select("file", F.lit(0).alias("kind"), *none("seq", "old_start", "old_lines", "new_start", "new_lines"), no("sha"), "id", *long("start", "stop"))
    rows = wanted.unionByName(changes).repartition("file").sortWithinPartitions("file", "kind", F.col("seq").desc(), "new_start")
    schema = ranges.select("id").schema
    for field in hunks.select("file", "sha").schema.fields:
        schema = schema.add(field)
    schema = schema.add("nth", "long").add("start", "long").add("stop", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(most)
        for batch in batches:
            walk.take(batch)
            if walk.size > 10_000:
                yield walk.result()
        walk.close()
        yield walk.result()

    return rows.mapInArrow(run, schema)


class _Walk:
    """The ranges of the file at hand, half-open, as arrays or, if few, as lists, and the hunks of the commit at hand."""

    def __init__(self, most: int | None):
        self.most, self.file, self.commit = most, None, None
        self.hunks: list[tuple] = []
        self.rows: list[tuple] = []
        self.ids: list | None = None
        self.out: list[tuple] = []
        self.size = 0

    def take(self, batch: pa.RecordBatch) -> None:
        columns = [batch.column(c).to_pylist() for c in ("file", "kind", "seq", "old_start", "old_lines", "new_start", "new_lines", "sha", "id", "start", "stop")]
        for file, kind, seq, old, old_n, new, new_n, sha, range_id, start, stop in zip(*columns, strict=True):
            if file != self.file:
                self.close()
                self.file = file
            if kind == 0:
                self.rows.append((range_id, start, stop))
                continue
            if self.commit != (seq, sha):
                self._apply()
                self.commit = (seq, sha)
            if self.rows:
                # half-open, from 0; a side without lines lies behind the line that it names
                a, p = (new if new_n == 0 else new - 1), (old if old_n == 0 else old - 1)
                self.hunks.append((a, a + new_n, p, p + old_n))

    def close(self) -> None:
        self._apply()
        self.file, self.commit, self.rows, self.ids = None, None, [], None

    def _begin(self) -> None:
        self.ids = [r[0] for r in self.rows]
        self.few = len(self.rows) <= FEW
        if self.few:
            self.live = [[k, r[1] - 1, r[2], 0] for k, r in enumerate(self.rows) if self.most is None or self.most > 0]
            return
        self.low = np.array([r[1] - 1 for r in self.rows], np.int64)
        self.high = np.array([r[2] for r in self.rows], np.int64)
        self.seen = np.zeros(len(self.rows), np.int64)

    def _apply(self) -> None:
        if not self.hunks:
            return
        if self.ids is None:
            self._begin()
        self.hunks.sort()
        s, e, p, q = zip(*self.hunks, strict=True)
        self.hunks = []
        if self.few:
            self._carry(s, e, p, q)
            return
        s, e, p, q = (np.array(x, np.int64) for x in (s, e, p, q))
        live = np.flatnonzero((self.low < self.high) & (self.seen < (self.most or np.iinfo(np.int64).max)))
        a, b = self.low[live], self.high[live]
        # hunks of a commit are in order and apart: those that meet a range are neighbours
        first = np.searchsorted(e, a, side="right")  # the first hunk that ends behind the range's begin
        last = np.searchsorted(s, b, side="left")  # the first hunk that begins at its end or later
        touched = first < last
        moved = np.concatenate([[0], np.cumsum((q - p) - (e - s))])
        inside_first, inside_last = np.minimum(first, len(s) - 1), np.clip(last - 1, 0, len(s) - 1)
        # a deletion at the range's own begin doesn't touch it, and moves it
        begins_in = touched & (s[inside_first] <= a)
        ends_in = touched & (e[inside_last] >= b) & (e[inside_last] > s[inside_last])
        low = np.where(begins_in, p[inside_first], a + moved[first])
        high = np.where(ends_in, q[inside_last], b + moved[last])
        for k in np.flatnonzero(touched).tolist():
            at = int(live[k])
            self.seen[at] += 1
            self.out.append((self.ids[at], self.file, self.commit[1], int(self.seen[at]), int(a[k]) + 1, int(b[k])))
            self.size += 1
        self.low[live], self.high[live] = low, high

    def _carry(self, s: tuple, e: tuple, p: tuple, q: tuple) -> None:
        """What `_apply` does, range by range."""
        moved = [0]
        for k in range(len(s)):
            moved.append(moved[-1] + q[k] - p[k] - e[k] + s[k])
        for row in self.live:
            at, a, b, seen = row
            first, last = bisect_right(e, a), bisect_left(s, b)
            row[1], row[2] = a + moved[first], b + moved[last]
            if first < last:
                if s[first] <= a:
                    row[1] = p[first]
                if e[last - 1] >= b and e[last - 1] > s[last - 1]:
                    row[2] = q[last - 1]
                row[3] = seen + 1
                self.out.append((self.ids[at], self.file, self.commit[1], seen + 1, a + 1, b))
                self.size += 1
        self.live = [r for r in self.live if r[1] < r[2] and (self.most is None or r[3] < self.most)]
        if not self.live:
            self.rows = []  # the file's other hunks meet nothing

    def result(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 6
        self.out, self.size = [], 0
        return pa.RecordBatch.from_pydict(dict(zip(("id", "file", "sha", "nth", "start", "stop"), columns, strict=True)))


def smallest_around(points: DataFrame, ranges: DataFrame, key: list[str], at: str) -> DataFrame:
    """points with ``symbol`` of the smallest range(start, stop, symbol) of their key around ``at``; of equal ones the first by start, then symbol.

    Ranges and points of a key go by in order of place. Ranges that have begun wait on
    a heap, smallest on top; one that ended is dropped when it comes to the top. Points
    that no range holds are left out.
    """
    struct = F.struct(*[F.col(c).alias(c) for c in points.columns]).alias("_point")
    kinds = [F.col(k).alias(f"_key{n}") for n, k in enumerate(key)]
    names = [f"_key{n}" for n in range(len(key))]
    long = lambda c: F.col(c).cast("long")
    a = ranges.where("start <= stop").select(*kinds, long("start").alias("_at"), F.lit(0).alias("_kind"), long("stop").alias("_stop"), F.col("symbol").alias("_symbol"))
    b = points.select(*kinds, long(at).alias("_at"), F.lit(1).alias("_kind"), struct)
    rows = a.unionByName(b, allowMissingColumns=True).dropna(subset=[*names, "_at"]).repartition(*names).sortWithinPartitions(*names, "_at", "_kind")
    schema = StructType([StructField(f.name, f.dataType) for f in rows.select("_point", "_symbol").schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap = None, []
        for batch in batches:
            found, symbols = [], []
            keys = zip(*[batch.column(n).to_pylist() for n in names], strict=True)
            rest = zip(*[batch.column(n).to_pylist() for n in ("_at", "_kind", "_stop", "_symbol")], strict=True)
            for row, (own, (place, kind, stop, symbol)) in enumerate(zip(keys, rest, strict=True)):
                if own != current:
                    current, heap = own, []
                if kind == 0:
                    heapq.heappush(heap, (stop - place, place, symbol is not None, symbol, stop))
                    continue
                while heap and heap[0][4] < place:
                    heapq.heappop(heap)
                if heap:
                    found.append(row)
                    symbols.append(heap[0][3])
            yield pa.RecordBatch.from_arrays([batch.column("_point").take(pa.array(found, pa.int64())).cast(arrow.field(0).type), pa.array(symbols, arrow.field(1).type)], schema=arrow)

    return rows.mapInArrow(run, schema).select("_point.*", F.col("_symbol").alias("symbol"))


def sibling_ends(rows: DataFrame, key: list[str], name: str, line: str, carry: list[str]) -> DataFrame:
    """(key, carry, end_line): the line before the next row of the key whose name doesn't begin with the row's own; rows without one are left out.

    Rows are dealt in ranges of (key, line), so a large key goes to many tasks. In a
    sorted range the open rows are those with whose names all later ones began: a
    chain of prefixes, from which a row closes all that aren't prefixes of its own
    name. What is open at a range's end goes on in the next ranges of its key, of
    which only the first name is needed and where less and less of it is shared.
    """
    columns = [*key, *carry]
    struct = F.struct(*[F.col(c).alias(c) for c in columns]).alias("_row")
    sorted_rows = rows.select(F.xxhash64(*key).alias("_key"), F.col(name).alias("_name"), F.col(line).cast("long").alias("_line"), struct).where("_name is not null and _line is not null")
    sorted_rows = sorted_rows.repartitionByRange("_key", "_line").sortWithinPartitions("_key", "_line", "_name")
    schema = sorted_rows.select(F.lit("").alias("role"), "_key", "_name", "_line", F.lit(0).cast("long").alias("_end"), "_row").schema
    schema = StructType([StructField(f.name, f.dataType) for f in schema.fields])  # what a role lacks is null

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Siblings()
        for batch in batches:
            scan.take(batch)
            yield scan.result(schema_arrow)
        scan.close()
        yield scan.result(schema_arrow)

    schema_arrow = to_arrow_schema(schema)
    found = written(sorted_rows.mapInArrow(run, schema))
    done = found.where("role = 'done'").select("_row", "_end")
    # open rows of keys that go on in a later range: a few a range
    later = found.where("role = 'shares'").select("_key", F.col("_name").alias("shared"), F.col("_line").alias("there"))
    still = found.where("role = 'open'").select(F.monotonically_increasing_id().alias("_tag"), "_key", "_name", "_line", "_row")
    # of the shares of later ranges the first that is too short, or whose range begins otherwise
    hit = still.join(later, "_key").where((F.col("there") > F.col("_line")) & ~F.startswith("shared", F.col("_name")))
    ends = hit.groupBy("_tag").agg(F.first("_row").alias("_row"), (F.min("there") - 1).alias("_end")).drop("_tag")
    return done.unionByName(ends).select("_row.*", F.col("_end").alias("end_line"))


class _Siblings:
    """Open rows of the key at hand, and how much of the range's first name of the key is still shared."""

    def __init__(self):
        self.key, self.open, self.waiting, self.line = None, [], [], None
        self.shared, self.out = None, []

    def take(self, batch: pa.RecordBatch) -> None:
        rows = zip(*[batch.column(c).to_pylist() for c in ("_key", "_name", "_line", "_row")], strict=True)
        for key, name, line, row in rows:
            if key != self.key:
                self.close()
                self.key, self.shared = key, name
                self.out.append(("shares", key, name, line, None, None))
            if line != self.line:
                # rows of one line aren't behind each other
                self.open += self.waiting
                self.waiting, self.line = [], line
            if not name.startswith(self.shared):
                self.shared = _common(self.shared, name)
                self.out.append(("shares", key, self.shared, line, None, None))
            if self.open:
                kept = [o for o in self.open if name.startswith(o[0])]
                if len(kept) < len(self.open):
                    self.out += [("done", key, o[0], o[1], line - 1, o[2]) for o in self.open if not name.startswith(o[0])]
                    self.open = kept
            self.waiting.append((name, line, row))

    def close(self) -> None:
        self.out += [("open", self.key, name, line, None, row) for name, line, row in self.open + self.waiting]
        self.key, self.open, self.waiting, self.line = None, [], [], None

    def result(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 6
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _common(a: str, b: str) -> str:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]
