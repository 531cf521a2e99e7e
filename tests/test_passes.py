"""Sorted passes against plain Python: line history through hunks, siblings, smallest ranges."""

from __future__ import annotations

import collections
import random

import pytest

from kestrelgrid.operators import asof, passes


def random_history(r: random.Random):
    """Hunks of random edits of one file, oldest first, and its number of lines at the end."""
    lines, commits = r.randint(0, 40), []
    for seq in range(r.randint(0, 12)):
        hunks, at, shift = [], 0, 0
        while at <= lines and r.random() < 0.7:
            at += r.randint(0, 8)
            old, new = r.randint(0, min(4, max(0, lines - at))), r.randint(0, 4)
            if at > lines or old + new == 0:
                break
            hunks.append((at if old == 0 else at + 1, old, at + shift if new == 0 else at + shift + 1, new))
            at, shift = at + old + 1, shift + new - old
        if hunks:
            commits.append((seq, hunks))
            lines += shift
    return commits, lines


def plain_history(commits, start, stop):
    """Line by line: each line of the newer state is one of the older state or of a hunk."""
    out, low, high = [], start - 1, stop
    for seq, hunks in reversed(commits):
        if low >= high:
            break
        spans = [((n if nn == 0 else n - 1), nn, (o if on == 0 else o - 1), on) for o, on, n, nn in hunks]
        touched = [h for h in spans if any(low <= x < high for x in range(h[0], h[0] + h[1])) or (h[1] == 0 and low < h[0] < high)]
        if touched:
            out.append((seq, low + 1, high))
        back = lambda x: x + sum(on - nn for s, nn, p, on in spans if s + nn <= x)  # noqa: B023, E731
        kept = [back(x) for x in range(low, high) if not any(s <= x < s + nn for s, nn, *_ in spans)]
        old = [p for *_, p, on in touched] + [p + on for *_, p, on in touched]
        # a hunk that the range ends in brings all its old lines, as do those between
        places = kept + [k + 1 for k in kept] + old
        low, high = (min(places), max(places)) if places else (0, 0)
    return out


@pytest.mark.parametrize("most", [None, 2])
def test_line_history(spark, most):
    r = random.Random(4)
    hunks, ranges, want = [], [], collections.defaultdict(list)
    for file in range(60):
        commits, lines = random_history(r)
        hunks += [(f"f{file}", f"c{seq}", seq, *h) for seq, hs in commits for h in hs]
        for k in range(5):
            start = r.randint(1, max(1, lines))
            stop = r.randint(start, max(start, lines))
            ranges.append((f"f{file}-{k}", f"f{file}", start, stop))
            want[f"f{file}-{k}"] = [(f"c{seq}", a, b) for seq, a, b in plain_history(commits, start, stop)][:most]
    r.shuffle(hunks)
    h = spark.createDataFrame(hunks, "file string, sha string, seq int, old_start int, old_lines int, new_start int, new_lines int").repartition(3)
    w = spark.createDataFrame([*ranges, ("empty", "f1", 5, 4), ("gone", "nofile", 1, 2)], "id string, file string, start int, stop int")
    got = collections.defaultdict(list)
    for row in passes.line_history(h, w, most).orderBy("id", "nth").collect():
        got[row["id"]].append((row["sha"], row["start"], row["stop"]))
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert passes.line_history(h.where("false"), w).count() == 0 and passes.line_history(h, w.where("false")).count() == 0


def test_siblings(spark):
    r = random.Random(6)
    rows = [(r.randrange(3), "".join(r.choice("ab") for _ in range(r.randint(0, 4))), r.randrange(60), k) for k in range(400)]
    rows += [(1, "a", 70, 900), (1, "a", 70, 900), (4, "x", 1, 901)]
    want = collections.Counter()
    for module, name, line, k in rows:
        later = [there for m, n, there, _ in rows if m == module and there > line and not n.startswith(name)]
        if later:
            want[(module, k, min(later) - 1)] += 1
    df = spark.createDataFrame([*rows, (1, None, 3, 1), (1, "n", None, 2)], "module int, name string, line int, k int")
    # many ranges a key, and one
    for parts in (7, 1):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = passes.sibling_ends(df, ["module"], "name", "line", ["k"])
            assert collections.Counter(map(tuple, got.select("module", "k", "end_line").collect())) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" in plan or "MapInArrow" in plan or "Scan parquet" in plan


def test_smallest_ranges(spark):
    r = random.Random(8)
    ranges = [(r.choice("xy"), a := r.randrange(50), a + r.choice([0, 3, 10, 10**9]), k) for k in range(60)]
    points = [(r.choice("xyz"), r.randrange(70), p % 5) for p in range(300)]
    want = collections.Counter()
    for f, at, p in points:
        around = [(stop - start, start, k) for g, start, stop, k in ranges if g == f and start <= at <= stop]
        if around:
            want[(f, at, p, min(around)[2])] += 1
    got = asof.enclosing(spark.createDataFrame(points, "f string, at long, p int"), spark.createDataFrame(ranges, "f string, start long, stop long, symbol int"), ["f"], "at")
    assert got.columns == ["f", "at", "p", "symbol"] and collections.Counter(map(tuple, got.collect())) == want
