"""Block search, periodic runs and spelling variants against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrelgrid.llm import block_search, periodic, spelling
from kestrelgrid.llm.queries import QUERIES

from ..conftest import SF
from .test_operators import SCHEMA, TEXTS, WORD


@pytest.fixture(scope="module")
def docs(spark):
    periodic_texts = [(31, "a b c " * 40), (32, "start " + "x " * 30 + "end " + "x " * 30), (40, "Straße straße strase strasse " * 9), (41, "é" * 7 + " " + "é" * 6 + " ")]
    rows = [(i, t, "en", None, len(t or ""), "clash", "clash", 1, 2, 3, 0.5, 9, 4) for i, t in [*TEXTS, *periodic_texts, *periodic_texts]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- block search

VECTORS = "vec_id long, embedding array<double>, label int, score string, `rank` int, UID int, terms string"


def vectors(spark):
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 0.2) for _ in range(6)]) for k in range(0, 300)]
    rows += [(1000 + k, [0.25, -0.5, 0.125, 0.0, 1.0, 0.75]) for k in range(60)]  # one common vector, with queries in it
    rows += [(2000, None), (2020, [0.1, None, 0.3]), (2040, [float("nan")] * 6), (2060, [0.1, float("inf")]), (2080, []), (2100, [0.5, 0.5]), (None, [0.9] * 6), (20, [0.3] * 6), (20, [0.3] * 6), (-40, [0.2] * 6)]
    return rows, spark.createDataFrame([(i, v, 1, "s", 2, 3, "t") for i, v in rows], VECTORS).repartition(5)


def best_of(rows, k, scale=64):
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = collections.Counter()
    for at, (i, v) in enumerate(good):
        if i is None or i % 20:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j) for other, (j, w) in enumerate(good) if other != at]
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out.update((i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(scores[:k]))
    return out


@pytest.mark.parametrize("size", [16, 40, 4096])
def test_block_search(spark, size, monkeypatch):
    monkeypatch.setattr(block_search, "SHARE", 4)
    rows, df = vectors(spark)
    got = block_search.top_k(df, F.col("vec_id") % 20 == 0, 7, scale=64, range_size=size, block=8)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == best_of(rows, 7)


def test_block_search_few_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert block_search.top_k(none, F.col("vec_id") % 20 == 0, 3).collect() == []
    no_query = spark.createDataFrame([(1, [1.0], 1, "s", 2, 3, "t")], VECTORS)
    assert block_search.top_k(no_query, F.col("vec_id") % 20 == 0, 3).collect() == []
    alone = spark.createDataFrame([(20, [1.0], 1, "s", 2, 3, "t")], VECTORS)
    assert block_search.top_k(alone, F.col("vec_id") % 20 == 0, 3).collect() == []
    huge = spark.createDataFrame([(20, [1e300, 1.0], 1, "s", 2, 3, "t"), (1, [-1e300, 2.0], 1, "s", 2, 3, "t"), (2, [5e7, 2.0], 1, "s", 2, 3, "t")], VECTORS)
    assert [r["vec_id"] for r in block_search.top_k(huge, F.col("vec_id") % 20 == 0, 3).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("magnitude", [30, 3000, 10**8])
def test_range_search_prunes_and_is_exact(magnitude):
    """Blocks that can't reach the kth score aren't scored, in each type of sums."""
    r = np.random.default_rng(3)
    centre = r.integers(-magnitude, magnitude, (16, 8))
    matrix = np.repeat(centre, 32, axis=0) + r.integers(-magnitude // 20, magnitude // 20 + 1, (512, 8))
    shape = block_search.Shape(512, 8, int(np.abs(matrix).max()))
    matrix = matrix.astype(shape.work)
    at = np.arange(0, 512, block_search.BLOCK)
    high, low = np.maximum.reduceat(matrix, at), np.minimum.reduceat(matrix, at)
    ids = r.permutation(512)
    queries = matrix[::7]
    lowest = np.full(len(queries), np.iinfo(np.int64).min if shape.work == np.int64 else -np.inf)
    q, v, s, products = block_search.search_range(queries, ids[::7], lowest.astype(shape.work), matrix, ids, ids, high, low, 5)
    exact = matrix.astype(np.int64)
    for k in range(len(queries)):
        scores = exact @ exact[7 * k]
        order = [j for j in np.lexsort((ids, -scores)) if j != 7 * k][:5]
        assert v[q == k].tolist() == order
        assert s[q == k].astype(np.int64).tolist() == scores[order].tolist()
    assert products < 0.6 * len(queries) * 512


# --- periodic runs


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        x = 0
        while x < len(w) - q:
            y = x
            while y < len(w) - q and w[y] == w[y + q]:
                y += 1
            if y - x + q >= max(24, 3 * q):
                out.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text, edit):
    w = WORD.findall(text or "")
    if edit and (change := periodic.planted(doc_id, len(w))):
        a, p = change
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed, kept = "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_planted_edit():
    for doc_id in range(3000):
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        assert periodic.planted(doc_id, 50) == ((g % 50, 1 + (50 - g % 50) // (3 + g % 8)) if h % 10 == 0 else None)
    assert all(periodic.planted(d, 0) is None for d in range(100))


@pytest.mark.parametrize("edit", [None, periodic.planted])
def test_periodic_runs(docs, edit):
    rows = docs.select("doc_id", "text").collect()
    got = periodic.digests(docs, edit=edit)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain_digest(r["doc_id"], r["text"], edit) for r in rows)


def test_periodic_runs_empty(empty):
    assert periodic.digests(empty).collect() == []


def test_periodic_text(docs):
    row = periodic.digests(docs, with_text=True).where("doc_id = 32").first()
    assert row["runs"] == "1,30,1\n32,30,1\n" and row["collapsed"] == "start x end x"


def random_words(r):
    w = [str(r.randrange(r.choice([1, 2, 2, 3, 50]))) for _ in range(r.choice([0, 5, 30, 100, 300]))]
    for _ in range(r.randint(0, 4)):
        if w:
            begin = r.randrange(len(w))
            unit = w[begin : begin + r.randint(1, max(1, r.choice([3, 10, len(w) // 3 + 1])))]
            piece = (unit * r.randint(2, 30))[: r.randint(1, 150)]
            w[begin:begin] = piece
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w[at:at] = piece  # a copy elsewhere, inside one Lempel-Ziv block
    return w


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    for _ in range(12):
        texts = [" ".join(random_words(r)) for _ in range(r.randint(1, 9))]
        found = periodic.Slice(list(range(len(texts))), pa.array(texts, pa.string()), None).rows()
        assert [x[5] for x in found] == ["".join(f"{s},{n},{q}\n" for s, n, q in plain_runs(t.split())) for t in texts]


def test_lempel_ziv_blocks():
    words = np.array([ord(c) for c in "abaababaabaab"], np.uint64)
    tree = periodic.SuffixTree(words, np.full(13, 13))
    tree.finish()
    assert periodic.blocks(tree, np.array([0]), np.array([13])).tolist() == [0, 1, 2, 3, 6, 11]
    assert [bytes(words[i:].astype(np.uint8)).decode() for i in tree.suffixes] == sorted("abaababaabaab"[i:] for i in range(13))


# --- spelling variants


def plain_words(rows, every=199):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def plain_variants(n, ratio=5):
    near, cut = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            cut[k, less].add(w)
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for same in cut.values():
        for a, b in itertools.permutations(same, 2):
            near[a].add(b)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("every", [1, 3, 199])
def test_words_of_texts(docs, every):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = spelling.counted(spelling.misspell(spelling.runs(docs), every)).collect()
    assert {r["word"]: r["n"] for r in got} == plain_words(rows, every)


def test_spelling_variants(spark, monkeypatch):
    """Random near words of all kinds of edits, chains of forms, ties, and hot keys that are salted."""
    monkeypatch.setattr(spelling, "HOT", 3)
    r = random.Random(2)
    words = set()
    for _ in range(60):
        w = "".join(r.choice("abcdeßéñÿ×À") for _ in range(r.randint(6, 9)))
        words.add(w)
        for _ in range(8):
            k, c = r.randrange(len(w)), r.choice("abcdeßéñÿ×À")
            w = r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            if len(w) >= 6:
                words.add(w)
    words |= {"anagram", "managra", "nagaram", "x" * 70_000, "x" * 70_001}
    n = {w: r.choice([5, 5, 25, 26, 130, 700, 4000]) for w in sorted(words)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(got.columns) == sorted(COLUMNS)
    rows = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
    assert len(rows) == len(n) and set(rows) == plain_variants(n)
    assert any(form and root != form for _, form, root, *_ in rows)


def test_masks(spark):
    """One edit flips two bits at most; an insertion flips one."""
    rows = spark.createDataFrame([("banana", "bananas"), ("garden", "gorden"), ("straße", "strase")], "a string, b string").select(F.bit_count(spelling.mask(F.col("a")).bitwiseXOR(spelling.mask(F.col("b")))).alias("flips")).collect()
    assert [r["flips"] for r in rows] == [1, 2, 2]


def test_spelling_query(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    got = QUERIES["op13_spelling_variants"](spark, SF).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in got} == plain_variants(plain_words(rows))


def test_spelling_empty(empty):
    words = spelling.counted(spelling.misspell(spelling.runs(empty), 199))
    assert spelling.variants(words).collect() == []


def test_periodic_query(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    got = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_digest(i, t, True) for i, t in rows)
