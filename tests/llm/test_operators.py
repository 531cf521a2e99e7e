"""Every operator against a brute-force version on awkward small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrelgrid.llm import bloom, bpe, cluster, exact_dedup, fingerprint, langid, length_histogram, mixing, pii, set_join, suffix_tree, toxicity
from kestrelgrid.llm.queries import ORACLES, QUERIES, vocabulary
from kestrelgrid.llm.text import Words

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that clash with the operators' own columns, some in another case, and one that needs quotes.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SHA string, row string, Size int, SIG long, tag long, Score double, N_Tokens int, `a.b` int"
LONG = "alpha beta gamma delta " * 3000
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, "The cat sat."), (2, "the  cat\tsat."), (3, None), (4, ""), (5, " \n\t"), (6, "Thecat sat.!"), (7, "The cat sat."), (7, "The cat sat."), (None, "no id here at all"),
    (None, None), (9, LONG), (10, LONG + "x"), (11, BASE), (12, BASE + " tail"), (13, "tail " + BASE), (14, BASE.replace("w5 ", "zz ")), (15, "é ñ  ü x" * 5), (16, "one two"), (17, "ONE TWO"),
    (18, "x" * 5000), (19, "12345678 " * 40), (20, " wide space \x1c here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is None or i % 2 else "fr", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "clash", "clash", 1, 2, 3, 0.5, 9, 4) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    """Classes by plain union-find."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_word_kernel():
    texts = [t for _, t in TEXTS]
    w = Words(pa.array(texts, pa.string()))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    seen = {}
    for word, h in zip(flat, w.hashes().tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_repeat_filter_keeps_every_repeat(spark):
    keys = [k * 7919 for k in range(2000)] + [k * 7919 for k in range(0, 2000, 10)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    bits = bloom.build(df, "k", bloom.cells_for(len(keys)), repeats=True)
    maybe = bloom.holds(bits, np.array(keys, np.int64).view(np.uint64))
    counts = collections.Counter(keys)
    assert all(m for k, m in zip(keys, maybe, strict=True) if counts[k] > 1)
    assert sum(m for k, m in zip(keys, maybe, strict=True) if counts[k] == 1) < 200


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (99, 101)] + [(7, 7)]
    rows = cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**{k: 0 for k in range(41)}, 99: 99, 100: 99, 101: 99}


def test_salted_join(spark):
    rows = spark.range(30_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("spread"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert cluster.attach(rows, groups, ["k"], "n", 30_000, "spread").count() == 30_000


def test_exact_dedup(docs):
    rows = exact_dedup.find_repeats(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append((-len(t or ""), i is None, i))
    assert len(rows) == len(TEXTS)
    for sha, members in groups.items():
        got = [r for r in rows if r["text_sha256"] == sha]
        assert {r["group_size"] for r in got} == {len(members)}
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        assert {r["keep_id"] for r in got} == {best[2]}
        assert sum(r["kept"] for r in got) == 1
    kept = exact_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_false_positives_only_shuffle(docs, monkeypatch):
    monkeypatch.setattr(bloom, "cells_for", lambda keys, each=16: 1 << 16)
    monkeypatch.setattr(exact_dedup, "repeat_filter", lambda table, total: np.full(1 << 13, 255, np.uint8))
    assert exact_dedup.drop_repeats(docs).count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS})


@pytest.mark.parametrize("width,percent,items", [(4, 85, 200_000), (5, 80, 200_000), (2, 50, 100)])
def test_ngram_join(docs, monkeypatch, width, percent, items):
    monkeypatch.setattr(set_join, "MOST_ITEMS", items)
    rows = set_join.groups(docs, width, percent).collect()
    sets = []
    for i, t in TEXTS:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    own = Union(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                own.join(a, b)
    members = collections.defaultdict(list)
    for k, (i, _) in enumerate(TEXTS):
        members[own.find(k)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    expected = collections.Counter((i, len(sets[k]), least(members[own.find(k)])) for k, (i, _) in enumerate(TEXTS))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == expected
    assert sum(r["first"] for r in rows) == len(members)


def test_keep_one(docs):
    kept = set_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 11 in ids and not {12, 13} & set(ids) and ids.count(3) == 1
    # one row of a class: the first of equal texts, and one of repeated rows
    assert ids.count(1) == 1 and 7 not in ids and kept.count() == len({r["component_id"] for r in set_join.groups(docs, 5, 80).where("sig is not null").collect()}) + set_join.groups(docs, 5, 80).where("sig is null").count()
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, set_join.keep_one(docs.repartition(5), 5, 80).collect()))


def random_sets(rng, n, size, pool):
    sets = [np.unique(rng.choice(pool, size)) for _ in range(n)]
    for k in range(n // 2):
        s = sets[k].copy()
        s[rng.integers(0, len(s), 2)] = rng.integers(0, 2**62, 2)
        sets.append(np.unique(s))
    return sets


@pytest.mark.parametrize("mu", [0.0085, 0.5, 1000.0])
def test_t_occurrence_search_is_exact(monkeypatch, mu):
    monkeypatch.setattr(set_join, "MU", mu)
    rng = np.random.default_rng(3)
    sets = random_sets(rng, 60, 60, rng.integers(0, 2**62, 400))
    index = set_join.Index(*set_join._packed(sets))
    for percent in (50, 85):
        for q in range(len(sets)):
            of = np.zeros(len(sets), int)
            of[q] = 1
            want = {k for k, s in enumerate(sets) if k != q and 100 * len(np.intersect1d(s, sets[q])) >= percent * len(np.union1d(s, sets[q]))}
            assert set(index.search(sets[q], percent, of, 1).tolist()) == want
            assert set(index.search(sets[q], percent, of, 1, inside=True).tolist()) == want


def test_heap_merge_skips():
    rng = np.random.default_rng(4)
    for _ in range(200):
        runs = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).tolist() for _ in range(rng.integers(1, 9))]
        counts = collections.Counter(x for run in runs for x in run)
        for least in range(1, len(runs) + 1):
            assert dict(zip(*set_join.merge_skip(runs, least), strict=True)) == {x: n for x, n in counts.items() if n >= least}


@pytest.mark.parametrize("items", [60, 500, 10**6])
def test_large_blocks(spark, monkeypatch, items):
    """Groups of near copies, chains of them, and texts on one template, in one part and in many; compared with all pairs."""
    monkeypatch.setattr(set_join, "MOST_ITEMS", items)
    rng, rows = np.random.default_rng(6), []
    word = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    base, template, chain = word(60), word(40), word(80)
    for _ in range(60):
        w = list(base)
        w[rng.integers(0, 60)] = word(1)[0]
        rows.append(" ".join(w))
    rows += [" ".join(template + word(25)) for _ in range(40)]
    for k in range(12):
        rows.append(" ".join(chain[4 * k : 4 * k + 40]))
    rows += [" ".join(word(30)) for _ in range(10)] + rows[:5]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    sets = [frozenset(tuple(w[k : k + 2]) for k in range(len(w) - 1)) for w in map(words, rows)]
    own = Union(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                own.join(a, b)
    least = {}
    for k in range(len(sets)):
        least[own.find(k)] = min(least.get(own.find(k), k), k)
    got = {r["doc_id"]: r["component_id"] for r in set_join.groups(docs, 2, 80).collect()}
    assert got == {k: least[own.find(k)] for k in range(len(sets))}
    assert set_join.keep_one(docs, 2, 80).count() == len(least)


def test_suffix_tree_base(docs):
    held = F.col("doc_id") % 5 == 0
    rows = suffix_tree.score(docs, held).collect()
    train = collections.Counter(x for i, t in TEXTS if not (i is not None and i % 5 == 0) for x in [*words(t), None])
    n, v = sum(train.values()), len(train)
    want = collections.Counter()
    for i, t in TEXTS:
        tokens = [*words(t), None]
        want[(i, bool(i is not None and i % 5 == 0), len(tokens), sum(train[x] > 0 for x in tokens), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens), 6))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def _levels(texts, depth, least):
    counts = collections.Counter()
    for t in texts:
        s = bytes([255]) * depth + b"".join(x.encode() + b" " for x in words(t)) + bytes([255])
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                counts[(s[k - d : k], s[k])] += 1
    out = []
    for d in range(depth + 1):
        total = collections.Counter()
        for (c, _), n in counts.items():
            if len(c) == d:
                total[c] += n
        rows = sorted((int.from_bytes(c, "big"), x, n) for (c, x), n in counts.items() if len(c) == d and total[c] >= least)
        out.append(tuple(np.array(v, t) for v, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True)))
    return out


def test_suffix_tree_states():
    """Scores equal those of the longest retained suffix, looked up one position at a time; distributions sum to one."""
    texts, depth = ["the cat sat on the mat", "the cat ate the rat", "Ça va, the end", "", None], 4
    tree = suffix_tree.Tree(_levels(texts, depth, 2), 0.05)
    retained = [set(x.tolist()) for x in tree.retained]
    assert sum(len(x) for x in retained) > 10
    for d in range(2, len(retained)):
        assert all((c & ((1 << 8 * (d - 1)) - 1)) in retained[d - 1] for c in retained[d])
    table = 10.0 ** tree.out.reshape(-1, tree.width).astype(float)
    spread = table[:, :-1].sum(1) + table[:, -1] * 10**tree.spread
    assert np.allclose(spread, 1, atol=1e-5)
    levels = _levels(texts, depth, 2)

    def distribution(code, d):
        ctx, nxt, n = levels[d]
        mine = {int(x): int(c) for q, x, c in zip(ctx, nxt, n, strict=True) if int(q) == code}
        if d == 0:
            total = sum(mine.values()) + 257
            return {x: (mine.get(x, 0) + 1) / total for x in range(256)}
        base, total = distribution(code & ((1 << 8 * (d - 1)) - 1), d - 1), sum(mine.values())
        above = suffix_tree.WEIGHT * len(mine)
        return {x: (mine.get(x, 0) + above * base[x]) / (total + above) for x in range(256)}

    for text in ["the cat sat", "the zebra", "q", ""]:
        s = bytes([255]) * depth + b"".join(x.encode() + b" " for x in words(text)) + bytes([255])
        want = 0.0
        for k in range(depth, len(s)):
            d = max(d for d in range(len(retained)) if int.from_bytes(s[k - d : k], "big") in retained[d])
            want += math.log10(distribution(int.from_bytes(s[k - d : k], "big"), d)[s[k]])
        assert tree.score(*suffix_tree.symbols(Words(pa.array([text])), depth))[0] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("part", [50, 10**6])
def test_suffix_tree_parts(spark, part):
    """The tree in parts gives the scores of the tree in memory."""
    texts, depth = ["the cat sat on the mat", "the cat ate the rat", "Ça va, the end", "", None, "on the mat the cat"], 6
    others = ["the cat sat", "the zebra", "q", "", "the cat sat on the mat ate the rat"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100 + i, t, True) for i, t in enumerate(others)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(2)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("held"), depth, 2, 0.05, part=part).collect()}
    tree = suffix_tree.Tree(_levels(texts, depth, 2), 0.05)
    for i, t, _ in rows:
        assert got[i] == pytest.approx(tree.score(*suffix_tree.symbols(Words(pa.array([t], pa.string())), depth))[0], abs=1e-4)


def test_suffix_tree_beats_its_base(spark):
    """On held-out text the tree is better than counts of words, which give every unknown word the same."""
    rows = QUERIES["op1_suffix_tree"](spark, SF.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_suffix_tree_keeps_rare_contexts_of_large_corpora(spark):
    """What occurs five times is learnt, however much other text there is."""
    common, rare = "lorem ipsum dolor sit amet " * 4000, "quick zephyrs vex bold jackdaw flocks"
    rows = [(i, common, False) for i in range(30)] + [(100 + i, rare, False) for i in range(5)] + [(200, rare, True), (201, "kciuq srhypez xev dlob wadkcaj skcolf", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("held")).collect()}
    assert got[200] > 0.2 * got[201]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


PII = [
    "a@b.c@d.e x_y@z.co_q@r.st", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255", "4111 1111 1111 1111 5 4111-1111-1111-1111 4111  111111111111 4111111111111111", "+1 (988) 555-2485 +1-2 +123456789012345678 + 1 +49.30.123456.",
    "é😀 mail: x@y.org, ip 10.0.0.1\n+1 (988) 555-2485", "@@ a@b a@b. a@-.-", "9" * 3000 + " " + "a" * 5000 + "@", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "1." * 3000, "+1" * 2000, None, "", "5500005555555559-1", "x@y.z" * 300,
]


def test_pii_base_spans(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(PII)], "doc_id long, text string, base string")
    for r in pii.find(df).collect():
        want = plain_spans(PII[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert r["spans"].split(",")[: len(want)] == (want or [""])[: len(want)]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def test_pii_very_many_spans(spark):
    """A text of 2 MB with 30,000 addresses, among words that disclose them."""
    text = "".join(f"user{k % 50}@mail.example.org wrote to house {k % 90} in the street, " for k in range(30_000))
    rows = [(1, text), (2, "no address here"), (3, "user1@mail.example.org")]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60  # alone it takes a third of that
    assert got[1]["n_email"] == len(re.findall(PLAIN["email"], text)) == 30_000 and got[1]["spans"].split(",")[:3] == plain_spans(text)[:3]
    assert "@" not in got[1]["sanitised"] and got[1]["sanitised"].startswith("<email>") and got[2]["sanitised"] is None


def test_pii_terms(spark):
    rows = [(k, f"Contact Zorblax via z@x.org today, item {k}") for k in range(4)] + [(k, f"Contact someone today, item number {k}") for k in range(4, 40)]
    out = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[0][1]
    assert out[0]["spans"] == f"email:{text.index('z@x')}:{text.index('z@x') + 7},term:8:15,term:16:19"
    assert out[0]["sanitised"] == "Contact   <email> today, item 0"
    assert all(out[k]["spans"] == "" and out[k]["sanitised"] is None for k in range(4, 40))


@pytest.mark.parametrize("most,reach", [(200_000, 64), (0, 12)])
def test_pii_disclosure_by_brute_force(spark, monkeypatch, most, reach):
    """Shares of all pairs counted in plain Python: what is found, generalised and removed is what reaches the thresholds."""
    monkeypatch.setattr(pii, "MOST_BROADCAST", most)
    rng = np.random.default_rng(8)
    vocabulary_ = [f"{a}{b}" for a in ("lor", "mip", "sed", "tur", "wex") for b in ("am", "Ek", "io", "ul", "yné")]
    people = [("anna@x.org", "annaka"), ("bob@y.net", "bobbel"), ("10.0.0.1", "serverix"), ("+49 30 1234567", "dialer")]
    rows = []
    for k in range(60):
        words_ = [str(w) for w in rng.choice(vocabulary_, 30)]
        for (entity, name), often in zip(people, (2, 5, 9, 40), strict=True):
            if k % often == 0:
                at = int(rng.integers(0, 20))
                words_[at:at] = [name, entity]
                words_.insert(len(words_), name)
        rows.append((k, " ".join(words_)))
    rows += [(60, "only@here.org secretword and sed more text, Li Wu, No. 42, 1999"), (61, None), (62, "a@b.co " * 600 + "tail")]
    n, word = len(rows), re.compile(r"(?<![^\W_])[^\W_]{2,}")
    entity_of = lambda kind, v: f"{kind}:" + (re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower())
    df_c, df_t, co, held = collections.Counter(), collections.Counter(), collections.defaultdict(float), {}
    for k, t in rows:
        t = t or ""
        own = collections.defaultdict(set)
        every = {w.group().lower() for w in word.finditer(t)}
        for s in plain_spans(t):
            kind, a, z = s.split(":")
            a, z = int(a), int(z)
            near = {w.group().lower() for w in word.finditer(t) if (a - reach <= w.start() and w.end() <= a) or (z <= w.start() and w.end() <= z + reach)}
            own[entity_of(kind, t[a:z])] |= near
        held[k] = own
        df_c.update(own.keys())
        df_t.update(every)
        for e, near in own.items():
            for w in every | near:
                co[e, w] += 1 if w in near else pii.FAR

    def share(e, w):
        m = min(df_c[e], df_t[w])
        pmi = math.log2(n * co[e, w] / (df_c[e] * df_t[w]))
        return co[e, w] / (co[e, w] + 1) * m / (m + 1) * pmi / math.log2(n / df_c[e])

    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), reach=reach).collect()}
    found = 0
    for k, t in rows:
        t = t or ""
        shares = {}
        for e in held[k]:
            for w in {x.group().lower() for x in word.finditer(t)}:
                if co.get((e, w)) and share(e, w) >= pii.GENERALISE:
                    shares[w] = max(shares.get(w, 0), share(e, w))
        base_ = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(t)]
        terms = [(m.start(), m.end(), m.group().lower()) for m in word.finditer(t) if m.group().lower() in shares and not any(a < m.end() and m.start() < z for a, z in base_)]
        found += len(terms)
        assert got[k]["spans"] == ",".join([*plain_spans(t), *[f"term:{a}:{z}" for a, z, _ in terms]])
        if plain_spans(t):
            out, at = "", 0
            for a, z, put in sorted([(*map(int, s.split(":")[1:]), f"<{s.split(':')[0]}>") for s in plain_spans(t)] + [(a, z, "" if shares[w] >= pii.REMOVE else "<term>") for a, z, w in terms]):
                out, at = out + t[at:a] + put, z
            assert got[k]["sanitised"] == out + t[at:]
        else:
            assert got[k]["sanitised"] is None
    assert found > 10 and any("term" in r["spans"] and "secretword" in (rows[k][1] or "") for k, r in got.items() if k == 60)


def test_language_gradients():
    """Backpropagation through time against finite differences."""
    net = langid.Network(["a", "b"], 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    steps = rng.integers(1, 6, (5, 4)).astype(np.uint8)
    steps[3:, 1] = 0
    target = np.array([0, 1, 0, 1])
    _, grads = net.gradients(steps, target)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for i in rng.choice(len(flat), min(len(flat), 4), replace=False):
            old, e = flat[i], 1e-2
            flat[i] = old + e
            up, _ = net.gradients(steps, target)
            flat[i] = old - e
            down, _ = net.gradients(steps, target)
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_language_pooling_by_brute_force():
    """Probabilities of whole texts, one byte and one unit at a time."""
    texts = ["Ça va bien, merci", "x" * 250, "the cat sat on the mat and " * 9, "", None, "1 2 3"]
    net = langid.Network(["a", "b", "c"], 3, 4)
    names, scores = langid.predict(net, pa.array(texts, pa.string()))
    p, hid = {k: v.astype(float) for k, v in net.p.items()}, 3

    def states(k, data):
        h, out = [0.0] * hid, []
        for byte in data:
            x, u = p[f"x{k}"][:, byte], p[f"u{k}"]
            gate = lambda row: min(1.0, max(0.0, x[row] + sum(u[row][j] * h[j] for j in range(hid)) + 0.5))  # noqa: B023, E731
            update, reset = [gate(j) for j in range(hid)], [gate(hid + j) for j in range(hid)]
            cand = [x[2 * hid + i] + reset[i] * sum(u[2 * hid + i][j] * h[j] for j in range(hid)) for i in range(hid)]
            h = [h[i] + update[i] * (c / (1 + abs(c)) - h[i]) for i, c in enumerate(cand)]
            out.append(h)
        return out

    for text, name, score in zip(texts, names, scores, strict=True):
        if not text or not re.search("[^\\W\\d_]", text):
            assert (name, score) == ("und", 0)
            continue
        raw, total = text.encode(), np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            window = raw[at : at + langid.WINDOW]
            for f, b in zip(states("f", window), states("b", window[::-1])[::-1], strict=True):
                logit = p["v"] @ np.array(f + b) + p["c"]
                total += np.exp(logit) / np.exp(logit).sum()
        assert (name, pytest.approx(score, abs=1e-4)) == (net.labels[int(total.argmax())], total.max() / len(raw))


def test_language_id_held_out(spark):
    rows = QUERIES["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_id_cases(spark, docs):
    net = langid.train(docs)
    rows = collections.Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, net).collect())
    for i in (3, 4, 5, 19):
        assert rows[(i, "und")] == 1
    kept = langid.keep_identified(docs, net, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 5
    assert langid.train(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 1"), ("low", "toxic"))
    rows = toxicity.classify(docs, chain).join(labels, "doc_id").where("doc_id % 4 = 1").collect()
    assert sum(r["is_toxic"] and not r["toxic"] for r in rows) <= 1
    assert sum(r["is_toxic"] and r["toxic"] for r in rows) >= 0.5 * sum(r["toxic"] for r in rows)


def test_toxicity_cases(spark, docs):
    few = spark.createDataFrame([(1, 1), (2, 1), (9, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, toxicity.train(docs, few, ("toxic",))).collect()
    assert len(rows) == len(TEXTS) and {r["p_toxic"] for r in rows} == {1.0}
    none = toxicity.train(docs, few.where("toxic = 5"), ("toxic",))
    assert {r["p_toxic"] for r in toxicity.classify(docs, none).collect()} == {0.0}


def test_toxicity_chain_by_brute_force(spark):
    """Each model's probability from its weights, word by word, with the earlier categories' probabilities fed in; the later model learnt from out-of-fold ones."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for k in range(160):
        rude, poor = k % 4 == 0, k % 3 == 0
        extra = ["vile"] * rude + ["zzz", "Zzz"] * poor
        rows.append((k, " ".join([f"w{x}" for x in rng.integers(0, 50, 20)] + extra)))
        labels.append((k, int(poor), int(rude)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "VILE, vile zzz!")], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (3, 1, 1), (5, None, 1)], "doc_id long, low int, toxic int")
    chain = toxicity.train(docs, marks, ("low", "toxic"))
    bucket = lambda w: int(toxicity.buckets(Words(pa.array([w]), toxicity.ALNUM))[0])
    got = {r["doc_id"]: r for r in toxicity.classify(docs, chain).collect()}
    for i, t in [*rows[:20], (1000, None), (1001, "VILE, vile zzz!")]:
        col = pa.array([t], pa.string())
        own = {bucket(w) for w in re.findall("[a-z0-9]+", (t or "").lower())}
        dense = list(toxicity.shares(Words(col, toxicity.ALNUM), toxicity.buckets(Words(col, toxicity.ALNUM)))[0])
        for name, model in zip(("p_low", "p_toxic"), chain.models, strict=True):
            z = model.bias + sum(w for b, w in zip(model.words.tolist(), model.weights, strict=True) if b in own)
            z += sum((x - m) / s * w for x, m, s, w in zip(dense, model.mean, model.scale, model.dense_weights, strict=True))
            dense.append(1 / (1 + math.exp(-z)))
            assert got[i][name] == pytest.approx(dense[-1], abs=1e-5)
    # the second model once more, from probabilities that models without the row's fold gave
    truth = {k: (p, r) for k, p, r in labels}
    ids = sorted(truth)
    cols = pa.array([dict(rows)[k] for k in ids])
    w = Words(cols, toxicity.ALNUM)
    lists = [np.unique(toxicity.buckets(w)[a:z]) for a, z in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    table = toxicity.Rows(lists, toxicity.shares(w, toxicity.buckets(w)))
    y = np.array([truth[k] for k in ids], float)
    out, none = np.zeros(len(ids)), np.zeros((len(ids), 0))
    for k in range(len(ids)):
        others = np.flatnonzero(np.arange(len(ids)) % toxicity.FOLDS != k % toxicity.FOLDS)
        if k < toxicity.FOLDS:
            model = toxicity.Linear(table, none, y[:, 0], others)
            out[k :: toxicity.FOLDS] = model.of_rows(table, none)[k :: toxicity.FOLDS]
    again = toxicity.Linear(table, out[:, None], y[:, 1], np.arange(len(ids)))
    assert np.allclose(again.dense_weights, chain.models[1].dense_weights) and np.allclose(again.weights, chain.models[1].weights)


def test_toxicity_with_ties(spark):
    """Labels and texts of one doc_id that disagree give the same model however rows lie."""
    rows = [(k % 40, f"word{k} " + "bad " * (k % 3)) for k in range(80)]
    marks = [(k, k % 2) for k in range(40)] + [(k, 1 - k % 2) for k in range(0, 40, 5)]
    models = []
    for parts in (1, 4):
        docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), spark.createDataFrame(marks[:: 1 if parts == 1 else -1], "doc_id long, toxic int").repartition(parts)
        models.append(toxicity.train(docs, labels, ("toxic",)).models[0])
    assert np.array_equal(models[0].words, models[1].words) and np.array_equal(models[0].dense_weights, models[1].dense_weights)


def test_signatures_by_brute_force():
    """Each sample drawn word by word from the definition."""
    text = "the cat the dog THE bird cat é fish " * 3 + "once"
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    counts = collections.Counter(words(text))
    hashes = {w: int(Words(pa.array([w])).hashes()[0]) for w in counts}
    got = fingerprint.Sampler(32).signatures(pa.array([text]))[0]
    f = np.float32
    for k in range(32):
        best = None
        for w, n in counts.items():
            u = [f((mix(hashes[w] ^ mix((k + 1) * 0x9E3779B97F4A7C15 + salt & mask)) >> 40) + f(0.5)) * f(2.0**-24) for salt in range(1, 6)]
            r, lnc, b = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
            t = np.floor(f(np.log(n)) / r + b)
            value = lnc - r * (t - b + f(1))
            if best is None or value < best[0]:
                best = (value, hashes[w], int(t))
        assert got[k] == max(1, mix(best[1] ^ mix(best[2] + 0x1234567 & mask)) >> 48)


def test_fingerprints(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 7]
    got = {r["doc_id"]: r for r in fingerprint.against_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        e = t[: len(t) - n] + other[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_next"] == 1) == (r["fingerprint"] == got[rows[(k + 1) % len(rows)][0]]["fingerprint"])
    assert got[3]["fingerprint"] == got[4]["fingerprint"] == "0" * 256
    assert got[16]["fingerprint"] == got[17]["fingerprint"]


def test_fingerprints_with_odd_ids(docs, empty):
    assert fingerprint.against_edits(docs).count() == len(TEXTS)
    assert fingerprint.against_edits(empty).count() == 0
    assert fingerprint.against_edits(docs.where("doc_id = 1")).first()["near_next"] == 1.0


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(5)
    sampler, errors = fingerprint.Sampler(512), []
    for _ in range(20):
        a, b = (collections.Counter(rng.integers(0, 40, 120).tolist()) for _ in range(2))
        truth = sum((a & b).values()) / sum((a | b).values())
        texts = [" ".join(f"w{k}" for k in c.elements()) for c in (a, b)]
        s = sampler.signatures(pa.array(texts))
        errors.append(fingerprint.likeness(s[:1], s[1:])[0] - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def fill(sizes, weights, share, epochs):
    left, out = dict(sizes), {}
    budget = share * sum(sizes.values())
    while left:
        level = budget / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > epochs * left[s]]
        if not over:
            return out | {s: level * weights[s] for s in left}
        for s in over:
            out[s] = epochs * left.pop(s)
            budget -= out[s]
    return out


def test_mixing(docs):
    rows = mixing.plan(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in TEXTS)
    sizes = {r["source"]: r["source_size"] for r in rows}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for s in sizes:
        assert {round(r["target"], 6) for r in rows if r["source"] == s} == {round(want[s], 6)}
        taken = sum(r["taken"] for r in rows if r["source"] == s)
        assert want[s] - len(TEXTS) <= taken <= want[s] + 1e-6
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, mixing.plan(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["times"] + (r["size"] > 0 and 2 * (r["taken"] - r["times"] * r["size"]) >= r["size"]) for r in rows)


def test_water_filling_matches_rounds(spark):
    rng = np.random.default_rng(2)
    for _ in range(4):
        sizes = {f"s{k}": int(x) for k, x in enumerate(rng.integers(1, 1000, 7))}
        df = spark.createDataFrame([(s, s, 1, n) for s, n in sizes.items()], "skey string, source string, n long, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5, 2)
        assert {s: round(x, 6) for s, x in got.items()} == {s: round(x, 6) for s, x in want.items()}


def reference_encoding():
    import tiktoken

    path, pattern = vocabulary()
    with open(path, "rb") as f:
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


ODD = ["<|endoftext|>", "a  b   c \n\n d  e  f", "\x85x \x1c y", "it's we'll I'M", "aaaa" * 50, " " * 33 + "x" + "\t" * 9, "😀😀é́ ñandú 漢字かな", "᠎ ﻿", "1234567 ½ ² ٣", "=" * 70, "\r\n\r\n  x", "\x00\x00"]


def test_bpe(docs):
    enc = reference_encoding()
    rows = bpe.encode(docs, *vocabulary()).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_bpe_odd_texts():
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        own = bpe.codec(f.read(), pattern)
    enc = reference_encoding()
    rng = np.random.default_rng(1)
    alphabet = list("ab '1.\n\té漢😀 st") + ["ing", "the ", "'s"]
    texts = ODD + ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(400)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert own.decode_text(ids) == t
        spans = own.token_spans(ids)
        assert len(spans) == len(ids) // 4 and all(0 <= a < b <= len(t) for a, b in spans)


def test_length_histogram(spark, docs):
    enc = reference_encoding()
    lengths = [len(enc.encode_ordinary(t or "")) for _, t in TEXTS]
    counts = length_histogram.histogram(docs, *vocabulary())
    assert {r["length"]: r["docs"] for r in counts.collect()} == dict(collections.Counter(lengths))
    for r in length_histogram.by_limit(counts).collect():
        x = r["length"]
        assert r["truncated_tokens"] == sum(min(n, x) for n in lengths)
        assert (r["docs_reaching"], r["tokens_reaching"]) == (sum(n >= x for n in lengths), sum(n for n in lengths if n >= x))
    assert {r["limit"]: r["tokens"] for r in length_histogram.truncated_total(counts, [0, 7, 10**6]).collect()} == {k: sum(min(n, k) for n in lengths) for k in (0, 7, 10**6)}
    ordered = sorted(lengths)
    assert {r["share"]: r["length"] for r in length_histogram.quantile(counts, [0.5, 1.0]).collect()} == {0.5: ordered[math.ceil(len(ordered) / 2) - 1], 1.0: ordered[-1]}


def test_bpe_columns_and_spans(docs):
    """Kept columns whose names clash stay under another one; spans cover the characters of each token."""
    out = bpe.encode(docs, *vocabulary(), keep=("doc_id", "N_Tokens", "a.b"), with_spans=True)
    assert out.columns == ["doc_id", "_N_Tokens", "a.b", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "spans"]
    texts = collections.defaultdict(list)
    for i, t in TEXTS:
        texts[i].append(t or "")
    for r in out.collect():
        assert (r["_N_Tokens"], r["a.b"], len(r["spans"])) == (9, 4, r["n_tokens"])
        ends = [s["end"] for s in r["spans"]]
        assert ends == sorted(ends) and (not ends or ends[-1] in {len(t) for t in texts[r["doc_id"]]})


def test_held_out_is_never_null(spark, tmp_path):
    rows = [(None, "no id here", "en"), (1, "the cat sat on the mat", "en"), (2, "le chat est la", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("op1_suffix_tree", "op5_language_id"):
        got = {r["doc_id"]: r["held_out"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got[None] is False and set(got) == {None, 1, 2} and None not in got.values()


def test_shared_folder_must_be_shared(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: None)})

    with pytest.raises(ValueError):
        cluster.shared_folder(Session)
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        cluster.shared_folder(Session)


def test_empty_tables(empty):
    assert exact_dedup.find_repeats(empty).count() == 0 and exact_dedup.drop_repeats(empty).count() == 0
    assert set_join.groups(empty).count() == 0 and set_join.keep_one(empty).count() == 0
    assert suffix_tree.score(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert bpe.encode(empty, *vocabulary()).count() == 0
    assert length_histogram.by_limit(length_histogram.histogram(empty, *vocabulary())).count() == 0
    labels = empty.selectExpr("doc_id", "Size as toxic")
    assert toxicity.classify(empty, toxicity.train(empty, labels, ("toxic",))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(name, spark, duck):
    from ..test_oracle import rows_of

    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.collect(), df.columns, sorted(df.columns)) == rows_of(want.fetchall(), want.columns, sorted(df.columns))
