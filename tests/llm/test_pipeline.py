"""The pipeline stage by stage on the smallest tables, each stage against plain Python on its own input, and from end to end."""

from __future__ import annotations

import collections
import hashlib
import re

import corpus_pipeline
from kestrelgrid.llm import langid
from pyspark.sql import functions as F

from ..conftest import SF
from .test_operators import Union, fill, reference_encoding, words


def told(spark, rows, df):
    """Documents with a letter whose language is told well enough."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = langid.identify(df, langid.train(df, ~held_out)).where(f"score >= {corpus_pipeline.LEAST_SCORE} and lang_pred <> 'und'")
    ids = {r["doc_id"] for r in scored.collect()}
    return collections.Counter(r for r in rows if r["doc_id"] in ids)


def different(spark, rows, df):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x["text"] or ""), x["doc_id"]))
    return collections.Counter(best.values())


def one_of_near_copies(spark, rows, df):
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    own, holders = Union(len(rows)), collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(sets):
        for other, n in collections.Counter(j for x in s for j in holders[x] if j < k).items():
            if 100 * n >= 80 * len(s | sets[other]):
                own.join(k, other)
    best = {}
    for k, r in enumerate(rows):
        best[own.find(k)] = min(best.get(own.find(k), r), r, key=lambda x: x["doc_id"])
    return collections.Counter(best.values())


def mixed(spark, rows, df):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    target = fill(whole, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, 1.5, 2)
    out = collections.Counter()
    for s in sources:
        times = int(target[s] / whole[s] + 1e-12) if whole[s] else 0
        left = target[s] - times * whole[s]
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (int(hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()[:15], 16), r["doc_id"]))
        for r in mine:
            n = size[r["doc_id"]]
            part = n if n <= left else int(left) if left > 0 else 0
            left = left - n if n <= left else -1
            out[r] += times + (part == n or (part > 0 and 2 * part >= n))
    return +out


EXACT = {"language_id": told, "exact_dedup": different, "near_dedup": one_of_near_copies, "mix_sources": mixed}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name in EXACT:
            assert docs.columns == columns
            assert collections.Counter(docs.collect()) == EXACT[name](spark, before.collect(), before), name
    encoding = reference_encoding()
    want = collections.Counter((r["doc_id"], tuple(encoding.encode_ordinary(r["text"] or ""))) for r in before.collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
