"""The versioned keyword index against counting everything anew, over files that come, change and go."""

from __future__ import annotations

import collections
import os
import re
import uuid
from pathlib import Path

import pandas as pd
import pytest

from kestrelgrid.functions import text as T
from kestrelgrid.operators import inverted
from kestrelgrid.operators.inverted import ConflictError, KeywordIndex
from kestrelgrid.plans import load
from kestrelgrid.plans.adapters import document_words


def put(path: Path, rows: list[tuple[int, str]]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(path, index=False)
    # times of files differ, however fast the test is
    put.clock += 10
    os.utime(path, (put.clock, put.clock))


put.clock = 1_700_000_000


def plain(table: Path) -> tuple[dict, dict]:
    """(keyword, entity) -> weight, and keyword -> (documents, zipf), from all files."""
    weights = collections.Counter()
    for f in table.rglob("*.parquet") if table.is_dir() else [table]:
        for doc_id, text in pd.read_parquet(f)[["doc_id", "text"]].itertuples(index=False):
            weights.update((w.lower(), doc_id) for w in re.findall(r"[A-Za-z]\w{2,}", text) if w.lower() not in T.STOP_WORDS)
    df = collections.Counter(kw for kw, _ in weights)
    levels = sorted(set(df.values()))
    return dict(weights), {kw: (n, 1 / (1 + levels.index(n))) for kw, n in df.items()}


def state(index) -> tuple[dict, dict]:
    rows = index.postings.collect()
    assert len({(r["kw"], r["entity"]) for r in rows}) == len(rows)
    return {(r["kw"], r["entity"]): r["weight"] for r in rows}, {r["kw"]: (r["df"], r["zipf"]) for r in index.terms.collect()}


def test_files_come_change_and_go(spark, tmp_path):
    table, folder = tmp_path / "documents.parquet", str(tmp_path / "index")
    refresh = lambda: KeywordIndex(spark, folder, "d").refresh(str(table), document_words)
    entry = lambda: (k := KeywordIndex(spark, folder, "d"))._entry(k.versions()[-1])
    put(table / "day=1" / "a.parquet", [(1, "alpha beta beta"), (2, "beta gamma")])
    put(table / "day=1" / "b.parquet", [(3, "delta alpha")])
    assert state(refresh()) == plain(table)
    # nothing changed: no new version
    refresh()
    assert KeywordIndex(spark, folder).versions() == [1]
    # a file below a partition folder, which leaves the top folder as it is
    put(table / "day=2" / "c.parquet", [(4, "delta epsilon"), (1, "beta zeta")])  # document 1 now has rows in two files
    assert state(refresh()) == plain(table)
    assert (entry()["added"], entry()["lost"], entry()["shared"]) == (1, 0, True)
    # a file of the same name and length with other words
    put(table / "day=1" / "b.parquet", [(3, "omega alpha")])
    assert state(refresh()) == plain(table)
    assert (entry()["added"], entry()["lost"]) == (1, 1)
    # document 1 loses one of its two rows, but keeps what the other says
    (table / "day=1" / "a.parquet").unlink()
    assert state(refresh()) == plain(table)
    assert (entry()["added"], entry()["lost"]) == (0, 1)
    for f in table.rglob("*.parquet"):
        f.unlink()
    assert state(refresh()) == ({}, {})
    put(table / "day=3" / "z.parquet", [(9, "alpha again")])
    assert state(refresh()) == plain(table)


def test_older_versions_stay_readable(spark, tmp_path):
    table = tmp_path / "t"
    index = KeywordIndex(spark, str(tmp_path / "index"), "d")
    put(table / "a.parquet", [(1, "alpha beta")])
    first = index.refresh(str(table), document_words)
    put(table / "a.parquet", [(1, "gamma")])
    index.refresh(str(table), document_words)
    assert {r["kw"] for r in first.of_words(["alpha", "gamma"]).collect()} == {"alpha"}
    assert {r["kw"] for r in index.read(1).terms.collect()} == {"alpha", "beta"}
    index.vacuum()
    assert index.versions() == [2] and state(index.read()) == plain(table)


def test_generations_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "MOST_GENERATIONS", 2)
    table = tmp_path / "t"
    index = KeywordIndex(spark, str(tmp_path / "index"), "d")
    for k in range(4):
        put(table / f"{k}.parquet", [(k, f"word{k} common"), (k + 1, "common shared")])
        put(table / "0.parquet", [(0, f"again{k} common")])
        assert state(index.refresh(str(table), document_words)) == plain(table)
    assert len(index._entry(index.versions()[-1])["generations"]) <= 2


def test_many_changed_files_are_joined_instead_of_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "MOST_NAMED", 1)
    table = tmp_path / "t"
    index = KeywordIndex(spark, str(tmp_path / "index"), "d")
    for k in range(3):
        put(table / f"p={k}" / "f 1%.parquet", [(k, f"word{k} common")])
    assert state(index.refresh(str(table), document_words)) == plain(table)
    for k in range(2):
        put(table / f"p={k}" / "f 1%.parquet", [(k, f"other{k} common")])
    assert state(index.refresh(str(table), document_words)) == plain(table)


def test_names_that_need_quoting(spark, tmp_path):
    table = tmp_path / "t u"
    put(table / "p=a b" / "x%20y.parquet", [(1, "alpha beta")])
    index = KeywordIndex(spark, str(tmp_path / "index"), "d")
    assert state(index.refresh(str(table), document_words)) == plain(table)


def test_another_definition_makes_it_anew(spark, tmp_path):
    table = tmp_path / "one.parquet"
    put(table, [(1, "alpha beta")])
    KeywordIndex(spark, str(tmp_path / "index"), "old").refresh(str(table), lambda rows: document_words(rows).where("kw <> 'beta'"))
    assert state(KeywordIndex(spark, str(tmp_path / "index"), "new").refresh(str(table), document_words)) == plain(table)


def test_second_writer_of_a_version_fails(spark, tmp_path):
    table = tmp_path / "one.parquet"
    put(table, [(1, "alpha beta")])
    index = KeywordIndex(spark, str(tmp_path / "index"), "d")
    index.refresh(str(table), document_words)
    with pytest.raises(ConflictError):
        index._commit(1, {})
    assert state(index.read()) == plain(table)


def test_search_reads_ranges_only(spark, tmp_path):
    table = tmp_path / "one.parquet"
    put(table, [(1, "alpha beta"), (2, "beta gamma")])
    index = KeywordIndex(spark, str(tmp_path / "index"), "d").refresh(str(table), document_words)
    assert {(r["kw"], r["entity"], r["df"], r["zipf"]) for r in index.of_words(["beta"]).collect()} == {("beta", 1, 2, 0.5), ("beta", 2, 2, 0.5)}
    from pyspark.sql import functions as F

    assert {r["entity"] for r in index.of_patterns(F.col("kw").contains("amm")).collect()} == {2}
    plan = index.of_words(["beta"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(kw,beta)") >= 2 and "SortMergeJoin" not in plan


def test_registered_queries_see_added_files(spark, tmp_path):
    """Queries over a folder give the rows of its present files, in one session and with a lasting index in the next."""
    table = tmp_path / "documents.parquet"
    lasting = str(tmp_path / uuid.uuid4().hex)
    for folder in (None, lasting, lasting):
        if folder:
            spark.conf.set("spark.kestrelgrid.index.dir", folder)
        try:
            for k in range(2):
                put(table / f"day={k}" / f"{uuid.uuid4().hex}.parquet", [(uuid.uuid4().int >> 70, f"beta delta word{k}"), (uuid.uuid4().int >> 70, "heat thing")])
                got = {r["kw"]: (r["df"], r["zipf"]) for r in load()["zipf_weights"](spark, str(tmp_path)).collect()}
                assert got == plain(table)[1]
                assert load()["search_wildcard"](spark, str(tmp_path)).count() == got["heat"][0]
        finally:
            spark.conf.unset("spark.kestrelgrid.index.dir")
