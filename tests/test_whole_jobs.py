"""Queries that do their whole job, and steps whose cost grows no faster than their input."""

from __future__ import annotations

import collections

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrelgrid.functions import scores as S
from kestrelgrid.operators import graph
from kestrelgrid.operators import keywords as K
from kestrelgrid.operators import pairs as P
from kestrelgrid.operators import passes
from kestrelgrid.operators.inverted import KeywordIndex
from kestrelgrid.plans import load, registry
from kestrelgrid.plans.adapters import document_words
from kestrelgrid.sources import elixir, token_arrays

from .conftest import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reverse_calls_gathers_the_sites_of_each_function(spark):
    rows = load()["reverse_calls"](spark, SF).collect()
    assert len({r["key"] for r in rows}) == len(rows)
    assert all(r["n"] == len(r["sites"].split(",")) for r in rows)
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_usage_json_nests_the_definitions_of_a_module(spark):
    rows = load()["usage_json"](spark, SF).collect()
    sizes = collections.Counter(r["module"] for r in rows)
    assert all(r["items"] == sizes[r["module"]] for r in rows)
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_keywords_of_whole_documents_need_no_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(1, 7, "alpha beta beta"), (1, 8, ""), (1, 9, None), (1, 10, "beta Beta gamma beta")], "file long, doc_id long, text string")
    words = document_words(docs)
    assert {(r["entity"], r["kw"], r["weight"]) for r in words.collect()} == {(7, "alpha", 1.0), (7, "beta", 2.0), (10, "beta", 3.0), (10, "gamma", 1.0)}
    # an explode with an inferred filter would make the counts anew for every element
    assert "Exchange" not in plan_of(words) and plan_of(words).count("regexp_extract_all") == 1


def test_top_words_of_entities_of_one_row_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "beta alpha beta gamma"), (1, "gamma delta gamma"), (2, "zeta beta zeta alpha"), (3, ""), (4, None), (None, "alpha"), (None, "beta alpha")], "doc_id long, text string")
    got = K.top_words(docs, "doc_id", "text", 2)
    assert {tuple(r) for r in got.select("entity", "kw", "times", "rank").collect()} == {(1, "gamma", 3, 1), (1, "beta", 2, 2), (2, "zeta", 2, 1), (2, "beta", 1, 2), (None, "alpha", 2, 1), (None, "beta", 1, 2)}
    # words of the first branch go from the scan to their ranks
    whole = plan_of(K.top_words(docs.where("doc_id = 2"), "doc_id", "text", 2)).split("Union")[-1].split("Window")[0]
    assert "posexplode" in whole and "hashpartitioning(entity" not in whole


def test_an_entity_with_two_rows_in_a_file_is_added_up(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.createDataFrame([(1, "alpha beta"), (1, "beta gamma"), (2, "beta")], "doc_id long, text string").coalesce(1).write.parquet(table)
    index = KeywordIndex(spark, str(tmp_path / "index"), "d").refresh(table, document_words, "doc_id")
    assert {(r["kw"], r["entity"], r["weight"]) for r in index.postings.collect()} == {("alpha", 1, 1.0), ("beta", 1, 2.0), ("gamma", 1, 1.0), ("beta", 2, 1.0)}
    assert {(r["kw"], r["df"]) for r in index.terms.collect()} == {("alpha", 1), ("beta", 2), ("gamma", 1)}


def test_rare_keywords_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(S.zipf(spark.range(100).selectExpr("id as kw", "id % 3 as df")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_large_sets_are_counted_where_their_sets_are(spark, monkeypatch):
    import itertools
    import random

    monkeypatch.setattr(P, "CHUNK", 50)
    rng = random.Random(1)
    groups = {g: {f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.randrange(60))} for g in range(40)}
    items = spark.createDataFrame([(g, w) for g, ws in groups.items() for w in ws for _ in range(2)] + [(None, "x"), (3, None)], "g long, w string")
    counts = collections.Counter(p for ws in groups.values() for p in itertools.combinations(sorted(ws), 2))
    for least in (1, 5):
        got = P.together(items, "g", "w", most=None, least=least)
        assert {(r["a"], r["b"]): r["cnt"] for r in got.collect()} == {p: n for p, n in counts.items() if n >= least}
        # a pair is made in the task that counts it, and never shuffled
        assert "MapInArrow" in plan_of(got)
    degree = collections.Counter(w for p in counts for w in p)
    assert sorted(r["degree"] for r in P.degrees(items, "g", "w").collect()) == sorted(degree.values())


def test_sets_are_read_by_each_block_of_pairs_and_blocks_grow_in_number_only(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 1000)
    items = spark.range(100).selectExpr("id as g", "explode(sequence(0, 19)) as w").selectExpr("g", "concat('w', (w * (g % 3 + 1)) % 40) as w")
    sizes = [r["n"] for r in items.distinct().groupBy("g").agg(F.count("*").alias("n")).collect()]
    n = -(-sum(k * (k - 1) // 2 for k in sizes) // 1000)
    assert n > P.BLOCKS and P._dealt(P._numbered_sets(items, "g", "w")[0])[0].rdd.getNumPartitions() == n
    plan = plan_of(P.degrees(items, "g", "w"))
    # one exchange for the sums, none for the sets
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan
    plan = plan_of(P.together(items, "g", "w", most=None, least=5))
    assert plan.count("Exchange") == plan.count("BroadcastExchange") and "CartesianProduct" in plan


@pytest.mark.parametrize("held", [10, 10_000])
@pytest.mark.parametrize("width", [80, 1 << 20])
def test_pairs_of_a_block_stay_few_in_memory(monkeypatch, held, width):
    import itertools
    import random

    monkeypatch.setattr(P, "HELD", held)
    monkeypatch.setattr(P, "CHUNK", 7)
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(80), rng.randrange(2, 30))) for _ in range(60)]
    lists = pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32()))], ["ids"])
    packed = next(P._packed(iter([lists.slice(0, 0), lists])))
    assert packed.column("n").to_pylist() == [len(x) for x in sets] and packed.column("top").to_pylist() == [x[-1] for x in sets]
    batches = lambda block: (pa.RecordBatch.from_arrays([packed.column("ids").slice(k, 25), pa.array([block] * len(sets)).slice(k, 25)], ["ids", "block"]) for k in (0, 25, 50))
    rows = [(a, b, n) for block in range(3) for x in P._pairs_of_block(batches(block), 3, width) for a, b, n in zip(*(y.tolist() for y in x), strict=True)]
    counts = collections.Counter(p for x in sets for p in itertools.combinations(x, 2))
    assert len(rows) == len(counts) and {(b, a): n for a, b, n in rows} == counts
    assert list(P._pairs_of_block(iter([]), 3, width)) == []


@pytest.mark.parametrize("name", ["heuristic_history", "file_pr_history", "batch_evolution", "cochange_pairs", "cochange_sampled", "pr_recent", "line_history"])
def test_tasks_of_histories_grow_in_number_only(name, spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS", 100)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    assert f"{n}), REPARTITION_BY_NUM" in plan_of(load()[name](spark, SF))


def test_tokens_of_modules_stay_in_their_tasks(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(elixir, "written", lambda df: tables.append(df) or df)
    load()["elixir_modules"](spark, SF)
    # definitions become a table, tokens don't, and sources are dealt before they are cut
    assert tables and all("touches" not in df.columns for df in tables)
    assert "REPARTITION_BY_NUM" in plan_of(tables[0])


def test_tokens_of_modules_stay_in_the_row_of_their_file(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(elixir, "written", lambda df: tables.append(df) or df)
    load()["elixir_modules"](spark, SF)
    plan = plan_of(tables[0])
    # only the documents are dealt, once, and only modules become a table
    assert len(tables) == 1 and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Window" not in plan


def test_modules_in_rows_of_files(spark):
    sources = ["", None, "defmodule A do\n", 'defmodule A do\n@moduledoc "a"\n@moduledoc "b"\ndefmodule B.C do\nend\nend\n@moduledoc "c"\n', "defmodule A, do: nil\ndefimpl P do\ndef f, do: 1\nend\n"]
    files = spark.createDataFrame([(str(k), x) for k, x in enumerate(sources)], "file string, source string").coalesce(1)
    got = {(r["file"], r["module"], r["outer"], r["line"], r["end_line"], r["moduledoc"]) for r in elixir.modules(files).collect()}
    assert got == {("2", "A", None, 1, None, None), ("3", "A", None, 1, 6, "a"), ("3", "B.C", "A", 4, 5, None), ("4", "P", None, 2, 4, None)}


@pytest.mark.parametrize("name", ["elixir_calls", "elixir_functions"])
def test_tokens_of_calls_and_functions_stay_in_the_row_of_their_file(name, spark, monkeypatch):
    tables = []
    monkeypatch.setattr(elixir, "written", lambda df: tables.append(df) or df)
    plan = plan_of(load()[name](spark, SF))
    # only the documents are dealt, once
    assert not tables and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Window" not in plan


def test_kinds_of_tokens_are_the_same_in_rows_and_arrays(spark):
    texts = ["\n", " \t", "# x", "Ab.C", "a:", "Ä:", "_a:", '"q":', ":a", ":", "::", ':"a b"', "'c'", "~s(a)", "~", "@doc", "@", "12", "?a", "?", "do", "end", "foo?", "_", "é", "éé", "É", "ab!", "(", "<<", ")", ">>", "->", "."]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", elixir._kind(F.col("text")).alias("kind")).collect()
    assert {r["text"]: r["kind"] for r in rows} == {x: token_arrays.kind(x, elixir.OPERATORS) for x in texts}


def test_counts_of_calls_are_those_of_the_calls(spark):
    source = "defmodule A do\n def f(x) do\n  g(x) + g(1) + h(g(2, 3))\n  B.g(x)\n end\nend\ng(0)\n"
    files = spark.createDataFrame([(str(k), source * (k % 3)) for k in range(9)] + [("n", None)], "file string, source string").coalesce(1)
    counts = collections.Counter((r["file"], r["caller"], r["function"], r["arity"]) for r in elixir.calls(files).collect())
    assert counts["2", "A", "g", 1] == 6 and counts["2", None, "g", 1] == 2
    assert {(r["file"], r["caller"], r["function"], r["arity"]): r["calls"] for r in elixir.call_counts(files).collect()} == counts


def test_cycles_around_a_hub_make_no_pairs(spark, monkeypatch):
    sizes = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df: sizes.append((out := write(df)).count()) or out)
    edges = [(k, 7) for k in range(300)] + [(7, k) for k in range(100)]
    got = graph.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.range(300).withColumnRenamed("id", "root")).collect()
    assert {tuple(r) for r in got} == {(a, b) for a in range(300) for b in range(100) if a != b} and len(got) == 300 * 100 - 100
    assert max(sizes) <= 2 * len(edges)


def test_few_ranges_of_a_file_are_carried_without_arrays(monkeypatch):
    import random

    rng, rows = random.Random(3), []
    for file in range(300):
        rows += [(file, 0, None, None, None, None, None, None, k, a := rng.randrange(1, 40), a + rng.randrange(9)) for k in range(rng.randrange(1, 4))]
        for seq in reversed(range(rng.randrange(12))):
            at = shift = 0
            for _ in range(rng.randrange(4)):
                at, old, new = at + rng.randrange(1, 12), rng.randrange(3), rng.randrange(3)
                if old + new:
                    rows.append((file, 1, seq, at if old == 0 else at + 1, old, at + shift if new == 0 else at + shift + 1, new, seq, None, None, None))
                    at, shift = at + old + 1, shift + new - old
    names = ("file", "kind", "seq", "old_start", "old_lines", "new_start", "new_lines", "sha", "id", "start", "stop")
    batch = pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))

    def history(most):
        walk = passes._Walk(most)
        walk.take(batch)
        walk.close()
        return sorted(walk.out)

    for most in (None, 2):
        monkeypatch.setattr(passes, "FEW", 0)
        by_arrays = history(most)
        monkeypatch.setattr(passes, "FEW", 32)
        with monkeypatch.context() as m:
            m.setattr(passes, "np", None)
            assert history(most) == by_arrays and len(by_arrays) > 200
