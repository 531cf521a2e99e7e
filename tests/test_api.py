"""The tools over a small index."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from kestrelgrid.api import CodeIndex
from kestrelgrid.plans import planner
from kestrelgrid.sources import entities, index


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    fn = lambda name, arity, line, kind="def", **kw: {"name": name, "arity": arity, "line": line, "type": kind, "keywords": kw}
    call = lambda module, function, arity, line: {"module": module, "function": function, "arity": arity, "line": line}
    modules = {
        "Depot.Parcel": {"file": "lib/depot/parcel.ex", "line": 1, "moduledoc": "Parcels", "functions": [fn("make_parcel", 2, 10, make=1.0, parcel=0.5), fn("unused_func", 0, 30), fn("_hide", 0, 40, "defp")], "calls": [call(None, "_hide", 0, 12)], "aliases": {}, "keywords": {"parcel": 1.0}},
        "Depot.ParcelGate": {"file": "lib/web/parcel_gate.ex", "line": 1, "functions": [fn("make", 2, 20, make=0.5)], "calls": [call("Parcel", "make_parcel", 2, 23)], "aliases": {"Parcel": "Depot.Parcel"}, "uses": ["Web"], "keywords": {"gate": 1.0}},
        "DepotTest.ParcelTest": {"file": "test/parcel_test.exs", "line": 1, "functions": [], "calls": [call("Parcel", "make_parcel", 2, 8)], "aliases": {"Parcel": "Depot.Parcel"}, "value_mentions": ["Depot.ParcelGate"]},
    }
    path = tmp_path_factory.mktemp("index") / "index.json"
    path.write_text(json.dumps({"modules": modules, "metadata": {"total_modules": 3}}))
    return CodeIndex(index.read_index(spark, str(path)))


def test_query(code):
    rows = code.query("make parcel").collect()
    assert rows[0]["entity"] == "Depot.Parcel.make_parcel/2" and rows[0]["tier"]
    assert {r["entity"] for r in code.query("make*").collect()} == {"Depot.Parcel.make_parcel/2", "Depot.ParcelGate.make/2"}
    assert {r["entity"] for r in code.query("Parcel.make_parcel/2").collect()} == {"Depot.Parcel.make_parcel/2"}
    assert [r["note"] for r in code.query("make_parcel", scope="private").collect()] == ["all scopes"]
    assert {r["entity"] for r in code.query("*parcel*", glob="lib/web/**", kinds="modules").collect()} == {"Depot.ParcelGate"}
    assert code.query([]).count() == 0


def test_search_function(code):
    r = code.search_function("Depot.Parcel.make_parcel/2").first()
    assert [c["caller_module"] for c in r["callers"]] == ["Depot.ParcelGate", "DepotTest.ParcelTest"]
    r = code.search_function("make_parcel", usage_type="source").first()
    assert [(c["caller_module"], c["line"]) for c in r["callers"]] == [("Depot.ParcelGate", 23)]
    assert code.search_function("makeParcel").first()["note"] == "other case"
    assert code.search_function("hide").first()["note"] == "private twin"
    assert {r["name"] for r in code.search_function("Elsewhere.nothing|Elsewhere.hide").collect()} == {"_hide"}


def test_modules(code):
    assert [r["module"] for r in code.search_module("Elsewhere.ParcelGate").collect()] == ["Depot.ParcelGate"]
    assert {(r["kind"], r["module"]) for r in code.module_usage("Depot.Parcel").collect()} == {("alias", "Depot.ParcelGate"), ("alias", "DepotTest.ParcelTest"), ("call", "Depot.ParcelGate"), ("call", "DepotTest.ParcelTest")}
    assert {(r["node"], r["depth"]) for r in code.dependencies("DepotTest.ParcelTest").collect()} == {("Depot.Parcel", 1), ("Depot.ParcelGate", 1), ("Web", 2)}
    assert code.expand("Depot.Parcel").first()["module"] == "Depot.Parcel"


def test_dead_code(code):
    assert {(r["name"], r["confidence"]) for r in code.dead_code("low").collect()} == {("unused_func", "high"), ("make", "low")}
    assert {r["name"] for r in code.dead_code().collect()} == {"unused_func"}


def test_json_queries(code):
    assert sorted(r["value"] for r in code.query_json(".module").collect()) == ["Depot.Parcel", "Depot.ParcelGate", "DepotTest.ParcelTest"]
    assert code.query_json('select(.module | test("Gate$")) | .functions[] | .name').first()["value"] == "make"
    assert code.query_json(". | schema", sample=True).first()["value"].startswith('["file"')
    assert planner.check_json_query("[(])") and planner.check_json_query("") and planner.check_json_query('"x')
    assert planner.check_json_query("[" * 60 + "]" * 60) and planner.check_json_query('.a["]"]') is None


def test_refresh(code, spark):
    changed = spark.createDataFrame([("lib/depot/parcel.ex",)], "path string")
    empty = {k: v.where("false") for k, v in code.tables.items()}
    after = code.refresh(empty, changed)
    assert after.modules.count() == 2 and after.functions.where("module = 'Depot.Parcel'").count() == 0


def test_planner():
    assert planner.read_query("login 'two words'") == {"keywords": ["login", "two words"], "patterns": []}
    assert planner.read_query('login "two words" A.B*') == {"keywords": [], "patterns": ['login "two words" A.B*']}
    for text in ("lib/x.ex:run", "x.ex:run", "Mod.run", "a|b", "run/2", "a b*"):
        assert planner.read_query(text) == {"keywords": [], "patterns": [text]}
    for text in ("mod.run", "a:b", "plain", "a/b"):
        assert planner.read_query(text) == {"keywords": [text], "patterns": []}
    s = planner.read_query([["login", "auth"], "parcel", "|", "Mod.run/2", " ", [" "], "a/b"])
    assert s == {"keywords": [["login", "auth"], "parcel", "a/b"], "patterns": ["Mod.run/2"]}
    tries = dict(planner.relaxed("A.make_it/2|B.run"))
    assert tries == {"as asked": "A.make_it/2|B.run", "any module": "make_it/2|run", "any arity": "make_it|run", "private twin": "_make_it|_run", "other case": "makeIt|run", "part of the name": "*make_it*"}
    assert planner.hints(s, {"recent": True}) and len(planner.next_steps([{"module": "A", "type": "function", "name": "f"}] * 2)) == 2
    assert planner.table([{"a": 1, "b": None}], ["a", "b"]) == "a  b\n1"


def test_hints_name_words_of_the_index(code):
    words = {r["kw"] for r in code.entity_keywords.select("kw").distinct().collect()}
    some = sorted(w for w in words if len(w) > 4)[0]
    assert some in code.near_terms(some[:-1]) and some in code.near_terms(some + "s") and code.near_terms(some[:-1], 1)
    assert code.near_terms("zzzzzz") == [] and code.near_terms("A.b*") == []
    assert code.hints(some + "s", recent=True)[0].startswith("did you mean ") and code.hints("zzzzzz", recent=True) == ["look at older code too"]


def test_history(spark, code):
    at = [datetime(2024, 1, d) for d in (1, 20)]
    tables = code.tables | {"commits": spark.createDataFrame([("a", "Ann", at[0], "Fix login"), ("b", "Bob", at[1], "Add parcel")], "sha string, author string, ts timestamp, message string"), "commit_files": spark.createDataFrame([("a", "f"), ("b", "f")], "sha string, file string"), "prs": spark.createDataFrame([(7, "PR", "merged", at[0])], "number int, title string, state string, merged_at timestamp"), "pr_commits": spark.createDataFrame([(7, "a")], "number int, sha string")}
    own = CodeIndex(tables)
    assert [r["sha"] for r in own.git_history(file="f").orderBy("sha").collect()] == ["a", "b"]
    assert [(r["sha"], r["number"]) for r in own.git_history(author="ann").collect()] == [("a", 7)]
    assert [r["sha"] for r in own.git_history(recent=True, now=datetime(2024, 1, 25)).collect()] == ["b"]


def test_entities(spark):
    text = ["defmodule Depot.Parcel do", '  @moduledoc """', "  Parcels of the App.", '  """', "  use Ecto.Schema", "", "  # makes one", '  @doc "Makes"', "  @spec make(map, list) :: t", "  def make(%{a: 1, b: 2}, opts) when is_list(opts) do", '    Logger.info("parcel maked")', "    start(Worker)", "  end", "  @impl true", "  def init(x), do: x", "  defp hide, do: :ok"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file string, line int, text string")
    assert entities.elixir_modules(lines).first()["moduledoc"] == "Parcels of the App."
    rows = {r["name"]: r for r in entities.elixir_functions(lines).collect()}
    assert (rows["make"]["arity"], rows["make"]["guards"], rows["make"]["doc"], rows["make"]["impl"]) == (2, "is_list(opts)", "Makes", False)
    assert (rows["init"]["impl"], rows["init"]["doc"], rows["hide"]["ftype"]) == (True, None, "defp")
    assert {r["target"] for r in entities.elixir_value_mentions(lines).collect()} == {"Worker"}
    assert {(r["kind"], r["text"], r["function"]) for r in entities.elixir_literals(lines).collect()} == {("string", "parcel maked", "make/2"), ("comment", "makes one", "make/2")}
    erl = ["-module(acc).", "-export([add/2]).", "%% @doc Adds", "add(A, B) -> A + B.", "help(X) -> X."]
    got = {(r["name"], r["arity"], r["ftype"], r["doc"]) for r in entities.erlang_functions(spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(erl)], "file string, line int, text string")).collect()}
    assert got == {("add", 2, "def", "Adds"), ("help", 1, "defp", None)}
    gleam = ["/// Hello", "pub fn hello(name: String) -> String {"]
    r = entities.gleam_functions(spark.createDataFrame([("src/a/b.gleam", i + 1, t) for i, t in enumerate(gleam)], "file string, line int, text string")).first()
    assert (r["module"], r["name"], r["arity"], r["ftype"], r["doc"]) == ("a/b", "hello", 1, "def", "Hello")
