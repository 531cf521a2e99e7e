"""Erlang forms and Gleam functions: exports over lines, clauses, guards, edoc tags."""

from __future__ import annotations

from kestrelgrid.sources import forms

ERLANG = r'''%% A module. Not a doc.
-module(depot).
-export([
    start/1, % the first. one
    'Odd Name'/2,
    stop/0
]).
-export([add/2]).
-record(box, {size = 1.5, label = "a. b"}).
-type handler() :: fun((integer()) -> ok).

%% @doc Starts it.
%% All of it.
%% @param Name the name of it
%% @returns ok
%% @since 2
%% not doc
-spec start(atom()) ->
    ok.
start(Name) when is_atom(Name); Name == "x. " ->
    F = fun(A, B) -> A; (_, _) -> 1 end,
    case Name of
        a -> $.;
        b -> "end. ; %"
    end;
start(#{a := 1, b := {2, [3, 4]}}) -> fun stop/0;
start(_) -> ok.

%% @private
'Odd Name'(X, Y) -> X + Y * 2.0.

%% no tag here
stop() -> ok.

%% @doc Far away

add(A,
    B) ->
    begin A + B end.
hidden() -> try stop() catch _:_ -> ok end.
'''
GLEAM = '''//// module text
/// Says hello
/// twice
pub fn hello(
  name: String,
  to other: List(#(Int, Int)),
) -> String {
  let f = fn(a, b) { a + b }
  "fn fake(x)" // fn also(y)
}

fn inner() -> Nil { Nil }
/// stray

pub fn later(x) { x }
'''


def test_erlang(spark):
    files = spark.createDataFrame([("depot.erl", ERLANG), ("open.erl", "-module(open).\n-compile([export_all, nowarn]).\nall() -> ok."), ("empty.erl", ""), ("null.erl", None)], "file string, source string")
    rows = {(r["file"], r["name"], r["arity"]): r for r in forms.erlang_functions(files).collect()}
    assert {k: (r["module"], r["line"], r["ftype"], r["clauses"], r["doc"], r["private"]) for k, r in rows.items()} == {
        ("depot.erl", "start", 1): ("depot", 20, "def", 3, "Starts it. All of it.", False),
        ("depot.erl", "Odd Name", 2): ("depot", 30, "def", 1, None, True),
        ("depot.erl", "stop", 0): ("depot", 33, "def", 1, None, False),
        ("depot.erl", "add", 2): ("depot", 37, "def", 1, None, False),
        ("depot.erl", "hidden", 0): ("depot", 40, "defp", 1, None, False),
        ("open.erl", "all", 0): ("open", 3, "def", 1, None, False),
    }
    start = rows["depot.erl", "start", 1]
    assert [(p["name"], p["desc"]) for p in start["params"]] == [("Name", "the name of it")] and start["returns"] == "ok"


def test_gleam(spark):
    files = spark.createDataFrame([("app/src/depot/hello.gleam", GLEAM), ("test/x.gleam", "")], "file string, source string")
    rows = {(r["name"], r["module"], r["arity"], r["line"], r["ftype"], r["doc"]) for r in forms.gleam_functions(files).collect()}
    assert rows == {("hello", "depot/hello", 2, 4, "def", "Says hello\ntwice"), ("inner", "depot/hello", 0, 12, "defp", None), ("later", "depot/hello", 1, 15, "def", None)}
