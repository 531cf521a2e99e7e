"""Elixir by structure: nesting, heredocs, heads over several lines, nested and bare calls."""

from __future__ import annotations

import pytest

from kestrelgrid.sources import elixir

SOURCE = '''defmodule Depot.Parcels do
  @moduledoc """
  Says def fake(x) do and "quotes"
  end
  """
  alias Depot.Scales

  # def commented(a, b) do
  @doc "Runs"
  @spec run(
          integer,
          map
        ) :: term
  def run(a, %{b: 1, c: {2, 3}} = m) when is_integer(a) and
      a > 1 do
    Scales.go(a, fn x, y -> f(g(x), y) end)
    |> Enum.map(&h(&1, 2))
    Logger.info("do end #{inspect(m, pretty: true)} end")
    if a do
      Scales.long(
        a,
        [1, 2, 3],
        key: 1,
        other: 2
      )
    end
  end

  defmodule Inner do
    @moduledoc "inner doc"
    def one, do: :end
    defp two(a \\\\ 1, b)
    defp two(a, b), do: if(a, do: b, else: ~s(a ) |> x(1, 2))
  end

  @impl true
  def after_inner(x), do: Scales.zero
  defp char, do: ?(
  def s(a), do: ~r/end do (/
  def fields(r), do: r.end + r.do
  defmacro make(opts) do
    quote do
      unquote(opts)
    end
  end
end

defmodule Second do
  test "it works", %{conn: c} do
    assert run(c, 1) == 'do'
    raise ArgumentError, message: "bad", code: 3
    IO.puts "hello",
      1
    send self(), {:ok, a, b}
  end
  def last(), do: empty()
end
'''


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("f.ex", SOURCE), ("empty.ex", ""), ("null.ex", None), ("broken.ex", "defmodule X do\n def a(b do\n end end end\n) foo(\n")], "file string, source string").repartition(2)


def of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.where("file = 'f.ex'").collect()}


def test_tokens_cover_the_source(spark, files):
    from pyspark.sql import functions as F

    back = files.where("source is not null").select("file", "source", F.array_join(F.regexp_extract_all("source", F.lit(elixir.TOKEN), F.lit(0)), "").alias("joined"))
    assert back.where("source <> joined").count() == 0
    long = spark.createDataFrame([("x", 'a("' + "\\n \\" * 50_000 + 'b" <> "' + "#{c}" * 30_000 + '")')], "file string, source string")
    assert elixir.calls(long).collect()[0]["function"] == "a"


def test_modules(files):
    assert of(elixir.modules(files), "module", "outer", "line", "end_line", "moduledoc") == {
        ("Depot.Parcels", None, 1, 46, 'Says def fake(x) do and "quotes"\nend'),
        ("Inner", "Depot.Parcels", 29, 34, "inner doc"),
        ("Second", None, 48, 57, None),
    }


def test_functions(files):
    assert of(elixir.functions(files), "module", "name", "arity", "line", "ftype", "impl") == {
        ("Depot.Parcels", "run", 2, 14, "def", False), ("Inner", "one", 0, 31, "def", False), ("Inner", "two", 2, 32, "defp", False), ("Inner", "two", 2, 33, "defp", False),
        ("Depot.Parcels", "after_inner", 1, 37, "def", True), ("Depot.Parcels", "char", 0, 38, "defp", False), ("Depot.Parcels", "s", 1, 39, "def", False), ("Depot.Parcels", "fields", 1, 40, "def", False),
        ("Depot.Parcels", "make", 1, 41, "def", False), ("Second", "test: it works", 0, 49, "defp", False), ("Second", "last", 0, 56, "def", False),
    }
    assert of(elixir.functions(files).where("guards is not null or spec is not null or doc is not null"), "name", "guards", "spec", "doc") == {("run", "is_integer(a) and\n      a > 1", "run( integer, map ) :: term", "Runs")}


def test_calls(files):
    assert of(elixir.calls(files), "caller", "module", "function", "arity", "line") == {
        ("Depot.Parcels", None, "is_integer", 1, 14), ("Depot.Parcels", "Scales", "go", 2, 16), ("Depot.Parcels", None, "f", 2, 16), ("Depot.Parcels", None, "g", 1, 16), ("Depot.Parcels", "Enum", "map", 1, 17),
        ("Depot.Parcels", None, "h", 2, 17), ("Depot.Parcels", "Logger", "info", 1, 18), ("Depot.Parcels", "Scales", "long", 3, 20), ("Inner", None, "x", 2, 33), ("Depot.Parcels", "Scales", "zero", 0, 37),
        ("Depot.Parcels", None, "unquote", 1, 43), ("Second", None, "assert", 1, 50), ("Second", None, "run", 2, 50), ("Second", None, "raise", 2, 51), ("Second", "IO", "puts", 2, 52), ("Second", None, "send", 2, 54),
        ("Second", None, "self", 0, 54), ("Second", None, "empty", 0, 56),
    }


def test_literals(files):
    assert of(elixir.literals(files), "function", "text", "line") == {
        ("run/2", "do end #{inspect(m, pretty: true)} end", 18), ("s/1", "end do (", 39), ("test: it works/0", "bad", 51), ("test: it works/0", "hello", 52),
    }


def test_special_forms_are_those_of_the_contract():
    assert len(elixir.SPECIAL_FORMS) == 15 and "quote" not in elixir.SPECIAL_FORMS


def test_lines_and_sources(spark):
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, None), ("f", 4, "b"), ("g", 3, "c")], "file string, line int, text string")
    assert {r["file"]: r["source"] for r in elixir.sources_of(lines).collect()} == {"f": "a\n\n\nb", "g": "\n\nc"}
