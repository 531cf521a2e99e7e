"""Readers, parsers and streams on small files."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kestrelgrid.sources import files, git, index, logs, parsers, scip, signatures
from kestrelgrid.streaming import feeds


def test_index_round_trip(spark, tmp_path):
    doc = {"modules": {"MyApp.User": {"file": "lib/user.ex", "line": 1, "functions": [{"name": "create", "arity": 2, "args": ["a", "b"], "line": 5, "type": "def", "keywords": {"make": 0.5}}], "calls": [{"module": None, "function": "help", "arity": 0, "line": 9}], "aliases": {"Repo": "MyApp.Repo"}, "uses": ["GenServer"], "keywords": {"user": 1.0}}}, "metadata": {"total_modules": 1}}
    (tmp_path / "index.json").write_text(json.dumps(doc))
    tables = index.read_index(spark, str(tmp_path / "index.json"))
    index.write_index(tables, str(tmp_path / "db"))
    back = index.load_index(spark, str(tmp_path / "db"))
    assert back["functions"].first()["name"] == "create"
    assert {(r["kind"], r["target"]) for r in back["module_refs"].collect()} == {("use", "GenServer"), ("alias", "MyApp.Repo")}
    assert {(r["entity"], r["kw"]) for r in back["entity_keywords"].collect()} == {("MyApp.User", "user"), ("MyApp.User.create/2", "make")}
    bad = back["functions"].withColumn("arity", F.lit(-1))
    assert {r["rule"] for r in index.violations(bad, "name", index.strict_rules()).collect()} == {"arity", "arity_args"}
    assert index.violations(back["functions"], "name", index.strict_rules()).count() == 0


def test_discovery(spark, tmp_path):
    for name, text in {"lib/a.ex": "defmodule A do", "lib/gen/b.ex": "x", "deps/c.ex": "x", "lib/d.txt": "x", "lib/keep.ex": "y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.discover(spark, str(tmp_path), [".ex"], ["deps"], ["gen/", "keep.ex", "!keep.ex"])
    assert {r["path"] for r in found.collect()} == {"lib/a.ex", "lib/keep.ex"}
    assert files.hashes(found).where("path = 'lib/keep.ex'").first()["md5"] == "415290769594460e2e485922904f345d"
    assert "defmodule" in {r["kw"] for r in files.text_keywords(found).collect()}


def test_log(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 12), "query", "r1", 100.0 + d, 1, 2, True, None, "a\nb") for d in (1, 2, 3)]
    logs.append(spark.createDataFrame(rows, logs.LOG), str(tmp_path / "log"))
    day = next((tmp_path / "log").glob("day=2024-01-03"))
    (day / "extra.json").write_text("not json\n")
    log = logs.read(spark, str(tmp_path / "log"), since=date(2024, 1, 2))
    assert log.count() == 2
    assert [r["ts"].day for r in logs.tail(log, 1).collect()] == [3]
    assert logs.older(logs.read(spark, str(tmp_path / "log")), date(2024, 1, 4), 2).count() == 1


def test_history_exports(spark):
    lines = ["COMMIT:aa", "", "lib/a.ex", "lib/b.ex", "COMMIT:bb", "lib/a.ex"]
    log = git.change_log(spark.createDataFrame(list(enumerate(lines)), "line_no int, text string"))
    assert {(r["sha"], r["file"]) for r in log.collect()} == {("aa", "lib/a.ex"), ("aa", "lib/b.ex"), ("bb", "lib/a.ex")}
    blame = spark.createDataFrame([("f", 1, "x", "1", ""), ("f", 2, "x", "1", ""), ("f", 3, "y", "2", ""), ("f", 4, "x", "1", "")], "file string, line int, author string, sha string, text string")
    assert [(r["start_line"], r["end_line"]) for r in git.blame(blame).orderBy("start_line").collect()] == [(1, 2), (3, 3), (4, 4)]
    prs = json.dumps([{"number": 7, "title": "t", "state": "merged", "merged_at": "2024-01-01T00:00:00Z", "commits": ["a", "b"], "files_changed": ["f"], "comments": [{"id": "c", "path": "f", "line": 3, "original_line": 2, "created_at": "2024-01-01T00:00:00Z"}]}])
    tables = git.pull_requests(spark.createDataFrame([(prs,)], "j string"), "j")
    assert [tables[k].count() for k in ("prs", "pr_commits", "pr_files", "pr_comments")] == [1, 2, 1, 1]


def test_signatures(spark):
    src = {"python": "def a(x, y=1):\n  pass\nasync def b():\n", "elixir": "  def run(a, b) do\n  defp go do\n", "rust": "pub fn new(&mut self, x: u8) -> Self {\nfn free(a: i32, b: i32) {"}
    got = {k: {(r["name"], r["arity"]) for r in signatures.scan(spark.createDataFrame([(v,)], "source string"), "source", k).collect()} for k, v in src.items()}
    assert got == {"python": {("a", 2), ("b", 0)}, "elixir": {("run", 2), ("go", 0)}, "rust": {("new", 1), ("free", 2)}}


def test_elixir_scan(spark):
    text = ["defmodule A.B do", "  alias X.{Y, Z}", "  alias Q.R, as: S", "  use GenServer", "  def run(a) do", "    Y.call(a, 1)", "    local(a)", "  end", "end"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file string, line int, text string")
    assert {(r["module"], r["name"], r["arity"]) for r in signatures.elixir_scopes(lines).collect()} == {("A.B", "run", 1)}
    refs = {(r["kind"], r["target"], r["name"]) for r in signatures.elixir_references(lines).collect()}
    assert refs == {("alias", "X.Y", "Y"), ("alias", "X.Z", "Z"), ("alias", "Q.R", "S"), ("use", "GenServer", "GenServer")}
    assert {(r["module"], r["function"], r["arity"]) for r in signatures.elixir_calls(lines).collect()} == {("Y", "call", 2), (None, "local", 1)}


def test_python_and_rust_parsers(spark):
    src = '"""doc"""\nimport a.b as c\nfrom x import y\ndef f():\n    """doc f"""\n    return "hello" + f"fixed {1} part"\n'
    df = spark.createDataFrame([("p", src), ("bad", "def (")], "path string, source string")
    assert {(r["text"].strip(), r["function"]) for r in parsers.python_literals(df, "path", "source").collect()} == {("hello", "f"), ("fixed", "f"), ("part", "f")}
    assert {(r["alias"], r["target"]) for r in parsers.python_aliases(df, "path", "source").collect()} == {("c", "a.b"), ("y", "x.y")}
    rust = spark.createDataFrame([("m.rs", "use std::{fmt, io::{self, Read as R}};\n")], "file string, source string")
    assert {(r["alias"], r["target"]) for r in parsers.rust_uses(rust).collect()} == {("fmt", "std::fmt"), ("io", "std::io"), ("R", "std::io::Read")}
    assert parsers.split_arguments("a: Map<K, V>, b = f(1, 2), c") == ["a: Map<K, V>", "b = f(1, 2)", "c"]


def test_name_likeness(spark):
    names = spark.createDataFrame([("MyApp.User",), ("Other",), ("UserX",)], "n string")
    rows = parsers.similar(names, "n", "User", 5).collect()
    assert [r["name"] for r in rows][0] == "UserX" and {r["name"] for r in rows} >= {"UserX", "MyApp.User"}
    assert [r["name"] for r in parsers.similar(names, "n", "other", 5).collect()] == ["Other"]


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        return bytes([number << 3, value])
    size = [len(value)] if len(value) < 128 else [len(value) & 127 | 128, len(value) >> 7]
    return bytes([number << 3 | 2, *size]) + value


def test_protocol_files(spark):
    def occurrence(place, symbol, roles, around=b""):
        return _field(2, _field(1, bytes(place)) + _field(2, symbol.encode()) + _field(3, roles) + (_field(7, bytes(around)) if around else b""))

    caller, callee = "s p k `m`/run().", "s p k `m`/go()."
    doc = _field(1, b"m.py") + occurrence([0, 0, 3], caller, 1, [0, 0, 5, 0]) + occurrence([0, 5, 6], caller + "(x)", 1) + occurrence([2, 4, 6], callee, 0) + occurrence([8, 0, 2], callee, 1, [8, 0, 9, 0])
    tables = scip.convert(scip.occurrences(spark.createDataFrame([(bytearray(_field(2, doc)),)], "content binary")))
    assert {(r["name"], r["arity"]) for r in tables["functions"].collect()} == {("run", 1), ("go", 0)}
    assert [(r["caller"], r["callee"], r["line"]) for r in tables["calls"].collect()] == [(caller, callee, 3)]
    assert tables["reverse_calls"].first()["callee"] == callee


def test_protocol_docs_imports_and_modules(spark):
    def occurrence(line, symbol, roles):
        return _field(2, _field(1, bytes([line, 0, 3])) + _field(2, symbol.encode()) + _field(3, roles))

    run, other = "s p k `m`/run().", "s p k `lib`/help()."
    said = _field(3, _field(1, run.encode()) + _field(3, b"```python\ndef run(a, b)\n```") + _field(3, b"Runs it."))
    doc = _field(1, b"m.py") + occurrence(0, run, 1) + occurrence(2, other, 0) + occurrence(90, "s p k `late`/f().", 0) + occurrence(95, "s p k `marked`/g().", 2) + said
    files = spark.createDataFrame([(bytearray(_field(2, doc)),)], "content binary")
    tables = scip.convert(scip.occurrences(files), scip.descriptions(files))
    r = tables["functions"].first()
    assert (r["signature"], r["doc"]) == ("def run(a, b)", "Runs it.")
    assert {r["module"] for r in tables["imports"].collect()} == {"lib", "marked"}
    assert [(r["module"], r["functions"], r["public"]) for r in tables["modules"].collect()] == [("m", 1, 1)]


def test_feed_refresh(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, path in enumerate(["lib/a.ex", "deps/b.ex", "lib/c.txt"]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"ts": "2024-01-01T00:00:00", "path": path}))
    seen = []
    rows = feeds.changes(spark, str(tmp_path / "in"), "ts timestamp, path string", (".ex",), ("deps",))
    feeds.follow(rows, lambda df, number: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "state"), every=None).awaitTermination()
    assert seen == ["lib/a.ex"]


def test_change_log_goes_on_after_a_restart(spark, tmp_path):
    """A second run from the checkpoint upserts into what the first one left; a batch that is run again changes nothing."""
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"path": p, "ts": t, "md5": m}) for p, t, m in rows))

    def run():
        schema = "path string, ts long, md5 string"
        log = feeds.ChangeLog(spark, str(tmp_path / "log"), schema, ["path"], ["ts"])
        batches = []
        rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        feeds.follow(rows, lambda df, n: (log.add(df, n), log.add(df, n), batches.append(n)), str(tmp_path / "checkpoint"), every=None).awaitTermination()
        return {r["path"]: r["md5"] for r in log.rows().collect()}, batches, log

    assert feeds.ChangeLog(spark, str(tmp_path / "log"), "path string, ts long, md5 string", ["path"], ["ts"]).rows().count() == 0
    put("1.json", [("a", 1, "a1"), ("b", 5, "b5"), ("b", 2, "b2")])
    assert run()[:2] == ({"a": "a1", "b": "b5"}, [0])
    put("2.json", [("a", 7, "a7"), ("c", 1, "c1"), ("b", 1, "b1")])
    state, batches, log = run()
    assert (state, batches) == ({"a": "a7", "b": "b1", "c": "c1"}, [1])
    small = log.compact(str(tmp_path / "small"))
    small.add(spark.createDataFrame([("c", 9, "c9")], "path string, ts long, md5 string"), 2)
    assert {r["path"]: r["md5"] for r in small.rows().collect()} == {"a": "a7", "b": "b1", "c": "c9"}


def test_bursts_that_batches_part(spark):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("u", at(0), "x"), ("u", at(8), "y"), ("u", at(5), "z"), ("u", at(18), "w"), ("v", at(5), "x")]
    parts = [feeds.burst_parts(spark.createDataFrame(r, "k string, ts timestamp, path string"), "k", 10) for r in (rows[:2], rows[2:4], rows[4:])]
    got = feeds.merged_bursts(parts[0].unionAll(parts[1]).unionAll(parts[2]), "k").orderBy("k", "first_ts").collect()
    assert [(r["k"], r["first_ts"], r["closed_at"], r["changes"], r["paths"]) for r in got] == [("u", at(0), at(18), 3, ["x", "y", "z"]), ("u", at(18), at(28), 1, ["w"]), ("v", at(5), at(15), 1, ["x"])]


def test_repeated_points_keep_their_rows(spark):
    from kestrelgrid.operators import asof

    points = spark.createDataFrame([("m", 5), ("m", 5), ("m", 50), (None, 5)], "module string, at int")
    ranges = spark.createDataFrame([("m", 1, 9, "wide"), ("m", 4, 6, "narrow")], "module string, start int, stop int, symbol string")
    assert [(r["at"], r["symbol"]) for r in asof.enclosing(points, ranges, ["module"], "at").collect()] == [(5, "narrow")] * 2


def test_tool_log_stream_has_all_windows(spark):
    """The stream's table is the batch aggregate over all events, the last day's open windows with it."""
    import pytest

    from kestrelgrid.operators import usage as U
    from kestrelgrid.plans import load

    from .conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    log = events.select(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("tool_name"), F.col("value").alias("execution_time_ms"), (F.col("event_type") != "error").alias("success"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    want = {(str(r["day"]), r["tool_name"]): r for r in log.groupBy("day", "tool_name").agg(*U.measures()).collect()}
    rows = load()["stream_tool_log"](spark, SF).collect()
    got = {(str(r["day"]), r["tool_name"]): r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert sum(r["calls"] for r in rows) == events.count()
    for k, r in got.items():
        for c in ("calls", "success_pct", "total_ms", "avg_ms", "tokens"):
            assert r[c] == pytest.approx(want[k][c], abs=1e-5)


def test_line_log(spark):
    from kestrelgrid.sources import git

    text = ["noise", "COMMIT:ab12|Ann|2024-02-01T10:00:00|Second | change", "", "diff --git a/f b/f", "--- a/f", "+++ b/f", "@@ -3,2 +3,3 @@", " def x", "-old", "+new", "+++more", "COMMIT:cd34|Bob|bad time|First", "@@ -0,0 +1,2 @@", "+a", "+b"]
    rows = git.line_log(spark.createDataFrame([("x/1", k, s) for k, s in enumerate(text)] + [("y/0", 1, "nothing")], "name string, line_no int, text string")).orderBy("ordinal").collect()
    assert [(r["name"], r["sha"], r["author"], r["message"], r["start_line"], r["end_line"], r["added"], r["removed"]) for r in rows] == [("x/1", "ab12", "Ann", "Second | change", 3, 5, 2, 1), ("x/1", "cd34", "Bob", "First", 1, 2, 2, 0)]
    assert str(rows[0]["ts"]) == "2024-02-01 10:00:00" and rows[1]["ts"] is None


def test_keyword_forms(spark):
    from pyspark.sql import functions as F

    from kestrelgrid.functions import text as T

    forms = {'{"a": 2, "b": 0.5}': {"a": 2.0, "b": 0.5}, '["a", "b", "a"]': {"a": 1.0, "b": 1.0}, '[["a", 0.3], ["b", 2]]': {"a": 0.3, "b": 2.0}, '[{"word": "a", "score": 3}, {"keyword": "b"}]': {"a": 3.0, "b": 1.0}, '{"top_keywords": [["a", 1], ["a", 4]]}': {"a": 4.0}, "": {}, "7": {}}
    df = spark.createDataFrame([(k,) for k in forms], "j string")
    assert {r["j"]: r["m"] for r in df.select("j", T.keyword_map(F.col("j")).alias("m")).collect()} == forms


def test_inflections(spark):
    from pyspark.sql import functions as F

    from kestrelgrid.functions import text as T

    rows = spark.createDataFrame([(w,) for w in ("carry", "make", "box", "walk", "play", "see", "my_name", "x2")], "kw string").select("kw", T.inflections(F.col("kw"))["word"].alias("f")).collect()
    got = {r["kw"]: r["f"] for r in rows}
    assert got["carry"] == ["carry", "carries", "carried", "carrying", "carrier", "carriest"] and got["make"] == ["make", "makes", "maked", "making", "maker", "makest"]
    assert got["box"][1] == "boxes" and got["walk"][1:4] == ["walks", "walked", "walking"] and got["play"][1:4] == ["plays", "played", "playing"] and got["see"][3] == "seeing"
    assert got["my_name"] == ["my_name"] and got["x2"] == ["x2"]


def test_enrichment_goes_on_after_a_break(spark, tmp_path):
    from kestrelgrid.operators import enrich

    tables = {
        "entities": spark.createDataFrame([("M.load_user/1", "load_user", "Loads the user from disk, load twice")], "entity string, name string, doc string"),
        "literals": spark.createDataFrame([("M.load_user/1", "string", "disk failure"), ("M.load_user/1", "comment", "slow disk path")], "entity string, kind string, text string"),
    }
    first = enrich.enrich(spark, tables, str(tmp_path), until="strings")
    assert "comments" not in first and first["strings"].count() == 2
    made = {p: p.stat().st_mtime_ns for p in tmp_path.glob("*/_SUCCESS")}
    done = enrich.enrich(spark, tables, str(tmp_path))
    assert all(p.stat().st_mtime_ns == t for p, t in made.items()) and len(list(tmp_path.glob("*/_SUCCESS"))) == 4  # what had ended isn't made again
    rows = {r["kw"]: (round(r["weight"], 3), r["sources"]) for r in done["entity_keywords"].collect()}
    assert rows["failure"] == (1.3, "strings") and rows["disk"][1] == "comments+docs+strings" and rows["user"][0] == 1.5
    # an input that has changed is
    other = tables | {"literals": tables["literals"].where("kind = 'comment'")}
    again = enrich.enrich(spark, other, str(tmp_path))
    assert again["strings"].count() == 0 and {r["kw"] for r in again["entity_keywords"].collect()} == set(rows) - {"failure"}
    assert all(p.stat().st_mtime_ns == t for p, t in made.items())


def test_enrichment_of_each_language(spark, tmp_path):
    """Sources of three languages through their scans, enrichment and a search."""
    from kestrelgrid.operators import enrich, search
    from kestrelgrid.operators import keywords as K
    from kestrelgrid.functions import scores as S
    from kestrelgrid.sources import enrichment

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        size = [len(value)] if len(value) < 128 else [len(value) & 127 | 128, len(value) >> 7]
        return bytes([number << 3 | 2, *size]) + value

    symbol = "s p k `billing`/charge_card()."
    occurrence = field(2, field(1, bytes([0, 0, 3])) + field(2, symbol.encode()) + field(3, 1))
    said = field(3, field(1, symbol.encode()) + field(3, b"```python\ndef charge_card(amount)\n```") + field(3, b"Takes money, once."))
    scip_files = spark.createDataFrame([(bytearray(field(2, field(1, b"billing.py") + occurrence + said)),)], "content binary")
    python = spark.createDataFrame([("billing.py", 'def charge_card(amount):\n    """doc"""\n    return "declined payment"\n')], "path string, source string")
    erlang = spark.createDataFrame([("depot.erl", "-module(depot).\n-export([ship/1]).\n%% @doc Sends a parcel abroad\n%% slowly\nship(X) -> io:format(\"parcel lost\"), X.\n")], "file string, source string")
    elixir = spark.createDataFrame([("depot.ex", 'defmodule Depot do\n  @doc "Weighs parcels"\n  # rounding matters\n  def weigh(p) do\n    Logger.info("scale broken")\n  end\nend\n')], "file string, source string")
    parts = {"python": enrichment.python(scip_files, python), "erlang": enrichment.erlang(erlang), "elixir": enrichment.elixir(elixir)}
    for name, tables in parts.items():
        k = enrich.enrich(spark, tables, str(tmp_path / name))["entity_keywords"]
        k = k.join(S.zipf(K.document_frequency(k)).select("kw", "zipf"), "kw")
        find = lambda *words, k=k: {r["entity"] for r in search.exact(k, search.terms(spark, list(words)), len(words)).collect()}
        want = {"python": ("billing.charge_card/0", ["money", "declined", "charge"]), "erlang": ("depot.ship/1", ["parcel", "abroad", "slowly", "lost"]), "elixir": ("Depot.weigh/1", ["parcels", "rounding", "broken"])}[name]
        for word in want[1]:
            assert find(word) == {want[0]}, (name, word)


def test_logged_calls(spark, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from kestrelgrid.operators import usage
    from kestrelgrid.sources import logs

    path, noon = str(tmp_path / "log"), datetime(2024, 5, 1, 12)
    rows = logs.call(spark, path, "query", lambda: spark.range(3), "r1", noon)
    assert [r["id"] for r in rows] == [0, 1, 2]
    with pytest.raises(Exception, match="nosuch"):
        logs.call(spark, path, "query", lambda: spark.range(3).select("nosuch"), "r1", noon)
    with pytest.raises(ZeroDivisionError):
        logs.call(spark, path, "search_module", lambda: 1 / 0, None, noon)
    log = logs.read(spark, path)
    got = {(r["tool_name"], r["success"]): r for r in log.collect()}
    assert len(got) == 3 and got["query", True]["response"].count("\n") == 2 and got["query", True]["error"] is None
    assert "nosuch" in got["query", False]["error"] and "\n" not in got["query", False]["error"] and got["search_module", False]["error"] == "division by zero"
    assert all(r["execution_time_ms"] > 0 for r in got.values())
    log = log.withColumn("tokens", F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    stats = {r["tool_name"]: (r["calls"], r["success_pct"]) for r in usage.by_tool(log).collect()}
    assert stats == {"query": (2, 50.0), "search_module": (1, 0.0)}
    assert [(r["day"], r["calls"]) for r in usage.daily(log).collect()] == [("2024-05-01", 3)]


def test_usage_of_late_rows(spark, tmp_path):
    """Rows that come days late count, in whatever order files are read."""
    import json as j

    (tmp_path / "in").mkdir()
    rows = [("2024-01-09", 4.0, True), ("2024-01-01", 1.0, True), ("2024-01-09", 2.0, False), ("2024-01-01", None, True)]
    for k, (day, ms, ok) in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text(j.dumps({"ts": f"{day}T10:00:00", "tool_name": "q", "execution_time_ms": ms, "success": ok, "tokens": 1}))
    log = spark.readStream.schema("ts timestamp, tool_name string, execution_time_ms double, success boolean, tokens long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    keep = lambda batch, number: feeds.usage_parts(batch).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
    feeds.follow(log, keep, str(tmp_path / "state"), every=None).awaitTermination()
    parts = feeds.batches(spark, f"{tmp_path}/out", "day timestamp, tool_name string, calls long, succeeded long, total_ms double, timed long, tokens long, batch long")
    got = {str(r["day"].date()): (r["calls"], r["success_pct"], r["total_ms"], r["avg_ms"], r["tokens"]) for r in feeds.merged_usage(parts).collect()}
    assert got == {"2024-01-09": (2, 50.0, 6.0, 3.0, 2), "2024-01-01": (2, 100.0, 1.0, 1.0, 2)}


def test_protocol_types_and_languages(spark):
    def occurrence(line, symbol, roles):
        return _field(2, _field(1, bytes([line, 0, 3])) + _field(2, symbol.encode()) + _field(3, roles))

    box, shape, plain = "s p k `m`/Box#", "s p k `m`/Shape#", "s p k `m`/Plain#"
    said = _field(3, _field(1, box.encode()) + _field(3, b"A box.") + _field(5, 49)) + _field(3, _field(1, shape.encode()) + _field(3, b"```ts\ninterface Shape\n```"))
    doc = _field(1, b"m.ts") + b"".join(occurrence(n, s, 1) for n, s in enumerate([box, box + "open().", box + "_hide().", shape, plain])) + said
    doc += occurrence(1, "s p k `os`/path().", 2) + occurrence(1, "s p k `lib`/go().", 2)
    tool = _field(1, _field(2, _field(1, b"scip-typescript")))
    files = spark.createDataFrame([("a", bytearray(tool + _field(2, doc))), ("b", bytearray(tool + _field(2, doc) + _field(2, _field(4, b"Rust")))), ("c", bytearray(b""))], "name string, content binary")
    assert {tuple(r) for r in scip.languages(files).collect()} == {("a", "typescript"), ("b", "Rust"), ("c", "unknown")}
    one = files.where("name = 'a'")
    tables = scip.convert(scip.occurrences(one), scip.descriptions(one))
    assert {(r["name"], r["line"], r["kind"], r["methods"], r["public"]) for r in tables["classes"].collect()} == {("Box", 1, "struct", 2, 1), ("Shape", 4, "interface", 0, 0), ("Plain", 5, "class", 0, 0)}
    assert {r["name"]: r["moduledoc"] for r in tables["classes"].collect()}["Box"] == "A box."
    assert {r["module"] for r in tables["imports"].collect()} == {"lib"}
    assert {r["kind"] for r in scip.convert(scip.occurrences(one))["classes"].collect()} == {"class"}
