"""Small literal inputs with values worked out by hand."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kestrelgrid.functions import dates as D
from kestrelgrid.functions import patterns as P
from kestrelgrid.functions import scores as S
from kestrelgrid.functions import text as T
from kestrelgrid.operators import asof, graph, history, merge, pairs, search
from kestrelgrid.operators import keywords as K
from kestrelgrid.operators import usage as U


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def truth(spark, predicate, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(predicate(F.col("c"))).collect()]


def test_document_frequency_weights(spark):
    docs = [("a", "common"), ("a", "one"), ("b", "common"), ("b", "two"), ("c", "common"), ("c", "rare")]
    w = spark.createDataFrame([(e, k, 1.0) for e, k in docs], "entity string, kw string, weight double")
    z = S.zipf(K.document_frequency(w))
    assert {r["kw"]: r["zipf"] for r in z.collect()} == {"common": 0.5, "one": 1.0, "two": 1.0, "rare": 1.0}
    w = w.join(z.select("kw", "zipf"), "kw")
    rare = search.exact(w, search.terms(spark, ["rare"]), 1).collect()
    assert [(r["entity"], round(r["score"], 6)) for r in rare] == [("c", 1.6)]
    common = search.exact(w, search.terms(spark, ["common"]), 1).orderBy("entity").collect()
    assert [(r["entity"], round(r["score"], 6)) for r in common] == [("a", 0.8), ("b", 0.8), ("c", 0.8)]


def test_repeated_terms_decay(spark):
    assert [r["decay"] for r in search.terms(spark, ["x", "x", "X"]).orderBy("pos").collect()] == [1.0, 0.5, 0.25]


@pytest.mark.parametrize("values,percentiles,norm", [([1.0, 2.0, 3.0, 4.0, 5.0], [0, 20, 40, 60, 80], [0, 0.25, 0.5, 0.75, 1]), ([2.0, 2.0], [50, 50], [0.5, 0.5]), ([7.0], [50], [1.0])])
def test_distribution(spark, values, percentiles, norm):
    rows = S.distribution(spark.createDataFrame([(v,) for v in values], "score double")).orderBy("score").collect()
    assert [r["percentile"] for r in rows] == percentiles
    assert [r["normalized"] for r in rows] == norm
    if len(values) == 5:
        assert round(rows[0]["sd"], 4) == 1.5811


def test_tiers(spark):
    rows = spark.createDataFrame([(2.1,), (2.0,), (0.0,), (-0.5,), (-1.0,)], "z double").select(S.tier(F.col("z"))).collect()
    assert [r[0] for r in rows] == ["exceptional", "strong", "above_average", "below_average", "weak"]


def test_cochange_factor(spark):
    assert one(spark, F.round(search.cochange_factor(F.lit(18)), 6)) == 1.09
    assert one(spark, F.round(search.cochange_factor(None, F.lit(15), F.lit(18)), 6)) == 1.195


def test_wildcards(spark):
    assert truth(spark, lambda c: P.wildcard(c, "get_*"), ["get_user", "GET_X", "forget_", ""]) == [True, True, False, False]
    assert truth(spark, lambda c: P.wildcard(c, "*"), ["a", ""]) == [True, True]
    assert truth(spark, lambda c: P.wildcard(c, "a?c"), ["abc"]) == [False]
    assert truth(spark, lambda c: P.wildcard(c, "a.b*"), ["a.bc", "axbc"]) == [True, False]
    assert truth(spark, lambda c: P.wildcard(c, "[ab]x*"), ["axe", "cxe"]) == [True, False]


def test_qualified(spark):
    names = ["User", "MyApp.User", "User.Schema", "MyApp.User.Schema", "MyApp.Users"]
    assert truth(spark, lambda c: P.qualified(c, "*.User"), names) == [True, True, True, True, False]
    assert truth(spark, lambda c: P.qualified(c, "*.User*"), names) == [True, True, True, True, True]
    assert truth(spark, lambda c: P.qualified(c, "myapp.user"), names) == [False, True, False, False, False]
    assert truth(spark, lambda c: P.qualified(c, None), names) == [True] * 5


@pytest.mark.parametrize("text,expected", [
    ("create_user", (None, None, "create_user", None)),
    ("User.create/2", (None, "*.User", "create", "2")),
    ("lib/user.ex:User.create", ("lib/user.ex", "*.User", "create", None)),
    ("*.User.create/x", (None, "*.User", "create", None)),
    ("Shop.Cart.add/1", (None, "*.Shop.Cart", "add", "1")),
    ("a:b.c", (None, "*.a:b", "c", None)),
    ("  ", (None, None, None, None)),
])
def test_function_patterns(text, expected):
    said = P.function_parts(text)
    assert (said["file"], said["module"], said["name"], said["arity"]) == expected


def test_function_match(spark):
    rows = [("Shop.Cart", "lib/cart.ex", "add", 1), ("Shop.Cart", "lib/cart.ex", "add", 2), ("Shop.Cart.Line", "lib/line.ex", "Add_all", 1), ("Other", "lib/o.ex", "drop", 0)]
    df = spark.createDataFrame(rows, "m string, f string, n string, a int").coalesce(1)
    match = lambda text: [r["n"] + str(r["a"]) for r in df.where(P.function_match(text, F.col("m"), F.col("f"), F.col("n"), F.col("a"))).collect()]
    assert match("Cart.add") == ["add1", "add2"] and match("add/2|drop") == ["add2", "drop0"]
    assert match("lib/line.ex:Cart.add*") == ["Add_all1"] and match("") == match(None) == match("*") == ["add1", "add2", "Add_all1", "drop0"]
    assert match("Cart.*/1") == ["add1", "Add_all1"]


def test_globs(spark):
    paths = ["lib/a.ex", "lib/x/b.exs", "a.ex", "lib/x/y/c.py"]
    assert truth(spark, lambda c: P.glob(c, "lib/*.ex"), paths) == [True, False, False, False]
    assert truth(spark, lambda c: P.glob(c, "**/*.{ex,exs}"), paths) == [True, True, True, False]
    assert truth(spark, lambda c: P.glob(c, "!lib/**"), paths) == [False, False, True, False]
    assert P.resolve_glob(None, "lib", "py") == "lib/**/*.py"
    assert P.resolve_glob(None, "lib", None) == "lib/**"
    assert P.resolve_glob("*.ex", None, None) == "*.ex"


def test_test_files(spark):
    paths = ["test/a.ex", "lib/test_a.py", "lib/a_test.exs", "lib/attest.ex", "tests/b.py"]
    assert truth(spark, P.is_test_path, paths) == [True, True, True, False, True]


def test_identifiers(spark):
    text = "getUserData and HTTPServer, UserController, snake_case_name, SQL x Plain"
    assert one(spark, T.identifiers(F.col("t")), t=text) == sorted(["getUserData", "HTTPServer", "UserController", "snake_case_name", "SQL"])
    for name, parts in (("getHTTPResponseCode", ["get", "http", "response", "code"]), ("PostgreSQL", ["postgre", "sql"]), ("snake_case", ["snake", "case"])):
        assert one(spark, T.split_identifier(F.col("t")), t=name) == parts


def test_keyword_weights(spark):
    rows = K.extract(spark.createDataFrame([("e", "load userName now load")], "id string, doc string"), "id", "doc")
    got = {r["kw"]: r["times"] for r in rows.collect()}
    assert got == {"load": 2, "username": 11, "now": 1, "user": 3, "name": 3}


def test_names(spark):
    r = one(spark, T.parse_canonical(F.col("t")), t="My.App.run/2")
    assert (r["module"], r["name"], r["arity"]) == ("My.App", "run", 2)
    assert one(spark, T.simple_name(F.col("t")), t="My.App.Run/2") == "run"
    assert one(spark, T.to_camel(F.col("t")), t="get_user_data") == "getUserData"
    assert one(spark, T.to_snake(F.col("t")), t="getUserData") == "get_user_data"
    assert one(spark, T.pr_number(F.col("t")), t="Fix it (PR #42) (#7)") == 42
    assert one(spark, T.highlight(F.col("t"), ["user", "users"]), t="Users and user") == "*Users* and *user*"
    s = one(spark, T.symbol_parts(F.col("t")), t="scip-python python pkg 1 `a.b`/Kit#_run().")
    assert (s["module"], s["parent"], s["name"], s["kind"], s["private"]) == ("a.b", "Kit", "_run", "method", True)


def test_asof_first_and_ties(spark):
    left = spark.createDataFrame([("m", 1), ("m", 5), ("m", 9), ("x", 3)], "k string, line int")
    right = spark.createDataFrame([("m", 5, "b"), ("m", 5, "a"), ("m", 7, "c")], "k string, line int, fn string")
    back = {(r["k"], r["line"]): r["fn"] for r in asof.asof(left, right, ["k"], "line", ["fn"]).collect()}
    assert back == {("m", 1): None, ("m", 5): "a", ("m", 9): "c", ("x", 3): None}
    ahead = {(r["k"], r["line"]): r["fn"] for r in asof.asof(left, right, ["k"], "line", ["fn"], forward=True).collect()}
    assert ahead == {("m", 1): "a", ("m", 5): "a", ("m", 9): None, ("x", 3): None}


def test_closure_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 1)], "src int, dst int")
    rows = graph.closure(edges, spark.createDataFrame([(1,)], "root int"), 2).collect()
    assert {(r["node"], r["depth"]) for r in rows} == {(2, 1), (3, 1), (4, 2)}


def test_alias_and_local_calls(spark):
    calls = spark.createDataFrame([("Ctl", "User", "create", 2, 23), ("Ctl", None, "help", 0, 30), ("T", "User", "create", 2, 5)], "caller_module string, callee_module string, callee string, arity int, line int")
    aliases = spark.createDataFrame([("Ctl", "User", "MyApp.User")], "module string, alias string, target string")
    fns = spark.createDataFrame([("MyApp.User", "create", 2), ("Ctl", "help", 0)], "module string, name string, arity int")
    sites = {(r["caller_module"], r["target"], r["callee"]) for r in graph.call_sites(calls, fns, aliases).collect()}
    assert sites == {("Ctl", "MyApp.User", "create"), ("Ctl", "Ctl", "help")}


def test_pairs(spark):
    files = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "z")], "sha int, file string")
    rows = {(r["a"], r["b"]): r["cnt"] for r in pairs.together(files, "sha", "file").collect()}
    assert rows == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert pairs.together(files, "sha", "file", most=2).count() == 1
    both = {(r["kw1"], r["kw2"]) for r in pairs.symmetric(pairs.together(files, "sha", "file")).collect()}
    assert all((b, a) in both for a, b in both)
    assert [pairs.adaptive_limit(n) for n in (100, 1000, 2900, 5000, 20000)] == [100, 1000, 1500, 2000, 1500]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "path int, md5 string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "path int, md5 string")
    assert {tuple(r) for r in merge.diff(old, new).collect()} == {(1, "deleted"), (2, "unchanged"), (3, "modified"), (4, "new")}
    once = merge.upsert(old, new, ["path"], gone=old.where("path = 1"))
    assert {tuple(r) for r in once.collect()} == {(2, "b"), (3, "x"), (4, "d")}
    assert {tuple(r) for r in merge.upsert(once, new, ["path"]).collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in merge.merge([old, new], ["path"], last_wins=False).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_remap_takes_the_first_line(spark):
    old = spark.createDataFrame([("f", 30, "  x = 1 ")], "file string, line int, text string")
    new = spark.createDataFrame([("f", 9, "x = 1"), ("f", 12, "x = 1"), ("f", 31, "x = 1")], "file string, line int, text string")
    comments = spark.createDataFrame([("c", "f", 30)], "id string, file string, line int")
    assert history.remap(comments, old, new).first()["now"] == 12


def test_blocks(spark):
    rows = spark.createDataFrame([("f", 1), ("f", 2), ("f", 4)], "file string, line int")
    assert [r["island"] for r in asof.adjacent(rows, ["file"], "line").orderBy("line").collect()] == [1, 1, 2]


def test_dates(spark):
    now = datetime(2024, 1, 31)
    assert D.changed_since("2w", now) == datetime(2024, 1, 17)
    assert D.changed_since("2024-01-05T02:00:00+02:00", now) == datetime(2024, 1, 5)
    assert one(spark, D.week_key(F.lit("2024-01-01").cast("timestamp"))) == "2024-W01"
    assert one(spark, D.in_window(F.lit("no date"), "2024-01-01", None)) is True
    assert one(spark, D.relative(F.lit("2024-01-30").cast("timestamp"), now)) == "yesterday"


def test_debounce(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:03"]
    rows = spark.createDataFrame([(x,) for x in at], "t string").select(F.to_timestamp("t").alias("ts"))
    assert [r["changes"] for r in U.debounce(rows, 2).orderBy("first_ts").collect()] == [2, 1]


def test_staged_fallback(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "fid int")
    rows = search.staged([("a", df().where("false") if False else spark.createDataFrame([], "fid int")), ("b", df(1, 2)), ("c", df(3))]).collect()
    assert {(r["fid"], r["note"]) for r in rows} == {(1, "b"), (2, "b")}


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_global_positions(spark, ranges):
    """Range by range as in one sort: ties, nulls, equal leads, one row and none."""
    from kestrelgrid.operators import ranks

    values = [5.0, None, 1.0, 5.0, -2.5, 5.0, None, 7.0, 1.0] * 4
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double").repartition(3)
    got = {r["id"]: r["k"] for r in ranks.numbered(rows, F.col("v"), [F.col("v"), F.col("id").desc()], "k", ranges).collect()}
    order = sorted(range(len(values)), key=lambda k: (values[k] is not None, values[k] or 0.0, -k))
    assert got == {k: n + 1 for n, k in enumerate(order)}
    sums = {r["id"]: r["s"] for r in ranks.before(rows, F.col("v"), [F.col("v"), F.col("id").desc()], F.col("id"), "s", ranges).collect()}
    assert sums == {k: sum(order[:n]) for n, k in enumerate(order)}
    assert ranks.numbered(rows.where("false"), F.col("v"), [F.col("v")], "k", ranges).count() == 0
    assert ranks.numbered(rows.where("id = 1"), F.col("v"), [F.col("v")], "k", ranges).first()["k"] == 1


def test_fallbacks_in_one_pass(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "n int")
    for few in (False, True):
        got = search.first_of(rows, [("none", F.col("n") > 9), ("high", F.col("n") > 3), ("all", F.lit(True))], few=few).orderBy("n").collect()
        assert [(r["n"], r["stage"], r["note"]) for r in got] == [(4, 1, "high"), (5, 1, "high")]
        assert search.first_of(rows, [("none", F.col("n") > 9)], few=few).count() == 0


def test_reachable_deep_and_cyclic(spark):
    """A path of 1,000 levels, cycles within cycles, and random graphs."""
    import random

    from kestrelgrid.operators import graph

    r = random.Random(1)
    deep = [(k, k + 1) for k in range(1000)]
    cycles = [(2000 + k, 2000 + (k + 1) % 90) for k in range(90)] + [(2010, 2040), (2040, 3000), (3000, 3001), (3001, 3000), (4000, 4000), (4001, 2005)]
    graphs = [deep, cycles, *[[(r.randrange(n), r.randrange(n)) for _ in range(n + n // 3)] for n in (6, 40, 90)]]
    for edges in graphs:
        behind = {}
        for a, b in edges:
            behind.setdefault(a, set()).add(b)
        nodes = {x for e in edges for x in e}

        def reached(root):
            seen, wait = set(), [root]
            while wait:
                for b in behind.get(wait.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        wait.append(b)
            return seen

        want = {x: reached(x) for x in nodes}
        e = spark.createDataFrame(edges, "src long, dst long")
        got = {}
        for root, node in graph.reachable(e, spark.createDataFrame([(x,) for x in sorted(nodes)], "root long")).collect():
            got.setdefault(root, set()).add(node)
        assert got == {x: w - {x} for x, w in want.items() if w - {x}}
        _, members = graph.condense(e)
        assert {m["node"]: m["component"] for m in members.collect()} == {x: min([x, *[y for y in want[x] if x in want[y]]]) for x in nodes}
