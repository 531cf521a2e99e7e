"""Calls, usages, dependencies, dead code, and the line joins under them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof as J
from ..operators import graph as G
from ..operators import passes
from . import adapters as A
from .registry import query

_SITES = "sites as (select r.* from resolved r where exists (select 1 from functions f where f.module = r.target and f.name = r.callee and f.arity = r.arity))"


def _resolved(t):
    return G.resolve(A.calls(t), A.aliases(t))


def _sites(t):
    return G.call_sites(A.calls(t), A.functions(t), A.aliases(t))


@query("J3 J23", f"with {_SITES} select target, callee, arity, count(*) as calls, sum(line)::bigint as lines from sites group by all", "functions calls resolved")
def call_sites(t):
    return _sites(t).groupBy("target", "callee", "arity").agg(F.count("*").alias("calls"), F.sum("line").alias("lines"))


@query("J23", "select caller_module, target, count(*) as n from resolved group by all", "functions calls resolved")
def alias_resolve(t):
    return _resolved(t).groupBy("caller_module", "target").agg(F.count("*").alias("n"))


@query("J4 A31", "select target || '.' || callee as key, count(*) as n, string_agg(caller_module || ':' || line, ',' order by caller_module, line) as sites from resolved group by all", "functions calls resolved")
def reverse_calls(t):
    place = lambda s: F.concat(s["caller_module"], F.lit(":"), s["line"].cast("string"))
    sites = F.flatten(F.transform("sites", lambda s: F.array_repeat(place(s), s["times"].cast("int"))))
    return G.reverse_calls(_resolved(t)).select("key", "n", F.array_join(sites, ",").alias("sites"))


@query("J4 U7", "select caller_module, callee, line from calls where callee in (select name from functions where module = 'Brand#3') group by all", "functions calls")
def callers_loose(t):
    return G.loose_callers(A.calls(t), A.functions(t).where("module = 'Brand#3'")).select("caller_module", "callee", "line")


@query("A19", "select caller_module, callee, arity, string_agg(distinct lpad(line::varchar, 4, '0'), ',' order by lpad(line::varchar, 4, '0')) as lines from calls where callee = 'hot_gear' group by all", "functions calls")
def callers_grouped(t):
    rows = A.calls(t).where("callee = 'hot_gear'")
    return rows.groupBy("caller_module", "callee", "arity").agg(F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("line").cast("string"), 4, "0"))), ",").alias("lines"))


@query("A21", "select callee, caller_module, min(line) as line from calls group by all", "functions calls")
def consolidate_by_module(t):
    return G.consolidate(A.calls(t).select("callee", "caller_module", "line"), ["callee"], "caller_module", ["line"])


_REFS = "refs as (select caller_module as module, case line % 5 when 0 then 'alias' when 1 then 'import' when 2 then 'require' when 3 then 'use' else 'value_mention' end as kind, target from resolved)"


def _refs(t):
    kind = F.when(F.col("line") % 5 == 0, "alias").when(F.col("line") % 5 == 1, "import").when(F.col("line") % 5 == 2, "require").when(F.col("line") % 5 == 3, "use").otherwise("value_mention")
    return _resolved(t).select(F.col("caller_module").alias("module"), kind.alias("kind"), "target")


@query("J9", f"with {_REFS} select distinct kind, module from refs where target = 'Brand#7' and module <> 'Brand#7'", "functions calls resolved")
def usage_by_kind(t):
    return G.usages(_refs(t), F.lit("Brand#7"))


@query("J17", f"with {_SITES} select fid from functions f where not exists (select 1 from sites s where s.target = f.module and s.callee = f.name and s.arity = f.arity)", "functions calls resolved")
def dead_code(t):
    fn = A.functions(t)
    sites = _sites(t).where("line is not null").select(F.col("target").alias("module"), F.col("callee").alias("name"), "arity")
    return G.unused(fn, sites, ["module", "name", "arity"]).select("fid")


_DEAD = """defs as (select o_orderkey as fid, 'M' || o_custkey as module, 'f' || o_orderkey as name, (o_orderkey % 5)::bigint as arity, o_orderstatus <> 'P' as is_public, o_orderpriority = '1-URGENT' as is_impl, o_orderpriority = '5-LOW' as dynamic,
'lib/m' || o_custkey || case when o_orderpriority = '2-HIGH' then '_test.exs' else '.ex' end as file from orders),
live as (select distinct 'f' || (event_id * 3 // 2) as name, (event_id * 3 // 2) % 5 + (event_type = 'error')::int as arity from events),
mention as (select distinct 'M' || user_id as module from events where event_type = 'signup'),
wanted as (select * from defs where is_public and not is_impl and not (regexp_matches(file, '_test(\\.[^./]*)?$')) and name not in ('__init__', 'main')),
lonely as (select * from wanted w where not exists (select 1 from live l where l.name = w.name and l.arity = w.arity)),
graded as (select fid, name, case when dynamic then 'low' when module in (select module from mention) then 'medium' else 'high' end as confidence from lonely)"""


def _dead(t):
    """Orders as definitions, events as calls (errors with a wrong arity) and sign-ups as mentions of a customer's module."""
    from ..functions import patterns as P

    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    stem = F.concat(F.lit("lib/m"), F.col("o_custkey").cast("string"), F.when(priority == "2-HIGH", "_test.exs").otherwise(".ex"))
    fn = t.orders.select(key.alias("fid"), F.concat(F.lit("M"), F.col("o_custkey").cast("string")).alias("module"), name(key).alias("name"), (key % 5).alias("arity"), (F.col("o_orderstatus") != "P").alias("is_public"), P.is_test_path(stem).alias("is_test"), (priority == "1-URGENT").alias("is_impl"), (priority == "5-LOW").alias("dynamic"))
    called = F.expr("event_id * 3 div 2")
    live = t.events.select(name(called).alias("name"), (called % 5 + (F.col("event_type") == "error").cast("int")).alias("arity"))
    mentions = t.events.where("event_type = 'signup'").select(F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("module"))
    return G.dead_code(fn, live, mentions, ["name", "arity"])


@query("K18 J18", f"with {_DEAD} select fid, confidence from graded")
def dead_code_confidence(t):
    return _dead(t).select("fid", "confidence")


@query("F21", f"with {_DEAD} select fid from graded where confidence in ('high', 'medium')")
def dead_code_filter(t):
    return _dead(t).where(G.at_least(F.col("confidence"), "medium")).select("fid")


@query("A14", f"with {_DEAD} select count(*) as total, count(*) filter (confidence = 'high') as high, count(*) filter (confidence = 'medium') as medium, count(*) filter (confidence = 'low') as low from graded")
def dead_code_summary(t):
    c = F.col("confidence")
    return _dead(t).agg(F.count("*").alias("total"), *[F.count_if(c == x).alias(x) for x in ("high", "medium", "low")])


@query("J18", f"with {_REFS} select distinct module from functions where module in (select target from refs where kind = 'value_mention')", "functions calls resolved")
def value_mentions_semi(t):
    mentioned = _refs(t).where("kind = 'value_mention'").select(F.col("target").alias("module")).distinct()
    return A.functions(t).select("module").distinct().join(mentioned, "module", "left_semi")


_EDGES = "edges as (select distinct c_custkey % n as src, (c_custkey // n * 31 + c_nationkey) % n as dst from customer, (select count(*) as n from supplier))"


def _edges(t):
    """Customers as imports among as many modules as there are suppliers."""
    rows = t.customer.crossJoin(F.broadcast(t.supplier.agg(F.count("*").alias("n"))))
    return rows.select((F.col("c_custkey") % F.col("n")).alias("src"), F.expr("(c_custkey div n * 31 + c_nationkey) % n").alias("dst")).distinct()


@query("G1 R7", f"""
with recursive {_EDGES}, walk as (select s_suppkey as root, s_suppkey as node, 0 as depth from supplier union select root, dst, depth + 1 from walk join edges on src = node where depth < 3)
select root, node, min(depth)::int as depth from walk where node <> root group by all having min(depth) > 0""")
def deps_transitive(t):
    return G.closure(_edges(t), t.supplier.select(F.col("s_suppkey").alias("root")), 3).select("root", "node", "depth")


@query("G1 R7", f"""
with recursive {_EDGES}, walk as (select s_suppkey as root, s_suppkey as node from supplier union select root, dst from walk join edges on src = node)
select root, node from walk where node <> root""")
def deps_reachable(t):
    """What each module depends on at any depth, by condensation."""
    return G.reachable(_edges(t), t.supplier.select(F.col("s_suppkey").alias("root")))


@query("A22", "select caller_module as module, target as dep, string_agg(distinct callee || '/' || arity, ',' order by callee || '/' || arity) as functions from resolved where target <> caller_module group by all", "functions calls resolved")
def deps_granular(t):
    return G.granular(_resolved(t))


@query("G3", "select caller_module as module, count(*) filter (target = caller_module) as internal, count(*) filter (target <> caller_module) as external from resolved group by all", "functions calls resolved")
def deps_internal_external(t):
    return G.internal_external(_resolved(t))


@query("A23", f"with {_REFS} select module, string_agg(distinct target, ',' order by target) as deps from refs where target <> module group by all", "functions calls resolved")
def module_dep_set(t):
    return _refs(t).where("target <> module").groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("deps"))


@query("G2", "select callee, count(*) as n from calls where caller_module = 'Brand#2' group by all", "functions calls")
def callees(t):
    return A.calls(t).where("caller_module = 'Brand#2'").groupBy("callee").agg(F.count("*").alias("n"))


@query("G2", "select caller_module, count(*) as n from calls where contains(callee, 'gear') group by all", "functions calls")
def callers_substring(t):
    return A.calls(t).where(F.contains("callee", F.lit("gear"))).groupBy("caller_module").agg(F.count("*").alias("n"))


@query("A20", "select module, name, arity, count(*) as clauses, min(line) as first_line from functions group by all", "functions")
def clause_groups(t):
    return A.functions(t).groupBy("module", "name", "arity").agg(F.count("*").alias("clauses"), F.min("line").alias("first_line"))


@query("A30 J25", "select l_orderkey as symbol, count(*) as arity from lineitem group by all")
def param_arity(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("symbol")).agg(F.count("*").alias("arity"))


@query("J25", "select caller_module, callee, max(f.line) as def_line from calls c join (select name, min(line) as line from functions group by name) f on f.name = c.callee where caller_module in ('Brand#1', 'Brand#2') group by all", "functions calls")
def symbol_lookup(t):
    info = A.functions(t).groupBy("name").agg(F.min("line").alias("def_line"))
    rows = A.calls(t).where(F.col("caller_module").isin("Brand#1", "Brand#2"))
    return rows.join(info, rows["callee"] == info["name"]).groupBy("caller_module", "callee").agg(F.max("def_line").alias("def_line"))


_DEFS = "defs as (select o_custkey as user_id, o_orderdate as ts, min(o_orderkey) as symbol from orders group by all)"


@query("J5", f"""
with {_DEFS}, e as (select user_id, event_id, ts - interval 9000 day as ts from events)
select e.event_id, d.symbol from e asof left join defs d on e.user_id = d.user_id and e.ts >= d.ts""")
def enclosing_function_asof(t):
    e = t.events.select("user_id", "event_id", (F.col("ts") - F.expr("interval 9000 days")).alias("ts"))
    d = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("symbol"))
    return J.asof(e, d, ["user_id"], "ts", ["symbol"]).select("event_id", "symbol")


@query("J8 J20", f"""
with {_DEFS}, e as (select user_id, event_id, ts - interval 9000 day as ts from events)
select e.event_id, d.symbol from e asof left join defs d on e.user_id = d.user_id and e.ts <= d.ts""")
def next_function_forward_asof(t):
    e = t.events.select("user_id", "event_id", (F.col("ts") - F.expr("interval 9000 days")).alias("ts"))
    d = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("symbol"))
    return J.asof(e, d, ["user_id"], "ts", ["symbol"], forward=True).select("event_id", "symbol")


_RANGES = "ranges as (select module, line as start, line + 10 + fid % 400 as stop, fid as symbol from functions)"


@query("J6", f"""
with {_RANGES}, p as (select distinct caller_module as module, line as at_line from calls)
select module, at_line, symbol from (select p.*, symbol, row_number() over (partition by p.module, at_line order by stop - start, start, symbol) as k from p join ranges r on r.module = p.module and at_line between start and stop) where k = 1""", "functions calls")
def range_enclosing_smallest(t):
    points = A.calls(t).select(F.col("caller_module").alias("module"), F.col("line").alias("at_line")).distinct()
    ranges = A.functions(t).select("module", F.col("line").alias("start"), (F.col("line") + 10 + F.col("fid") % 400).alias("stop"), F.col("fid").alias("symbol"))
    return J.enclosing(points, ranges, ["module"], "at_line").select("module", "at_line", "symbol")


@query("W8", "select fid, line, coalesce(lead(line) over (partition by module order by line, fid) - 1, line + 100) as end_line from functions", "functions")
def function_end_line(t):
    return J.ends(A.functions(t), ["module"], "line", 100, "fid").select("fid", "line", "end_line")


@query("J7", """
with b as (select module, line as start, fid, coalesce(lead(line) over (partition by module order by line, fid) - 1, line + 10000) as stop from functions)
select fid, count(*) as calls from b join calls c on c.caller_module = b.module and c.line between start and stop group by fid""", "functions calls")
def function_deps_interval(t):
    """Calls by the function whose lines they lie in: the last one that begins at or before the call, up to its end."""
    bounds = J.ends(A.functions(t), ["module"], "line", 10_000, "fid").select(F.col("module").alias("caller_module"), "line", "end_line", "fid", (-F.col("fid")).alias("last"))
    hit = J.asof(A.calls(t).select("caller_module", "line"), bounds, ["caller_module"], "line", ["last", "end_line", "fid"])
    return hit.where("line <= end_line").groupBy("fid").agg(F.count("*").alias("calls"))


@query("W9", """
with r as (select module, name, fid, line from functions)
select a.fid, min(b.line) - 1 as end_line from r a join r b on a.module = b.module and b.line > a.line and not starts_with(b.name, a.name) group by a.fid""", "functions")
def sibling_end(t):
    """Up to the next definition that isn't nested by name, in one sorted pass."""
    return passes.sibling_ends(A.functions(t), ["module"], "name", "line", ["fid"]).select("fid", "end_line")


@query("W6 S16", """
with m as (select *, case when event_type is not distinct from lag(event_type) over w then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as island from m)
select user_id, island::bigint as island, any_value(event_type) as author, count(*) as lines, min(event_id) as first_line from i group by user_id, island""")
def blame_groups(t):
    rows = J.islands(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])
    return rows.groupBy("user_id", "island").agg(F.first("event_type").alias("author"), F.count("*").alias("lines"), F.min("event_id").alias("first_line"))


@query("W7", """
with c as (select file, line, text from source_lines where contains(text, ',')),
g as (select *, line - row_number() over (partition by file order by line) as island from c)
select file, min(line) as start_line, max(line) as end_line, md5(string_agg(text, chr(10) order by line)) as body from g group by file, island""", "source_lines")
def comment_blocks(t):
    rows = J.adjacent(A.source_lines(t).where(F.contains("text", F.lit(","))), ["file"], "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("file", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.md5(text.cast("binary")).alias("body")).drop("island")


@query("W12 R12", "select file, line, md5(string_agg(text, chr(10)) over (partition by file order by line rows between 2 preceding and 2 following)) as context from source_lines", "source_lines")
def code_context(t):
    rows = J.context(A.source_lines(t), ["file"], "line", "text", 2, 2)
    return rows.select("file", "line", F.md5(F.array_join("context", "\n").cast("binary")).alias("context"))


@query("J22", """
select fid from (select fid, row_number() over (partition by file, line order by case when arity = 0 then 0 else 1 end, fid) as k from functions) where k = 1""", "functions")
def location_lookup(t):
    w = Window.partitionBy("file", "line").orderBy(F.when(F.col("arity") == 0, 0).otherwise(1), "fid")
    return A.functions(t).withColumn("k", F.row_number().over(w)).where("k = 1").select("fid")


@query("J15", "select file, min(module) as module from functions group by file", "functions")
def file_to_module(t):
    return A.functions(t).groupBy("file").agg(F.min("module").alias("module"))


@query("R8", """
with b as (select module, name, arity, min(line) as line from functions group by all)
select d.module, d.name, coalesce(b.line, 1) as start_line, coalesce(b.line + 100, 100) as end_line from (select distinct module, name from functions) d left join b on b.module = d.module and b.name = d.name and b.arity = 2""", "functions")
def bounds_lookup(t):
    fn = A.functions(t)
    b = fn.where("arity = 2").groupBy("module", "name").agg(F.min("line").alias("line"))
    return fn.select("module", "name").distinct().join(b, ["module", "name"], "left").select("module", "name", F.coalesce("line", F.lit(1)).cast("bigint").alias("start_line"), F.coalesce(F.col("line") + 100, F.lit(100)).cast("bigint").alias("end_line"))


@query("K27 K17", "select fid, module, name, arity, line from functions where module = 'Brand#4' and name = 'hot_gear'", "functions")
def lookups(t):
    return A.functions(t).where("module = 'Brand#4' and name = 'hot_gear'").select("fid", "module", "name", "arity", "line")


@query("A13 R10", "select count(distinct module) as modules, count(*) as functions, count(*) filter (ftype = 'def') as public, count(*) filter (ftype = 'defp') as private from functions", "functions")
def index_stats(t):
    return A.functions(t).agg(F.countDistinct("module").alias("modules"), F.count("*").alias("functions"), F.count_if(F.col("ftype") == "def").alias("public"), F.count_if(F.col("ftype") == "defp").alias("private"))


@query("K14 J3 F16 A21", f"""
with {_SITES}, hit as (select s.callee, s.arity, s.caller_module, s.line from sites s where s.target = 'Brand#3' and s.callee like 'hot%')
select callee, arity, caller_module, min(line) as line from hit group by all""", "functions calls resolved")
def search_function(t):
    """Call sites of matched definitions, the first one of each calling module."""
    from ..functions import patterns as P

    sites = _sites(t).where(P.function_match("Brand#3.hot*", F.col("target"), F.lit(""), F.col("callee"), F.col("arity")))
    return G.consolidate(sites.select("callee", "arity", "caller_module", "line"), ["callee", "arity"], "caller_module", ["line"])


@query("K15", "select module, count(*) as functions, count(*) filter (ftype = 'def') as public from functions where lower(module) like 'brand#1%' group by module order by module limit 20", "functions")
def search_module(t):
    from ..functions import patterns as P

    found = A.functions(t).where(P.wildcard(F.col("module"), "brand#1*"))
    return found.groupBy("module").agg(F.count("*").alias("functions"), F.count_if(F.col("ftype") == "def").alias("public")).orderBy("module").limit(20)


@query("P2 P3", "select fid, module || '.' || name || '/' || arity as canonical, module as back_module, name as back_name, arity as back_arity from functions", "functions")
def canonical_name(t):
    full = T.canonical(F.col("module"), F.col("name"), F.col("arity"))
    back = T.parse_canonical(full)
    return A.functions(t).select("fid", full.alias("canonical"), back["module"].alias("back_module"), back["name"].alias("back_name"), back["arity"].alias("back_arity"))
