"""The query tools themselves, over the driver's tables as one code index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..api import CodeIndex
from ..functions import text as T
from . import adapters as A
from .registry import query

NOW = datetime(2024, 3, 1)

# Definitions (clauses of one name put together), search documents and keywords of names and types.
_DEFS = """pf as (select module, name, arity, min(f.line) as line, min(ftype) as ftype, max(timestamp '2024-01-01' + to_days((fid % 60)::integer)) as last_modified_at, min(p_type) as kind from functions f join part on p_partkey = fid group by all),
files as (select distinct module, 'lib/' || lower(replace(module, '#', '_')) || '.ex' as file from pf),
d as (select 'function' as type, module || '.' || name || '/' || arity as entity, pf.module, name, arity, file, line, ftype, last_modified_at, kind from pf join files using (module))"""


def code_index(t) -> CodeIndex:
    """part as definitions, lineitem as calls, orders as commits and pull requests."""
    when = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((F.col("fid") % 60).cast("int"))
    functions = A.functions(t).join(t.part.select(F.col("p_partkey").alias("fid"), "p_type"), "fid")
    functions = functions.groupBy("module", "name", "arity").agg(F.min("line").alias("line"), F.min("ftype").alias("ftype"), F.max(when).cast("timestamp").alias("last_modified_at"), F.min("p_type").alias("kind"))
    modules = functions.select("module").distinct().withColumns({"file": F.concat(F.lit("lib/"), F.lower(F.replace("module", F.lit("#"), F.lit("_"))), F.lit(".ex")), "line": F.lit(1)})
    entity = T.canonical(F.col("module"), F.col("name"), F.col("arity"))
    words = functions.select(entity.alias("entity"), "module", F.posexplode(F.split("name", "_")).alias("at", "kw")).select("entity", "module", "kw", F.lit("docs").alias("source"), (F.col("at") + 1.0).alias("weight"))
    kinds = functions.select(entity.alias("entity"), "module", F.lower("kind").alias("kw"), F.lit("strings").alias("source"), F.lit(T.STRING_BOOST).alias("weight"))
    calls = A.calls(t).withColumn("caller_file", F.when(F.col("line") % 4 == 0, "test/x_test.exs").otherwise("lib/x.ex"))
    return CodeIndex({"modules": modules, "functions": functions.drop("kind"), "calls": calls, "aliases": A.aliases(t), "entity_keywords": words.unionByName(kinds), "commits": A.commits(t), "commit_files": A.commit_files(t), "prs": A.prs(t), "pr_commits": A.pr_commits(t)})


@query("K13 K2 K7 K8 F7 F8 W11 K12 A29 B8", f"""
with {_DEFS},
kw as (select entity, unnest(string_split(name, '_')) as kw, generate_subscripts(string_split(name, '_'), 1)::double as weight from d union all select entity, lower(kind), 1.3 from d),
w as (select entity, kw, max(weight) as weight from kw group by all),
z as (select kw, 1.0::double / dense_rank() over (order by df) as zipf from (select kw, count(*) as df from w group by kw)),
terms as (select * from (values ('small', 0), ('ring', 1), ('bolt', 1)) x(kw, grp)),
k as (select entity, round(sum(weight * zipf) * (0.8 + 0.8 * count(distinct grp) / 2.0::double), 4) as score from w join z using (kw) join terms using (kw) group by entity),
kh as (select d.*, score from d join k using (entity) order by score desc, name, entity limit 100),
ph as (select d.*, 1.0::double as score from d where starts_with(lower(module), 'brand#1') and starts_with(lower(name), 'red_') order by name, entity limit 100),
h as (select * from kh union all select * from ph),
s as (select *, 0 as stage from h where last_modified_at >= timestamp '2024-02-16' and ftype = 'def' union all select *, 1 from h where last_modified_at >= timestamp '2024-02-16' union all select *, 2 from h where ftype = 'def'),
b as (select * from (select *, row_number() over (partition by entity order by score desc, name) as n from s where stage = (select min(stage) from s)) where n = 1),
g as (select *, (score - avg(score) over ()) / nullif(stddev_samp(score) over (), 0) as z from b)
select entity, score, ['as asked', 'all scopes', 'older code'][stage + 1] as note, case when z > 2 then 'exceptional' when z > 1 then 'strong' when z >= 0 then 'above_average' when z > -1 then 'below_average' else 'weak' end as tier from g order by score desc, name, entity limit 20""", "functions")
def query_tool(t):
    """Keywords with a synonym group and a pattern, public and recent, best hit of each name, graded."""
    return code_index(t).query(["small", ["ring", "bolt"], "Brand#1*.red_*"], scope="public", recent=True, now=NOW, limit=20).select("entity", "score", "note", "tier")


@query("K14 B1 B2 B3 B4 B5 B6 B11 F4 F16 A21 J3", f"""
with {_DEFS},
s as (select target as module, callee as name, r.arity, caller_module, min(r.line) as line from resolved r join pf on pf.module = r.target and pf.name = r.callee and pf.arity = r.arity where r.line % 4 <> 0 group by all),
c as (select module, name, arity, string_agg(caller_module || ':' || line, ',' order by caller_module) as callers from s group by all)
select d.module, d.name, d.arity, d.line, 'any arity' as note, callers from d left join c on c.module = d.module and c.name = d.name and c.arity = d.arity where d.name = 'small_ring' order by d.module, d.arity limit 40""", "functions calls resolved")
def search_function_tool(t):
    """No such arity in that module, nor anywhere: the third stage finds the name; callers outside tests."""
    found = code_index(t).search_function("Brand#3.nothing_there/9|Brand#3.small_ring/9", usage_type="source", limit=40)
    callers = F.array_join(F.transform("callers", lambda c: F.concat(c["caller_module"], F.lit(":"), c["line"].cast("string"))), ",")
    return found.select("module", "name", "arity", "line", "note", callers.alias("callers"))


@query("K15 B7 F2", f"""
with {_DEFS} select pf.module, 'last segment' as note, count(*) as functions, count(*) filter (ftype = 'def') as public from pf where starts_with(pf.module, 'Brand#2') group by pf.module order by pf.module limit 20""", "functions")
def search_module_tool(t):
    return code_index(t).search_module("Elsewhere.Brand#2*").select("module", "note", "functions", "public")


@query("K16 J10 F14 F22 F8", """
with m as (select sha, ts from (select * from (select * from commits where contains(lower(author), 'dev7')) order by ts desc, sha limit 500) where contains(lower(message), 'urgent') order by ts desc, sha limit 500),
o as (select * from m where not ts >= timestamp '2001-01-15' order by ts desc, sha limit 50),
p as (select sha, max(number) as number from pr_commits group by sha)
select o.sha, p.number, prs.title from o left join p on p.sha = o.sha left join prs on prs.number = p.number""", "commits prs pr_commits")
def git_history_tool(t):
    """Older commits of an author about a word, with their pull requests."""
    return code_index(t).git_history(author="dev7", text="urgent", recent=False, now=datetime(2001, 1, 29), limit=50).select("sha", "number", "title")
