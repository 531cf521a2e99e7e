"""Incremental maintenance and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from . import adapters as A
from .registry import query


@query("J19 S4", """
select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'deleted' when o.md5 <> n.md5 then 'modified' else 'unchanged' end as status from old_state o full join new_state n on o.path = n.path""", "old_state new_state")
def hash_diff(t):
    return M.diff(A.file_state(t, True), A.file_state(t, False))


@query("U2", "select path, coalesce(n.md5, o.md5) as md5 from old_state o full join new_state n using (path)", "old_state new_state")
def merge_last_wins(t):
    return M.merge([A.file_state(t, True), A.file_state(t, False)], ["path"])


@query("U2", "select path, coalesce(o.md5, n.md5) as md5 from old_state o full join new_state n using (path)", "old_state new_state")
def merge_first_wins(t):
    return M.merge([A.file_state(t, True), A.file_state(t, False)], ["path"], last_wins=False)


@query("U3 K22", "select path, md5 from new_state", "old_state new_state")
def merge_incremental(t):
    """The old state with what a diff says has come, changed or gone is the new one."""
    old, new = A.file_state(t, True), A.file_state(t, False)
    status = M.diff(old, new)
    fresh = new.join(status.where("status in ('new', 'modified')").select("path"), "path", "left_semi")
    return M.upsert(old, fresh, ["path"], gone=status.where("status = 'deleted'"))


@query("J24", "select n.path, n.md5, coalesce(case when n.path like 'p%' then 'fresh' end, case when o.md5 = n.md5 then 'kept' end) as note from new_state n left join old_state o on o.path = n.path", "old_state new_state")
def reuse_unchanged(t):
    old = A.file_state(t, True).select("path", F.col("md5").alias("was"), F.lit("kept").alias("note"))
    fresh = A.file_state(t, False).withColumn("note", F.when(F.startswith("path", F.lit("p")), "fresh"))
    fresh = fresh.join(old.select("path", "was"), "path", "left")
    return M.reuse(fresh, old, ["path"], ["note"], F.col("was") == F.col("md5")).select("path", "md5", "note")


@query("U4 K21", "select number, case when state = 'O' then title else 'old ' || title end as title from prs", "prs")
def pr_merge(t):
    """Pull requests that are still open are fetched again, over an index of all."""
    p = A.prs(t)
    old = p.select("number", F.concat(F.lit("old "), F.col("title")).alias("title"))
    return M.upsert(old, p.where("state = 'O'").select("number", "title"), ["number"])


@query("U5", "select path from old_state except select path from new_state", "old_state new_state")
def path_except(t):
    return A.file_state(t, True).select("path").exceptAll(A.file_state(t, False).select("path"))


@query("U5", "select path from old_state intersect select path from new_state", "old_state new_state")
def path_intersect(t):
    return A.file_state(t, True).select("path").intersect(A.file_state(t, False).select("path"))


@query("U6", "select number from prs where number > 12000 or number < 300", "prs")
def pr_delta(t):
    p = A.prs(t).select("number")
    ends = t.spark.createDataFrame([(12_000,), (300,)], "number bigint")
    return M.outside(p, ends)


@query("U7", "select module, name, arity, min(fid) as fid from functions group by all", "functions")
def dedupe_rows(t):
    return A.functions(t).groupBy("module", "name", "arity").agg(F.min("fid").alias("fid"))


@query("S3", """
select 'arity' as rule, p_partkey as id from part where p_size < 3 union all select 'price', p_partkey from part where p_retailprice <= 910 union all select 'name', p_partkey from part where p_name not like '% %'""")
def schema_check(t):
    from ..sources.index import violations

    rules = {"arity": F.col("p_size") >= 3, "price": F.col("p_retailprice") > 910, "name": F.col("p_name").contains(" ")}
    return violations(t.part, "p_partkey", rules)


@query("S5", "select doc_id, md5(text) as md5 from documents")
def md5_state(t):
    return t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("R16", "select page_id, substr(sha256(url), 1, 16) as repo from pages")
def repo_id(t):
    return t.pages.select("page_id", F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16).alias("repo"))


@query("R15", """
with c as (select page_id, path, string_split(path, '/') as s from paths),
k as (select page_id, array_to_string(s[-n:], '/') as c, n from c, (values (1), (2), (1000)) x(n))
select c.page_id, f.found from c left join (select page_id, min_by(k.c, k.n) as found from k where k.c in (select path from paths) group by page_id) f on f.page_id = c.page_id""", "paths")
def snippet_path(t):
    """The first candidate that is a file: the last part of a path, its last two, all of it."""
    p = A.paths(t).select("page_id", "path")
    parts = F.split("path", "/")
    tail = lambda n: F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), F.lit(n)), "/")
    asked = p.select("page_id", F.posexplode(F.array(tail(1), tail(2), F.col("path"))).alias("nth", "path"))
    found = asked.join(p.select("path").distinct(), "path", "left_semi").groupBy("page_id").agg(F.min_by("path", "nth").alias("found"))
    return p.select("page_id").join(found, "page_id", "left")


@query("A33", "select max(ts) as newest, max(ts) > timestamp '2024-01-15' as stale from events")
def staleness(t):
    return t.events.agg(F.max("ts").alias("newest"), (F.max("ts") > F.lit("2024-01-15").cast("timestamp_ntz")).alias("stale"))


@query("R5 U4", "select number from prs where state = 'O' and number <= (select max(number) from prs where state = 'F')", "prs")
def partial_fetch(t):
    """Of a fetch that broke off, the rows that may be saved."""
    prs = A.prs(t)
    return M.may_save(prs.where("state = 'O'"), prs.where("state = 'F'"), complete=False).select("number")
