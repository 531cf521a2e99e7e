"""Wildcard, glob and option filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import patterns as P
from . import adapters as A
from .registry import query

NOW = datetime(2024, 1, 31)


def _names(t, predicate):
    return A.functions(t).where(predicate).select("fid", "name")


@query("F1", "select fid, name from functions where lower(name) like 'h%g%r'", "functions")
def pat_wildcard(t):
    return _names(t, P.wildcard(F.col("name"), "H*g*r"))


@query("F1", "select fid, name from functions where regexp_full_match(name, '[hr].*[a-m].*')", "functions")
def pat_wildcard_class(t):
    return _names(t, P.wildcard(F.col("name"), "[hr]*[a-m]*"))


@query("F1", "select fid, name from functions where false", "functions")
def pat_question_mark(t):
    return _names(t, P.wildcard(F.col("name"), "h?t*"))


@query("F2", "select page_id, host from (select page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) as host from pages) where host = 'example' or ends_with(host, '.example') or starts_with(host, 'example.') or contains(host, '.example.')")
def pat_qualified(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.select("page_id", F.lower(host).alias("host")).where(P.qualified(F.col("host"), "*.Example"))


@query("F2", "select page_id, host from (select page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) as host from pages) where regexp_full_match(host, '(.*\\.)?example\\..*')")
def qualified_tails(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.select("page_id", F.lower(host).alias("host")).where(P.qualified(F.col("host"), "*.example.*"))


@query("F3", "select fid, name from functions where name like 'hot%' or name = 'red_widget' or name like '%bolt'", "functions")
def pat_or(t):
    return _names(t, P.any_of(F.col("name"), "hot* | red_widget || *bolt"))


@query("F4", """
select fid from functions where (lower(module) = 'brand#3' or ends_with(lower(module), '.brand#3') or starts_with(lower(module), 'brand#3.') or contains(lower(module), '.brand#3.')) and lower(name) like 'hot%' and arity = 2
or lower(file) like 'lib/%economy%' and lower(name) = 'red_widget'""", "functions")
def pat_function(t):
    return A.functions(t).where(P.function_match("Brand#3.hot*/2 | lib/*economy*:red_widget", F.col("module"), F.col("file"), F.col("name"), F.col("arity"))).select("fid")


@query("K8", "select fid, name, 1.0::double as score from functions where lower(name) like '%ring%' or lower(module) = 'brand#5' and lower(name) like 's%'", "functions")
def pattern_search(t):
    fn = A.functions(t)
    hit = P.wildcard(F.col("name"), "*ring*") | (P.qualified(F.col("module"), "Brand#5") & P.wildcard(F.col("name"), "s*"))
    return fn.where(hit).select("fid", "name", F.lit(1.0).alias("score"))


def _globbed(t, pattern):
    return A.paths(t).where(P.glob(F.col("path"), pattern)).select("page_id", "path")


@query("F5", "select page_id, path from paths where regexp_full_match(path, 'en/[^/]*')", "paths")
def glob_single(t):
    return _globbed(t, "en/*")


@query("F5", "select page_id, path from paths where regexp_full_match(path, '(.*/)?[^/]*\\.html')", "paths")
def glob_recursive(t):
    return _globbed(t, "**/*.html")


@query("F5 F6", "select page_id, path from paths where regexp_full_match(path, '(en|fr)/[^/]*\\.html')", "paths")
def glob_brace(t):
    return _globbed(t, "{en,fr}/*.html")


@query("F5", "select page_id, path from paths where not regexp_full_match(path, 'en/.*')", "paths")
def glob_negate(t):
    return _globbed(t, "!en/**")


@query("F7", "select fid, ftype from functions where ftype = 'defp'", "functions")
def filter_scope(t):
    return A.functions(t).where(F.col("ftype").isin("defp", "private")).select("fid", "ftype")


@query("F8", "select event_id, ts from events where ts >= timestamp '2024-01-17'")
def filter_recent(t):
    return t.events.where(D.recent(F.col("ts"), NOW)).select("event_id", "ts")


@query("F9", "select fid, arity from functions where fid % 10 = 0 or arity = 3", "functions")
def filter_arity(t):
    return A.functions(t).where((F.col("fid") % 10 == 0) | (F.col("arity") == 3)).select("fid", "arity")


@query("F12", "select event_id from events where ts >= timestamp '2024-01-10'")
def filter_changed_since(t):
    return t.events.where(D.since(F.col("ts"), "3w", NOW)).select("event_id")


@query("F13", "select o_orderkey from orders where case when o_orderkey % 4 = 0 then true else o_orderdate between timestamp '1996-01-01' and timestamp '1997-06-30' end")
def date_window(t):
    said = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.where(D.in_window(said, "1996-01-01", "1997-06-30")).select("o_orderkey")


@query("F15", "select fid, file from functions where regexp_matches(file, '(^|/)tests?/') or regexp_matches(file, '(^|/)test_[^/]*$') or regexp_matches(file, '_test(\\.[^./]*)?$')", "functions")
def test_file_path(t):
    return A.functions(t).where(P.is_test_path(F.col("file"))).select("fid", "file")


@query("F16", "select case when contains(file, '_test.ex') then 'test' else 'source' end as usage, count(*) as n from functions group by all", "functions")
def test_file_usage(t):
    return A.functions(t).groupBy(F.when(P.is_test_usage(F.col("file")), "test").otherwise("source").alias("usage")).agg(F.count("*").alias("n"))


@query("F17", "select fid from functions where contains(lower(file), 'test')", "functions")
def test_file_display(t):
    return A.functions(t).where(P.is_test_display(F.col("file"))).select("fid")


@query("F18", "select fid from functions where file = 'lib/brand_3/economy.ex' or ends_with(file, '/lib/brand_3/economy.ex') or ends_with('lib/brand_3/economy.ex', '/' || file)", "functions")
def loose_path_match(t):
    return A.functions(t).where(P.same_path(F.col("file"), F.lit("./lib/brand_3/economy.ex"))).select("fid")


@query("F24", "select event_id from events where ts >= timestamp '2024-01-24' and event_type = 'click'")
def log_filter(t):
    return t.events.where(D.recent(F.col("ts"), NOW, 7) & (F.col("event_type") == "click")).select("event_id")


@query("S20", "select event_id, ts from (select * from events where event_type = 'view' order by ts desc, event_id desc limit 100) order by ts")
def log_tail(t):
    return t.events.where("event_type = 'view'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).orderBy("ts").select("event_id", "ts")


@query("F25", "select page_id from paths where len(list_intersect(string_split(path, '/'), ['fr', 'de'])) = 0 and not ends_with(path, '.html')", "paths")
def path_exclude(t):
    return A.paths(t).where(~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("fr"), F.lit("de"))) & ~F.endswith("path", F.lit(".html"))).select("page_id")


@query("F26", "select event_id from events where event_type not in ('error', 'view')")
def builtin_exclude(t):
    return t.events.where(~F.col("event_type").isin("error", "view")).select("event_id")


@query("S21", "select event_id from events where ts >= timestamp '2024-01-20'")
def retention(t):
    return t.events.where(F.col("ts") >= F.lit(datetime(2024, 1, 20))).select("event_id")


@query("F14", "select sha from commits where contains(lower(author), 'dev77')", "commits")
def author_filter(t):
    from ..operators.history import by_author

    return by_author(A.commits(t), "DEV77").select("sha")
