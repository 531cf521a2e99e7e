"""Usage log, JSON access and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import usage as U
from ..operators import vector as V
from . import adapters as A
from .registry import query

_MEASURES = "count(*) as calls, round(coalesce(100.0::double * count(*) filter (success) / nullif(count(*), 0), 0), 6) as success_pct, round(sum(execution_time_ms), 6) as total_ms, round(avg(execution_time_ms), 6) as avg_ms, sum(tokens)::bigint as tokens"


@query("A15 K24", f"select {_MEASURES} from tool_log", "tool_log")
def stats_totals(t):
    return U.totals(A.tool_log(t))


@query("A16", f"select tool_name, {_MEASURES} from tool_log group by tool_name", "tool_log")
def stats_by_tool(t):
    return U.by_tool(A.tool_log(t))


@query("A17", f"select strftime(ts, '%Y-%m-%d') as day, {_MEASURES} from tool_log group by day", "tool_log")
def stats_daily(t):
    return U.daily(A.tool_log(t))


@query("A17", f"select strftime(ts, '%Y-W%W') as week, {_MEASURES} from tool_log group by week", "tool_log")
def stats_weekly(t):
    return U.weekly(A.tool_log(t))


@query("A17", "select day as bucket, string_agg(tool_name || '=' || n, ',' order by tool_name) as tools from (select strftime(ts, '%Y-%m-%d') as day, tool_name, count(*) as n from tool_log group by all) group by day", "tool_log")
def stats_tool_map(t):
    return U.per_tool_map(A.tool_log(t), F.date_format("ts", "yyyy-MM-dd"))


@query("A17 X21", "select o_orderkey, strftime(o_orderdate, '%Y-W%W') as week from orders")
def week_keys(t):
    return t.orders.select("o_orderkey", D.week_key(F.col("o_orderdate")).alias("week"))


@query("A18", "select min(ts) as first_ts, max(ts) as last_ts, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 + 1)::bigint as days from events")
def stats_range(t):
    return U.span(t.events)


@query("T2", """
with m as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 1800000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
b as (select *, sum(fresh) over (partition by user_id order by ts) as burst from m)
select user_id, burst::bigint as burst, min(ts) as first_ts, max(ts) as last_ts, count(*) as changes from b group by user_id, burst""")
def debounce_sessions(t):
    return U.debounce(t.events, 1800, ["user_id"])


@query("N1 N6", "select json_extract_string(props, '$.k')::bigint as k, count(*) as n from events group by k")
def json_path(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("N2", "select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key")
def json_keys(t):
    return t.events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("N3", "select event_id, props from events order by event_id limit 5")
def json_sample(t):
    return t.events.orderBy("event_id").limit(5).select("event_id", "props")


@query("N6", "select event_id from events where regexp_matches(json_extract_string(props, '$.k'), '^9')")
def json_select(t):
    return t.events.where(F.get_json_object("props", "$.k").rlike("^9")).select("event_id")


@query("N5 X25", "select doc_id, case when coalesce(length(text), 0) = 0 then 0 else len(string_split(text, chr(10))) end::bigint as lines, octet_length(encode(text)) > 20000 as large from documents")
def line_count(t):
    from ..functions.text import line_count as count

    return t.documents.select("doc_id", count(F.col("text")).alias("lines"), (F.octet_length("text") > 20_000).alias("large"))


_COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))"
_VEC = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), q as (select v as qv from v where vec_id = 3), s as (select vec_id, label, list_cosine_similarity(v, qv) as cos, round(list_cosine_similarity(v, qv), 6) as similarity from v, q)"


def _query_vector(t):
    return [float(x) for x in t.embeddings.where("vec_id = 3").first()["embedding"]]


@query("K9", f"with {_VEC} select vec_id, similarity from s order by cos desc, vec_id limit 10")
def vector_topk(t):
    return V.top_k(t.embeddings, _query_vector(t), 10).select("vec_id", "similarity")


@query("K10", f"with {_VEC}, f as (select * from s order by cos desc, vec_id limit 20) select vec_id, similarity from f where label < 5 order by cos desc, vec_id limit 10")
def vector_topk_filtered(t):
    return V.top_k(t.embeddings, _query_vector(t), 10, keep=F.col("label") < 5).select("vec_id", "similarity")


@query("S22 P6", "select vec_id, 'function:' || vec_id as doc_id, label, len(embedding)::bigint as dims from embeddings")
def embedding_metadata(t):
    return t.embeddings.select("vec_id", F.concat(F.lit("function:"), F.col("vec_id").cast("string")).alias("doc_id"), "label", F.size("embedding").cast("bigint").alias("dims"))
