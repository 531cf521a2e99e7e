"""Views of the driver's tables as code index, history and log, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keywords as K


def functions(t) -> DataFrame:
    """part as definitions: five functions a line block, some private, some in test files."""
    stem = F.concat(F.lit("lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"))
    return t.part.select(
        F.col("p_partkey").alias("fid"),
        F.col("p_brand").alias("module"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
        (F.col("p_size") % 5).cast("bigint").alias("arity"),
        (F.col("p_partkey") % 1000).alias("line"),
        F.when(F.col("p_size") % 4 == 0, "defp").otherwise("def").alias("ftype"),
        F.concat(stem, F.when(F.col("p_size") % 7 == 0, "_test.exs").otherwise(".ex")).alias("file"),
        F.col("p_retailprice").alias("score"),
    )


def calls(t) -> DataFrame:
    """lineitem as calls: every fifth is local (no module), some of a wrong arity, aliases named ``A<n>``."""
    own = functions(t).select("fid", F.col("name").alias("callee"), F.col("arity"), F.col("module").alias("home"))
    rows = t.lineitem.select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("caller_module"), "l_partkey", "l_orderkey", "l_linenumber")
    joined = rows.join(own, rows["l_partkey"] == own["fid"])
    alias = F.concat(F.lit("A"), F.regexp_extract("home", "([0-9]+)", 1))
    return joined.select("caller_module", F.when(F.col("l_linenumber") % 5 != 0, alias).alias("callee_module"), "callee", (F.col("arity") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("arity"), (F.col("l_orderkey") % 1000).alias("line"))


def aliases(t) -> DataFrame:
    """Every module knows every other one by a short name."""
    names = t.part.select(F.col("p_brand").alias("target")).distinct()
    mods = names.select(F.col("target").alias("module"))
    return mods.join(names, F.lit(True)).select("module", F.concat(F.lit("A"), F.regexp_extract("target", "([0-9]+)", 1)).alias("alias"), "target")


def commits(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("sha"), F.concat(F.lit("Dev"), F.col("o_custkey").cast("string")).alias("author"), F.col("o_orderdate").alias("ts"), F.concat("o_orderpriority", F.lit(" (#"), (F.col("o_orderkey") % 500).cast("string"), F.lit(")")).alias("message"))


def commit_files(t) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"))


def prs(t) -> DataFrame:
    return t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("number"), F.concat(F.lit("PR "), F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("merged_at"))


def pr_commits(t) -> DataFrame:
    return prs(t).select("number", (F.col("number") - F.col("number") % 2).alias("sha"))


def pr_files(t) -> DataFrame:
    n = t.parts("lineitem")
    return commit_files(t).repartition(n, "sha").join(prs(t).select(F.col("number").alias("sha")).repartition(n, "sha"), "sha", "left_semi").select(F.col("sha").alias("number"), "file")


def tool_log(t) -> DataFrame:
    return t.events.select("ts", F.col("event_type").alias("tool_name"), F.col("value").alias("execution_time_ms"), (F.col("event_type") != "error").alias("success"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), "user_id", "event_id")


def doc_keywords(t) -> DataFrame:
    """Plain keywords of documents: entity, kw, times."""
    return t.documents.select(F.col("doc_id").alias("entity"), F.explode(T.keywords(F.col("text"))).alias("kw")).groupBy("entity", "kw").agg(F.count("*").alias("times"))


def document_words(rows: DataFrame) -> DataFrame:
    """(file, entity, kw, weight) of rows of documents, as an index takes them in: each keyword of a row once."""
    counts = K.counted(rows.select("file", F.col("doc_id").alias("entity"), "text"), T.keywords(F.col("text")))
    return counts.select("file", "entity", F.explode_outer("counts").alias("c")).where("c is not null").select("file", "entity", "c.kw", F.col("c.times").cast("double").alias("weight"))


def document_sets(t) -> DataFrame:
    """(entity, kw): each keyword of a row of documents once."""
    return t.documents.select(F.col("doc_id").alias("entity"), F.explode_outer(F.array_distinct(T.keywords(F.col("text")))).alias("kw"))


def turn_keywords(t) -> DataFrame:
    """Keywords of conversations: a second source with the same entities."""
    return t.conversations.select(F.col("conv_id").alias("entity"), F.explode(T.keywords(F.col("text"))).alias("kw")).groupBy("entity", "kw").agg(F.count("*").alias("times"))


def source_lines(t) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).select("file", (F.col("line") + 1).cast("bigint").alias("line"), "text")


def paths(t) -> DataFrame:
    """Paths of page addresses."""
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"), "url")


def file_state(t, old: bool) -> DataFrame:
    """Two states of a tree of files: all documents, at first with the benchmark's items, later without digits and with the pages."""
    file = lambda rows, kind, key, text: rows.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("path"), F.md5(text.cast("binary")).alias("md5"))
    if old:
        return file(t.documents, "d", "doc_id", F.col("text")).unionByName(file(t.benchmark, "b", "item_id", F.col("text")))
    return file(t.documents, "d", "doc_id", F.translate("text", "0123456789", "")).unionByName(file(t.pages, "p", "page_id", F.col("html")))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def sql_keywords(text: str) -> str:
    """SQL list of the keywords of a text."""
    return f"list_filter(list_transform(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z][a-zA-Z0-9_]*')), lambda x: lower(x)), lambda x: length(x) > 2 and x not in ({_STOP}))"


CTE = {
    "functions": "functions as (select p_partkey as fid, p_brand as module, replace(p_name, ' ', '_') as name, (p_size % 5)::bigint as arity, p_partkey % 1000 as line, case when p_size % 4 = 0 then 'defp' else 'def' end as ftype, 'lib/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || case when p_size % 7 = 0 then '_test.exs' else '.ex' end as file, p_retailprice as score from part)",
    "calls": "calls as (select 'Brand#' || (l_suppkey % 25 + 1) as caller_module, case when l_linenumber % 5 <> 0 then 'A' || regexp_extract(f.module, '([0-9]+)', 1) end as callee_module, f.name as callee, f.arity + case when l_linenumber = 1 then 1 else 0 end as arity, l_orderkey % 1000 as line from lineitem join functions f on l_partkey = fid)",
    "resolved": "resolved as (select *, coalesce('Brand#' || substr(callee_module, 2), caller_module) as target from calls)",
    "commits": "commits as (select o_orderkey as sha, 'Dev' || o_custkey as author, o_orderdate as ts, o_orderpriority || ' (#' || (o_orderkey % 500) || ')' as message from orders)",
    "commit_files": "commit_files as (select l_orderkey as sha, l_partkey as file from lineitem)",
    "prs": "prs as (select o_orderkey as number, 'PR ' || o_orderpriority as title, o_orderstatus as state, o_orderdate as merged_at from orders where o_orderstatus <> 'P')",
    "pr_commits": "pr_commits as (select number, number - number % 2 as sha from prs)",
    "pr_files": "pr_files as (select l_orderkey as number, l_partkey as file from lineitem where l_orderkey in (select number from prs))",
    "tool_log": "tool_log as (select ts, event_type as tool_name, value as execution_time_ms, event_type <> 'error' as success, json_extract_string(props, '$.k')::bigint as tokens, user_id, event_id from events)",
    "doc_keywords": f"doc_keywords as (select entity, kw, count(*) as times from (select doc_id as entity, unnest({sql_keywords('text')}) as kw from documents) group by all)",
    "turn_keywords": f"turn_keywords as (select entity, kw, count(*) as times from (select conv_id as entity, unnest({sql_keywords('text')}) as kw from conversations) group by all)",
    "df": "df as (select kw, count(*) as df from doc_keywords group by kw)",
    "zipf": "zipf as (select kw, df, 1.0::double / dense_rank() over (order by df) as zipf from df)",
    "source_lines": "source_lines as (select doc_id as file, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line, unnest(string_split(text, chr(10))) as text from documents)",
    "paths": "paths as (select page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path, url from pages)",
    "old_state": "old_state as (select 'd' || doc_id as path, md5(text) as md5 from documents union all select 'b' || item_id, md5(text) from benchmark)",
    "new_state": "new_state as (select 'd' || doc_id as path, md5(regexp_replace(text, '[0-9]', '', 'g')) as md5 from documents union all select 'p' || page_id, md5(html) from pages)",
}
