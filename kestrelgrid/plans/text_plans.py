"""Text functions over documents, pages and definitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from . import adapters as A
from .registry import query


@query("X8", r"""
with p as (select doc_id, unnest(string_split_regex(text, '\n+')) as p, generate_subscripts(string_split_regex(text, '\n+'), 1) as k from documents),
s as (select *, contains(lower(p), 'heat')::int + contains(lower(p), 'ention')::int as n from p),
b as (select *, row_number() over (partition by doc_id order by n desc, k) as r from s)
select doc_id, case when n > 0 then md5(trim(p, ' ')) end as best from b where r = 1""")
def paragraph_pick(t):
    return t.documents.select("doc_id", F.md5(T.paragraph_with_most(F.col("text"), ["heat", "ention"]).cast("binary")).alias("best"))


@query("X9", r"select doc_id, md5(regexp_replace(text, '(heating|heat|ing)', '*\1*', 'gi')) as marked from documents")
def highlight(t):
    return t.documents.select("doc_id", F.md5(T.highlight(F.col("text"), ["ing", "heat", "heating"]).cast("binary")).alias("marked"))


@query("X10", """
with f as (select doc_id, text, case when instr(lower(text), 'heat') > 0 then instr(lower(text), 'heat') else 1 end as spot from documents),
b as (select *, greatest(1, least(spot - 75, length(text) - 149)) as begin from f)
select doc_id, md5(case when length(text) <= 150 then text else case when begin > 1 then '...' else '' end || substr(text, begin, 150) || case when begin + 150 <= length(text) then '...' else '' end end) as cut from b""")
def smart_truncate(t):
    return t.documents.select("doc_id", F.md5(T.truncate_around(F.col("text"), ["heat"]).cast("binary")).alias("cut"))


@query("X11", r"""
with f as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') as flat from documents), a as (select *, instr(lower(flat), 'heat') as spot from f)
select doc_id, case when spot > 0 then substr(flat, greatest(1, spot - 30), least(spot + 54 - greatest(1, spot - 30), 80)) else substr(flat, 1, 80) end as cut from a""")
def doc_excerpt(t):
    return t.documents.select("doc_id", T.excerpt(F.col("text"), "heat").alias("cut"))


@query("X12", "select doc_id, 'docs: ' || text[:80] || ' strings: ' || array_to_string(list_sort([lang, source]), ', ') as context from documents")
def matched_context(t):
    both = F.array_sort(F.array("lang", "source"))
    return t.documents.select("doc_id", F.concat_ws(" ", F.lit("docs:"), F.left("text", F.lit(80)), F.lit("strings:"), F.array_join(F.slice(both, 1, 3), ", ")).alias("context"))


@query("X21", """
with d as (select o_orderkey, floor((epoch(timestamp '2001-08-02') - epoch(o_orderdate)) / 86400)::bigint as days from orders)
select o_orderkey, case when days <= 0 then 'today' when days = 1 then 'yesterday' when days < 7 then days || ' days ago' when days < 30 then (days // 7) || case when days // 7 = 1 then ' week ago' else ' weeks ago' end when days < 365 then (days // 30) || case when days // 30 = 1 then ' month ago' else ' months ago' end else (days // 365) || case when days // 365 = 1 then ' year ago' else ' years ago' end end as said from d""")
def relative_time(t):
    return t.orders.select("o_orderkey", D.relative(F.col("o_orderdate"), datetime(2001, 8, 2)).alias("said"))


@query("X7", "select fid, name, list_aggregate(list_transform(string_split(name, '_'), lambda x, i: case when i = 1 then x else upper(x[1]) || x[2:] end), 'string_agg', '') as camel from functions", "functions")
def case_convert(t):
    return A.functions(t).select("fid", T.to_snake(T.to_camel(F.col("name"))).alias("name"), T.to_camel(F.col("name")).alias("camel"))


@query("P4", "select fid, lower(name) as simple from functions", "functions")
def simple_name(t):
    return A.functions(t).select("fid", T.simple_name(T.canonical(F.col("module"), F.col("name"), F.col("arity"))).alias("simple"))


@query("X5", r"select url, list_aggregate(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(url, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ', 'g')), ' +'), lambda x: length(x) >= 3), 'string_agg', ' ') as parts from pages")
def split_cooccur(t):
    return t.pages.select("url", F.array_join(T.split_for_pairs(F.col("url")), " ").alias("parts"))


@query("X6", "select fid, list_aggregate(list_filter(string_split(lower('_' || name), '_'), lambda x: x <> ''), 'string_agg', ' ') as parts from functions", "functions")
def split_display(t):
    return A.functions(t).select("fid", F.array_join(T.split_for_display(F.concat(F.lit("_"), "name")), " ").alias("parts"))


@query("X14", """
with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x, i: repeat(' ', 2 + i % 3) || x) as l from documents),
m as (select *, list_min(list_transform(list_filter(l, lambda x: trim(x, ' ') <> ''), lambda x: length(x) - length(ltrim(x, ' ')))) as least from l)
select doc_id, md5(array_to_string(list_transform(l, lambda x: case when trim(x, ' ') = '' then '' else x[least + 1:] end), chr(10))) as body from m""")
def dedent(t):
    """The lines of every document, indented by their place, without what all have in common."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit(" "), 2 + (i + 1) % 3), x))
    return t.documents.select("doc_id", F.md5(F.array_join(T.dedent(lines), "\n").cast("binary")).alias("body"))


@query("X16 E12 E11", "select fid, module, case when fid % 2 = 0 then 'Kit' end as parent, name, case when fid % 2 = 0 then 'method' else 'function' end as kind, starts_with(name, 's') as private from (select fid, module, case when starts_with(name, 's') then '_' || name else name end as name from functions)".replace("starts_with(name, 's') as private", "starts_with(name, '_') as private"), "functions")
def symbol_parse(t):
    name = F.when(F.startswith("name", F.lit("s")), F.concat(F.lit("_"), "name")).otherwise(F.col("name"))
    symbol = F.concat(F.lit("scip python pkg `"), "module", F.lit("`/"), F.when(F.col("fid") % 2 == 0, "Kit#").otherwise(""), name, F.lit("()."))
    s = T.symbol_parts(symbol)
    return A.functions(t).select("fid", *[s[c].alias(c) for c in ("module", "parent", "name", "kind", "private")])


@query("X28", "select fid, replace(regexp_replace(file, '[.]exs?$', ''), '/', '.') as module from functions", "functions")
def path_to_module(t):
    return A.functions(t).select("fid", T.path_to_module(F.regexp_replace("file", "[.]exs?$", ".py")).alias("module"))


_KIND = "case when contains(lower({0}), 'class ') then 'class' when contains(lower({0}), 'interface ') then 'interface' when contains(lower({0}), 'type ') then 'type' when contains(lower({0}), 'enum ') then 'enum' end as kind"


@query("X27", f"select page_id, {_KIND.format('html')} from pages union all select conv_id * 1000 + turn, {_KIND.format('text')} from conversations")
def fence_kind(t):
    """Kinds that the texts of pages and conversations name."""
    pages = t.pages.select("page_id", T.fence_kind(F.col("html")).alias("kind"))
    return pages.unionByName(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), T.fence_kind(F.col("text")).alias("kind")))


_BARE = r"regexp_replace(regexp_replace(html, '(?s)/\*.*?\*/', '', 'g'), '(?m)^\s*(//|#).*$', '', 'g')"
_QUOTED = "list_filter(regexp_extract_all(html, '\"[^\"\\n]*\"|''[^''\\n]*'''), lambda x: length(x) >= 5)"


@query("X18 E13", f"select page_id, literal, count(*) as times from (select page_id, unnest({_QUOTED}) as literal from (select page_id, {_BARE} as html from pages)) group by all")
def string_scan(t):
    """The string literals of every page, with how often each occurs."""
    return t.pages.select("page_id", F.explode(T.string_literals(F.col("html"))).alias("literal")).groupBy("page_id", "literal").agg(F.count("*").alias("times"))


@query("P5 P1", "select doc_id, md5(concat_ws(chr(10) || chr(10), nullif(trim(source, ' '), ''), nullif(trim(lang, ' '), ''), nullif(trim(text, ' '), ''))) as body from documents")
def embedding_text(t):
    parts = [F.col(c) for c in ("source", "lang", "text")]
    return t.documents.select("doc_id", F.md5(T.embedding_text(*parts).cast("binary")).alias("body"))


#: Definitions of one module in a JSON document, at most.
_NESTED = 1_000


@query("P9", "select fid, module, name, arity, line, count(*) over (partition by module) as items, max(line) over (partition by module) as last_line from functions", "functions")
def usage_json(t):
    """Modules as nested JSON with their definitions, and back, with the totals of each module; one document a module and block of ids, so none grows with its module."""
    fn = A.functions(t)
    rows = F.collect_list(F.struct("fid", "name", "arity", "line")).alias("functions")
    nested = fn.groupBy("module", F.floor(F.col("fid") / _NESTED)).agg(F.to_json(F.struct("module", rows)).alias("j"))
    back = F.from_json("j", f"module string, functions array<struct<fid {fn.schema['fid'].dataType.simpleString()}, name string, arity bigint, line bigint>>")
    parsed = nested.select(back.alias("b")).select("b.module", "b.functions")
    totals = parsed.groupBy("module").agg(F.sum(F.size("functions")).alias("items"), F.max(F.array_max(F.transform("functions", lambda x: x["line"]))).alias("last_line"))
    each = parsed.select("module", F.explode_outer("functions").alias("f")).select("module", "f.*")
    same = each["module"].eqNullSafe(totals["module"])
    return each.join(F.broadcast(totals), same).select("fid", each["module"], "name", "arity", "line", "items", "last_line")


@query("P7 P8", "select fid, name || '(' || list_aggregate(list_transform(range(arity), lambda i: 'a' || i || ': int'), 'string_agg', ', ') || ') -> str' as signature from functions where arity > 0", "functions")
def signature_build(t):
    args = F.transform(F.sequence(F.lit(0), F.col("arity") - 1), lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit(": int")))
    return A.functions(t).where("arity > 0").select("fid", F.concat("name", F.lit("("), F.array_join(args, ", "), F.lit(") -> str")).alias("signature"))


@query("S11 E15", """
with w as (select file, regexp_extract_all(text, '[a-z]+') as w from source_lines)
select file, w[1] as name, len(w) - 1 as arity, count(*) as times from w where len(w) > 0 group by all""", "source_lines")
def signature_scan(t):
    """Signatures in sources with a definition for each line of a document: its first word with the others as arguments."""
    from ..sources.signatures import scan

    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    lines = A.source_lines(t).select("file", "line", F.translate("text", "\r", " ").alias("text"), words.alias("w"))
    head = F.concat(F.lit("def "), F.col("w")[0], F.lit("("), F.array_join(F.slice("w", F.lit(2), F.size("w")), ", "), F.lit("):\n    # "), "text")
    code = lines.select("file", F.struct("line", F.when(F.size("w") > 0, head).otherwise(F.concat(F.lit("# "), "text")).alias("code")).alias("l"))
    code = code.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["code"]), "\n").alias("source"))
    return scan(code, "source", "python").groupBy("file", "name", "arity").agg(F.count("*").alias("times"))


@query("O7", "select doc_id, list_slice(string_split(text, ' '), 1, 5)::varchar[] as head from documents")
def truncate_list(t):
    return t.documents.select("doc_id", F.slice(F.split("text", " "), 1, 5).alias("head"))


@query("X13 R9")
def fuzzy_names(t):
    from ..sources.parsers import similar

    return similar(A.functions(t).select("name").distinct(), "name", "hot_gera", 5)
