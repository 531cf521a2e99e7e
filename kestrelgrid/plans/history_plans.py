"""Commits, pull requests, co-change and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof as J
from ..operators import history as H
from ..operators import pairs as P
from ..operators import passes, ranks
from . import adapters as A
from .registry import query

_SIZED = "sized as (select sha, file from (select distinct sha, file from commit_files) where sha in (select sha from commit_files group by sha having count(distinct file) between 2 and 100))"
_PAIRS = f"{_SIZED}, pairs as (select a.file as a, b.file as b, count(*) as cnt from sized a join sized b on a.sha = b.sha and a.file < b.file group by all)"


def _pairs(t):
    return P.together(A.commit_files(t), "sha", "file", parts=t.parts("lineitem"))


@query("J12 A7 A9 K19", f"with {_PAIRS} select a, b, cnt from pairs where cnt >= 2", "commit_files")
def cochange_pairs(t):
    return P.frequent(_pairs(t))


@query("A8 W10", f"""
with {_SIZED}, ordered as (select sha, row_number() over (order by ts desc, sha) as k from commits),
chosen as (select sha from ordered where (k - 1) % 2 = 0),
p as (select a.file as a, b.file as b, count(*) as n from sized a join sized b on a.sha = b.sha and a.file < b.file where a.sha in (select sha from chosen) group by all)
select a, b, (n * 2)::bigint as cnt from p where n * 2 >= 2""", "commits commit_files")
def cochange_sampled(t):
    n = t.parts("lineitem")
    chosen = P.every_nth(A.commits(t), ranges=max(ranks.RANGES, t.parts("orders")))
    files = A.commit_files(t).repartition(n, "sha").join(chosen.select("sha").repartition(n, "sha"), "sha", "left_semi")
    return P.scaled(P.together(files, "sha", "file", parts=n))


@query("J14 O4 R2", f"""
with {_PAIRS}, both_ways as (select a as item, b as partner, cnt from pairs where cnt >= 2 union all select b, a, cnt from pairs where cnt >= 2)
select item, partner, cnt, rank from (select *, row_number() over (partition by item order by cnt desc, partner) as rank from both_ways) where rank <= 10""", "commit_files")
def cochange_partners(t):
    return P.partners(P.frequent(_pairs(t)))


@query("A9", "select sha, count(distinct file) as files from commit_files group by sha having count(distinct file) between 2 and 5", "commit_files")
def cochange_cap(t):
    return P.sized(A.commit_files(t), "sha", "file", most=5).select("sha", F.size("_items").cast("bigint").alias("files"))


@query("W10", "select sha from (select sha, row_number() over (order by ts desc, sha) as k from commits) where (k - 1) % 2 = 0", "commits")
def commit_sample(t):
    return P.every_nth(A.commits(t)).select("sha")


@query("S13", "select sha from (select sha, row_number() over (order by ts desc, sha) as k, count(*) over () as n from commits) where k <= case when n <= 500 then n when n <= 3000 then least(n, 1500) when n <= 10000 then 2000 else 1500 end", "commits")
def adaptive_limit(t):
    c = A.commits(t)
    return c.orderBy(F.col("ts").desc(), "sha").limit(P.adaptive_limit(c.count())).select("sha")


_MATRIX = "m as (select a.kw as kw1, b.kw as kw2, count(*) as cnt from doc_keywords a join doc_keywords b on a.entity = b.entity and a.kw <> b.kw group by all)"


@query("J13", f"with {_MATRIX} select kw1, kw2, cnt from m where cnt >= 5", "doc_keywords")
def cooccur_matrix(t):
    return P.symmetric(P.together(A.document_sets(t), "entity", "kw", most=None, least=5))


@query("A10 B12", """
with hit as (select entity, kw from doc_keywords where kw in ('ention', 'ing')),
m as (select h.kw as kw1, d.kw as kw2, count(*) as cnt from hit h join doc_keywords d on d.entity = h.entity where d.kw not in ('ention', 'ing') group by all)
select kw2 as kw, sum(cnt)::bigint as score, string_agg(distinct kw1, ',' order by kw1) as terms from m group by kw2 order by score desc, kw limit 10""", "doc_keywords")
def cooccur_suggest(t):
    return P.suggest(t.keyword_index().postings, "entity", "kw", ["ention", "ing"], 10, once=True)


@query("A11", """
with hit as (select distinct entity from doc_keywords where kw in ('ention', 'heat'))
select kw, count(distinct d.entity) as results from doc_keywords d join hit h on h.entity = d.entity where kw not in ('ention', 'heat') group by kw order by results desc, kw limit 10""", "doc_keywords")
def cooccur_narrow(t):
    index = t.keyword_index()
    k = index.postings
    hit = index.of_words(["ention", "heat"]).select("entity").distinct()
    rest = P.of_hits(k.where(~F.col("kw").isin("ention", "heat")), hit, "entity", "left_semi")
    # a posting is one keyword of one entity
    return rest.groupBy("kw").agg(F.count("*").alias("results")).orderBy(F.col("results").desc(), "kw").limit(10)


@query("A12", f"with {_MATRIX}, d as (select kw1, count(*) as degree from m group by kw1) select count(*) as keywords, (sum(degree) / 2)::bigint as relations, round(avg(degree), 6) as avg_degree, max(degree) as max_degree from d", "doc_keywords")
def cooccur_stats(t):
    degree = P.degrees(A.document_sets(t), "entity", "kw")
    return degree.agg(F.count("*").alias("keywords"), (F.sum("degree") / 2).cast("bigint").alias("relations"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"))


@query("S14 R6", "select sha, ts from commits where sha in (select sha from commit_files where file = 7) order by ts desc, sha limit 10", "commits commit_files")
def file_history(t):
    return H.of_file(A.commits(t), A.commit_files(t), F.lit(7), 10).select("sha", "ts")


@query("F23", "select l_orderkey as sha, sum(l_quantity) as changes from lineitem where l_partkey = 7 group by l_orderkey having sum(l_quantity) >= 20")
def history_filtered(t):
    return t.lineitem.where("l_partkey = 7").groupBy(F.col("l_orderkey").alias("sha")).agg(F.sum("l_quantity").alias("changes")).where("changes >= 20")


@query("F22", "select sha, message from (select * from commits order by ts desc, sha limit 500) where contains(lower(message), 'urgent') order by ts desc, sha limit 20", "commits")
def commit_search(t):
    return H.search(A.commits(t), "Urgent", 20).select("sha", "message")


@query("K26", "select sha, author, ts from commits order by ts desc, sha limit 25", "commits")
def recent_commits(t):
    return A.commits(t).orderBy(F.col("ts").desc(), "sha").limit(25).select("sha", "author", "ts")


@query("K26", "select l_orderkey as sha, count(distinct l_partkey) as files, sum(l_quantity) as insertions, sum(l_linenumber)::bigint as deletions from lineitem group by all")
def commit_details(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("sha")).agg(F.countDistinct("l_partkey").alias("files"), F.sum("l_quantity").alias("insertions"), F.sum("l_linenumber").alias("deletions"))


_TOUCH = "touches as (select file, c.sha, ts from commit_files f join commits c on c.sha = f.sha)"


def _touches(t):
    n = t.parts("lineitem")
    return A.commit_files(t).repartition(n, "sha").join(A.commits(t).select("sha", "ts", "message").repartition(n, "sha"), "sha")


@query("A27", f"""
with {_TOUCH}, e as (select file, min(ts) as created_at, max(ts) as last_modified_at, arg_max(sha, struct_pack(t := ts, s := sha)) as last_modified_sha, count(distinct sha) as modification_count from touches group by file)
select file, created_at, last_modified_at, last_modified_sha, modification_count, round(case when modification_count >= 2 and datediff('day', created_at, last_modified_at) > 0 then modification_count / (datediff('day', created_at, last_modified_at) / 30.0::double) end, 6) as modification_frequency from e""", "commits commit_files")
def evolution(t):
    out = H.evolution(_touches(t).select("file", "sha", "ts"), ["file"])
    return out.withColumn("modification_frequency", F.round("modification_frequency", 6))


@query("A28", f"with {_TOUCH}, e as (select file % 100 as m, count(distinct sha) as n, max(ts) as last_ts from touches group by 1) select fid, n as commits, last_ts from functions join e on fid % 100 = m", "functions commits commit_files")
def batch_evolution(t):
    e = H.evolution(_touches(t).select((F.col("file") % 100).alias("m"), "sha", "ts"), ["m"]).select("m", F.col("modification_count").alias("commits"), F.col("last_modified_at").alias("last_ts"))
    return A.functions(t).select("fid", (F.col("fid") % 100).alias("m")).join(e, "m").drop("m")


@query("K25", f"""
with touches as (select file, c.sha, ts, message from commit_files f join commits c on c.sha = f.sha),
r as (select *, contains(message, 'URGENT') as mentioned, row_number() over (partition by file order by case when contains(message, 'URGENT') then 0 else 1 end, ts desc, sha) as k from (select distinct * from touches))
select file, sha, mentioned from r where k <= 5""", "commits commit_files")
def heuristic_history(t):
    rows = _touches(t).distinct().select("file", "sha", "ts", F.contains("message", F.lit("URGENT")).alias("mentioned"))
    return H.heuristic(rows.repartition(t.parts("lineitem"), "file"), ["file"], F.col("mentioned"), 5).select("file", "sha", "mentioned")


@query("K16 J10", """
with p as (select sha, max(number) as number from pr_commits group by sha)
select c.sha, p.number, prs.title from commits c left join p on p.sha = c.sha left join prs on prs.number = p.number where contains(lower(c.author), 'dev7')""", "commits prs pr_commits")
def git_history(t):
    """Commits of an author with their pull request."""
    return H.with_pr(H.by_author(A.commits(t), "dev7"), A.pr_commits(t), A.prs(t)).select("sha", "number", "title")


@query("A24 J10", "select sha, max(number) as number from pr_commits group by sha", "prs pr_commits")
def commit_to_pr(t):
    return H.pr_of_commit(A.pr_commits(t))


@query("A24", "select file, string_agg(distinct lpad(number::varchar, 8, '0'), ',' order by lpad(number::varchar, 8, '0') desc) as numbers from pr_files group by file", "prs pr_files")
def file_to_prs(t):
    return H.prs_of_file(A.pr_files(t)).select("file", F.array_join(F.transform("numbers", lambda n: F.lpad(n.cast("string"), 8, "0")), ",").alias("numbers"))


@query("J11", """
select f.file, p.number, p.merged_at from (select distinct number, file from pr_files) f join prs p on p.number = f.number
qualify row_number() over (partition by f.file order by p.number desc) <= 5""", "prs pr_files")
def file_pr_history(t):
    n = t.parts("lineitem")
    rows = A.pr_files(t).distinct().join(A.prs(t).select("number", "merged_at").repartition(n, "number"), "number").repartition(n, "file")
    w = Window.partitionBy("file").orderBy(F.col("number").desc())
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 5").select("file", "number", "merged_at")


@query("K20", "select file, max(number) as number, count(distinct number) as prs from pr_files group by file", "prs pr_files")
def pr_recent(t):
    return A.pr_files(t).repartition(t.parts("lineitem"), "file").groupBy("file").agg(F.max("number").alias("number"), F.countDistinct("number").alias("prs"))


@query("R3", """
with b as (select user_id, event_id, event_id % 500 as sha from events)
select event_id, p.number from b left join (select sha, max(number) as number from pr_commits group by sha) p on p.sha = b.sha""", "prs pr_commits")
def pr_for_line(t):
    blame = t.events.select("event_id", (F.col("event_id") % 500).alias("sha"))
    return blame.join(H.pr_of_commit(A.pr_commits(t)), "sha", "left").select("event_id", "number")


_MAP = """old as (select * from source_lines), new as (select file, line + file % 30 as line, text from source_lines where not regexp_matches(text, '[0-9]')),
com as (select file * 1000000 + line as id, file, line from old),
hit as (select c.id, min(n.line) as now from com c join old o on o.file = c.file and o.line = c.line join new n on n.file = c.file and trim(n.text, ' ') = trim(o.text, ' ') and abs(n.line - c.line) <= 20 group by c.id)"""


def _remapped(t):
    old = A.source_lines(t)
    new = old.where(~F.col("text").rlike("[0-9]")).select("file", (F.col("line") + F.col("file") % 30).alias("line"), "text")
    comments = old.select((F.col("file") * 1_000_000 + F.col("line")).alias("id"), "file", "line")
    return H.remap(comments, old, new)


@query("J21", f"with {_MAP} select com.id, now from com left join hit on hit.id = com.id", "source_lines")
def pr_comment_remap(t):
    return _remapped(t).select("id", "now")


@query("R4", f"with {_MAP} select count(now) as mapped, count(*) - count(now) as unmapped from com left join hit on hit.id = com.id", "source_lines")
def remap_totals(t):
    return _remapped(t).agg(F.count("now").alias("mapped"), (F.count("*") - F.count("now")).alias("unmapped"))


@query("X15", "select sha, case when regexp_matches(message, '\\((PR )?#(\\d+)\\)') then regexp_extract(message, '\\((?:PR )?#(\\d+)\\)', 1)::bigint end as pr from commits", "commits")
def pr_number(t):
    return A.commits(t).select("sha", T.pr_number(F.col("message")).alias("pr"))


@query("S12", """
with l as (select file, line, text, case when line % 7 = 1 then file || ':' || line end as head from source_lines)
select file, line, last_value(head ignore nulls) over (partition by file order by line) as head from l""", "source_lines")
def log_fill_forward(t):
    """A log export's lines carry the last header line seen above them."""
    head = F.when(F.col("line") % 7 == 1, F.concat(F.col("file").cast("string"), F.lit(":"), F.col("line").cast("string")))
    w = Window.partitionBy("file").orderBy("line")
    return A.source_lines(t).select("file", "line", F.last(head, ignorenulls=True).over(w).alias("head"))


@query("A32", "select l_suppkey, min(l_partkey) as low, max(l_partkey) as high, length(regexp_extract(lpad(min(l_partkey)::varchar, 8, '0'), '^0*')) as zeros from lineitem group by l_suppkey")
def common_prefix(t):
    """The common prefix of a sorted set of paths is that of its least and greatest."""
    low = F.lpad(F.min("l_partkey").cast("string"), 8, "0")
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"), F.length(F.regexp_extract(low, "^0*", 0)).cast("bigint").alias("zeros"))


@query("S15 K16", """
with touches as (select l_partkey as file, 'f' || l_suppkey % 5 as name, l_orderkey as sha, o_orderdate as ts, l_linenumber * 10 as start_line, l_linenumber * 10 + l_quantity::bigint as end_line from lineitem join orders on o_orderkey = l_orderkey),
wanted as (select p_partkey as file, 'f' || p_size as name, p_size as start, p_size + 10 as stop from part),
h as (select w.file, w.name, w.start, w.stop, sha, ts, max((t.name = w.name)::int) as named from wanted w join touches t on t.file = w.file where t.name = w.name or (start_line <= stop and end_line >= start) group by all),
b as (select *, max(named) over (partition by file) as any_named from h)
select file, name, sha, rank, case when any_named = 1 then 'name' else 'lines' end as by from (select *, row_number() over (partition by file order by ts desc, sha) as rank from b where named = any_named) where rank <= 5""")
def line_history(t):
    """Commits of each function by name, or by its lines where no commit names it."""
    n = t.parts("lineitem")
    dated = t.lineitem.repartition(n, "l_orderkey").join(t.orders.select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    touches = dated.select(F.col("l_partkey").alias("file"), F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("name"), F.col("l_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("bigint")).alias("end_line"))
    wanted = t.part.select(F.col("p_partkey").alias("file"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("name"), F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("stop"))
    return H.of_lines(touches.repartition(n, "file"), wanted.repartition(n, "file"), 5).select("file", "name", "sha", "rank", "by")


_HUNKS = """c as (select l_partkey as file, l_orderkey as sha, min(l_linenumber) * 5 as x, max(l_quantity)::bigint % 4 as o, (max(l_quantity)::bigint + min(l_linenumber)) % 5 as n, max(l_quantity)::bigint % 3 as m, date_diff('day', date '1990-01-01', min(o_orderdate)::date) * 100000000 + l_orderkey as seq from lineitem join orders on o_orderkey = l_orderkey group by l_partkey, l_orderkey)"""


def hunks(t):
    """Two hunks a commit and file: one of o old and n new lines behind line x, one of 2 old and m new lines 39 lines on."""
    day = F.date_diff(F.min("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    q = F.max("l_quantity").cast("long")
    c = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("sha"))
    c = c.agg((F.min("l_linenumber") * 5).cast("long").alias("x"), (q % 4).alias("o"), ((q + F.min("l_linenumber")) % 5).alias("n"), (q % 3).alias("m"), day.alias("day"))
    side = lambda at, lines: F.when(lines == 0, at).otherwise(at + 1)
    x, o, n, m = (F.col(k) for k in "xonm")
    pair = F.array(
        F.struct(side(x, o).alias("old_start"), o.alias("old_lines"), side(x, n).alias("new_start"), n.alias("new_lines")),
        F.struct((x + 40).alias("old_start"), F.lit(2).cast("long").alias("old_lines"), side(x + 39 + n - o, m).alias("new_start"), m.alias("new_lines")),
    )
    rows = c.select("file", "sha", (F.col("day") * 100_000_000 + F.col("sha")).alias("seq"), F.explode(pair).alias("h"))
    # a hunk without lines on either side is none
    return rows.select("file", "sha", "seq", "h.*").where("old_lines + new_lines > 0")


@query("S15", f"""
with recursive {_HUNKS},
h as (select *, row_number() over (partition by file order by seq desc) as k, x as s1, x + n as e1, x as p1, x + o as q1, x + 39 + n - o as s2, x + 39 + n - o + m as e2, x + 39 as p2, x + 41 as q2 from c),
walk as (
select p_partkey as file, p_size::bigint - 1 as a, p_size::bigint + 10 as b, 0::bigint as k, null::bigint as sha, false as touched, 0::bigint as ua, 0::bigint as ub from part
union all
select w.file,
case when n > 0 and s1 <= a and e1 > a then p1 when m > 0 and s2 <= a and e2 > a then p2 else a + case when e1 <= a then o - n else 0 end + case when e2 <= a then 2 - m else 0 end end,
case when m > 0 and s2 < b and e2 >= b then q2 when n > 0 and s1 < b and e1 >= b then q1 else b + case when s1 < b then o - n else 0 end + case when s2 < b then 2 - m else 0 end end,
h.k, h.sha, (n > 0 and s1 < b and e1 > a) or (n = 0 and o > 0 and a < s1 and s1 < b) or (m > 0 and s2 < b and e2 > a) or (m = 0 and a < s2 and s2 < b), a, b
from walk w join h on h.file = w.file and h.k = w.k + 1 where a < b)
select file, sha, row_number() over (partition by file order by k) as nth, ua + 1 as start, ub as stop from walk where touched""")
def line_range_history(t):
    """The commits that touched ten lines of each file, found through the hunks of all commits."""
    ranges = t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file"), F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("stop"))
    return passes.line_history(hunks(t), ranges).select("file", "sha", "nth", "start", "stop")
