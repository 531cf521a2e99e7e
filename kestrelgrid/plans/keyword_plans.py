"""Keyword extraction, document frequency and scored search over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S
from ..functions import text as T
from ..operators import keywords as K
from ..operators import search
from . import adapters as A
from .registry import query

QUERY = ["the", "ention", ["heat", "ing"], "the"]
_TERMS = "terms as (select * from (values ('ention', 1, 1, 1.0::double), ('heat', 2, 2, 1.0), ('ing', 2, 3, 1.0), ('reed', 3, 4, 1.0), ('reed', 3, 5, 0.5)) x(term, grp, pos, decay))"
WORDS = ["ention", ["heat", "ing"], ["reed", "reed"]]


@query("X1 X2 K1 A26 O5", """
with k as (select doc_id as entity, unnest(%s) as kw, generate_subscripts(%s, 1) - 1 as spot from documents),
c as (select entity, kw, count(*) as times, min(spot)::bigint as spot from k group by all)
select entity, kw, times, rank from (select *, row_number() over (partition by entity order by times desc, spot) as rank from c) where rank <= 15""" % ((A.sql_keywords("text"),) * 2))
def kw_extract_topn(t):
    return K.top_words(t.documents, "doc_id", "text", 15).select("entity", "kw", "times", "rank")


_IDENT = r"""list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+[A-Z][a-zA-Z]*|[A-Z]{{2,}}[a-z]+[a-zA-Z]*|[A-Z][a-z]+[A-Z][a-zA-Z]*|[a-z]+_[a-z_]+|[A-Z]{{2,}}'))"""


@query("X3", f"select doc_id, ident, count(*) as docs_with from (select distinct doc_id, unnest({_IDENT.format('text')}) as ident from documents) group by all union all select -1, ident, count(*) from (select o_orderkey, unnest({_IDENT.format('o_orderpriority')}) as ident from orders) group by all")
def kw_identifiers(t):
    docs = t.documents.select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("ident")).groupBy("doc_id", "ident").agg(F.count("*").alias("docs_with"))
    orders = t.orders.select(F.explode(T.identifiers(F.col("o_orderpriority"))).alias("ident")).groupBy("ident").agg(F.count("*").alias("docs_with"))
    return docs.unionByName(orders.select(F.lit(-1).cast("bigint").alias("doc_id"), "ident", "docs_with"))


@query("X4 X23", r"""
select url, part, count(*) as n from (select url, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(replace(url, '_', ' '), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda x: x <> '')) as part from pages) group by all""")
def kw_split_identifier(t):
    return t.pages.select("url", F.explode(T.split_identifier(F.col("url"))).alias("part")).groupBy("url", "part").agg(F.count("*").alias("n"))


@query("A2 F11 X24", """
select entity, kw, max(weight) as weight, string_agg(source, '+' order by source) as sources from (
select entity, kw, times::double as weight, 'docs' as source from doc_keywords union all select entity, kw, times * 1.3, 'strings' from turn_keywords) group by all""", "doc_keywords turn_keywords")
def kw_source_merge(t):
    both = A.doc_keywords(t).select("entity", "kw", F.col("times").cast("double").alias("weight"), F.lit("docs").alias("source")).unionByName(A.turn_keywords(t).select("entity", "kw", F.col("times").cast("double").alias("weight"), F.lit("strings").alias("source")))
    return K.merge_sources(both, {"strings": T.STRING_BOOST})


@query("F11 F10", "select entity, kw, times from turn_keywords where length(kw) >= 8", "turn_keywords")
def source_type_filter(t):
    return A.turn_keywords(t).where(F.length("kw") >= 8)


@query("A1 W1", "select kw, df, zipf from zipf", "doc_keywords df zipf")
def zipf_weights(t):
    return t.keyword_index().terms


_SCORED = f"""with {_TERMS}, h as (select d.entity, d.kw, grp, times * zipf * decay as w from doc_keywords d join terms on kw = term join zipf z on z.kw = d.kw),
s as (select entity, sum(w) * (0.8 + 0.8 * count(distinct grp) / 3.0::double) as score from h group by entity)"""


def _scored(t):
    words = [term for term, _, _ in search.term_groups(WORDS)]
    return search.exact(t.keyword_index().of_words(words), search.terms(t.spark, WORDS), 3)


@query("K2 J1 A3 A4 W5 K7", _SCORED + " select entity, round(score, 6) as score from s", "doc_keywords df zipf")
def search_exact(t):
    return _scored(t).select("entity", F.round("score", 6).alias("score"))


@query("O1 O6 R1 F19", _SCORED + " select entity, round(score, 6) as score from s where round(score, 6) >= 0.001 order by round(score, 6) desc, entity limit 20", "doc_keywords df zipf")
def search_by_keywords(t):
    out = _scored(t).select("entity", F.round("score", 6).alias("score")).where("score >= 0.001")
    return search.ranked(out, "score", "entity", 20)


@query("O2 O3", _SCORED + " select entity, round(score, 6) as score from s order by round(score, 6) desc, entity limit 10 offset 20", "doc_keywords df zipf")
def paginate(t):
    return search.ranked(_scored(t).select("entity", F.round("score", 6).alias("score")), "score", "entity", 10, 20)


@query("K3 J2 A5", """
with p as (select * from (values ('ent*', 0, 0), ('*eat', 1, 1), ('th*ing', 2, 2)) x(pat, grp, pos)),
h as (select d.entity, pos, grp, max(times * zipf) as w from doc_keywords d join zipf z on z.kw = d.kw join p on d.kw like replace(pat, '*', '%') group by all)
select entity, round(sum(w) * (0.8 + 0.8 * count(distinct grp) / 3.0::double), 6) as score from h group by entity""", "doc_keywords df zipf")
def search_wildcard(t):
    patterns = ["ent*", "*eat", "th*ing"]
    return search.wildcard(t.keyword_index().of_patterns(search.any_pattern(patterns)), patterns).select("entity", F.round("score", 6).alias("score"))


@query("K4 P4", """
with q as (select * from (values ('gear', 1.0::double), ('hot_gear', 1.0), ('hot_gear', 0.5)) x(term, decay))
select fid as entity, sum(3.0 * decay) as bonus from functions join q on lower(name) = term where not (name = 'hot_gear' and ftype = 'defp') group by fid""", "functions")
def search_name_hit(t):
    fn = A.functions(t).withColumnRenamed("fid", "entity")
    keywords = fn.where("name = 'hot_gear' and ftype = 'defp'").select("entity", F.col("name").alias("kw"))
    q = t.spark.createDataFrame([("gear", 1.0), ("hot_gear", 1.0), ("hot_gear", 0.5)], "term string, decay double")
    return search.name_hits(fn, T.simple_name(T.canonical(F.col("module"), F.col("name"), F.col("arity"))), q, keywords)


@query("K5", """
select fid, case when fid % 2 = 0 then score / 1000 else 0 end + case when module = 'Brand#7' or ends_with(lower(module), '3') then 2.0 else 0.0 end as score from functions""", "functions")
def search_module_boost(t):
    fn = A.functions(t).select("fid", "module", F.when(F.col("fid") % 2 == 0, F.col("score") / 1000).alias("score"))
    return search.module_boost(fn, F.col("module"), ["Brand#7", "*3"]).select("fid", "score")


@query("K6", """
with c as (select file, count(*) as n from commit_files group by file)
select fid, round(score * (1 + coalesce(n, 0) * 0.005 + coalesce(n % 7, 0) * 0.01 + coalesce(n % 5, 0) * 0.0025), 6) as score from functions left join c on file = fid""".replace("file = fid", "c.file = fid"), "functions commit_files")
def search_cochange_boost(t):
    counts = A.commit_files(t).groupBy(F.col("file").alias("fid")).agg(F.count("*").alias("n"))
    fn = A.functions(t).join(counts, "fid", "left")
    factor = search.cochange_factor(F.col("n"), F.col("n") % 7, F.col("n") % 5)
    return fn.select("fid", F.round(F.col("score") * factor, 6).alias("score"))


@query("A6 W2 W3 O8", """
with s as (select avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd, min(o_totalprice) as low, max(o_totalprice) as high, count(*) as n from orders)
select o_orderkey, round(mean, 4) as mean, round(sd, 4) as sd, round((o_totalprice - mean) / sd, 6) as z, round((o_totalprice - low) / (high - low), 6) as normalized, round(100.0::double * (rank() over (order by o_totalprice) - 1) / n, 6) as percentile from orders, s""")
def score_distribution(t):
    out = S.distribution(t.orders.select("o_orderkey", F.col("o_totalprice").alias("score")))
    return out.select("o_orderkey", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), *[F.round(c, 6).alias(c) for c in ("z", "normalized", "percentile")])


_TIER = """with s as (select *, (o_totalprice - avg(o_totalprice) over ()) / stddev_samp(o_totalprice) over () as z from orders),
g as (select o_orderkey, o_orderstatus, case when z > 2 then 'exceptional' when z > 1 then 'strong' when z >= 0 then 'above_average' when z > -1 then 'below_average' else 'weak' end as tier from s)"""


def _graded(t):
    out = S.distribution(t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("score")))
    return out.select("o_orderkey", "o_orderstatus", S.tier(F.col("z")).alias("tier"))


@query("K12", _TIER + " select tier, o_orderstatus, count(*) as n from g group by all")
def score_tiers(t):
    return _graded(t).groupBy("tier", "o_orderstatus").agg(F.count("*").alias("n"))


@query("F20", _TIER + " select o_orderkey, tier from g where tier in ('exceptional', 'strong', 'weak')")
def tier_filter(t):
    return _graded(t).where((S.tier_rank(F.col("tier")) <= 2) | F.col("tier").isin("weak")).select("o_orderkey", "tier")


@query("F19", "select p_partkey, p_retailprice from part where p_retailprice >= 1000")
def score_threshold(t):
    return t.part.where("p_retailprice >= 1000").select("p_partkey", "p_retailprice")


@query("W4", "select s_suppkey, 100.0::double * row_number() over (order by s_acctbal, s_suppkey desc) / count(*) over () as pct from supplier")
def percentile_ranks(t):
    return S.positional_percentile(t.supplier, "s_acctbal", "s_suppkey").select("s_suppkey", "pct")


@query("J16 K11", """
with a as (select s_suppkey as k, 100.0::double * row_number() over (order by s_acctbal, s_suppkey desc) / count(*) over () as pct from supplier where s_acctbal > 0),
b as (select s_suppkey as k, 100.0::double * row_number() over (order by s_nationkey, s_suppkey desc) / count(*) over () as pct from supplier where s_nationkey < 20)
select k, round(case when a.pct is not null and b.pct is not null then least(greatest(a.pct, b.pct) * 1.5, 100) else coalesce(a.pct, b.pct) end, 6) as confidence, case when a.pct is not null and b.pct is not null then 'both' when a.pct is not null then 'keyword' else 'semantic' end as found_by from a full join b using (k)""")
def hybrid_merge(t):
    s = t.supplier.withColumnRenamed("s_suppkey", "k")
    a = S.positional_percentile(s.where("s_acctbal > 0"), "s_acctbal", "k").select("k", "pct")
    b = S.positional_percentile(s.where("s_nationkey < 20"), "s_nationkey", "k").select("k", "pct")
    return search.hybrid(a, b, ["k"]).select("k", F.round("confidence", 6).alias("confidence"), "found_by")


@query("W11", "select name, module, score from (select *, row_number() over (partition by name order by score desc, fid) as k from functions) where k = 1", "functions")
def dedupe_best(t):
    return search.best_per_name(A.functions(t), "name", "score", "fid").select("name", "module", "score")


@query("U1", """
with r as (select name, score, fid from functions where name like 'hot%' union all select name, 1.0, fid from functions where ends_with(name, 'gear'))
select name, max(score) as score, count(*) as hits from r group by name""", "functions")
def query_union(t):
    fn = A.functions(t)
    both = fn.where(P.wildcard(F.col("name"), "hot*")).select("name", "score", "fid").unionByName(fn.where(P.wildcard(F.col("name"), "*gear")).select("name", F.lit(1.0).alias("score"), "fid"))
    return both.groupBy("name").agg(F.max("score").alias("score"), F.count("*").alias("hits"))


@query("B9", "select distinct kw from doc_keywords where contains(kw, 'heat') order by kw limit 5", "doc_keywords")
def related_terms(t):
    return t.keyword_index().terms.where(F.contains("kw", F.lit("heat"))).select("kw").orderBy("kw").limit(5)


@query("R14 R11", "select count(distinct kw) as keywords, count(*) > 0 as available from doc_keywords", "doc_keywords")
def keyword_available(t):
    return t.keyword_index().terms.agg(F.count("*").alias("keywords"), (F.count("*") > 0).alias("available"))


@query("A29", """
select doc_id, ((length(text) - length(replace(lower(text), 'the', ''))) // 3)::bigint as hits from documents""")
def match_details(t):
    return t.documents.select("doc_id", T.occurrences(F.col("text"), "the").alias("hits"))


_FORMS = """forms as (select kw, kw as word, 1.0::double as score from base union all select kw, unnest(list_value(
case when regexp_matches(kw, '[^aeiou]y$') then kw[:-2] || 'ies' when regexp_matches(kw, '(s|x|z|ch|sh)$') then kw || 'es' else kw || 's' end,
case when regexp_matches(kw, '[^aeiou]y$') then kw[:-2] || 'ied' when ends_with(kw, 'e') then kw || 'd' else kw || 'ed' end,
case when regexp_matches(kw, '[^e]e$') then kw[:-2] || 'ing' else kw || 'ing' end,
case when regexp_matches(kw, '[^aeiou]y$') then kw[:-2] || 'ier' when ends_with(kw, 'e') then kw || 'r' else kw || 'er' end,
case when regexp_matches(kw, '[^aeiou]y$') then kw[:-2] || 'iest' when ends_with(kw, 'e') then kw || 'st' else kw || 'est' end)), 0.7 from base where not contains(kw, '_') and not regexp_matches(kw, '[0-9]'))"""


@query("X22 N7", f"with base as (select distinct kw from doc_keywords), {_FORMS} select word, max(score) as score from forms group by word", "doc_keywords")
def expand_inflections(t):
    """Rule-based forms of all keywords at 0.7 of their score; the best score of each word stays."""
    forms = F.explode(T.inflections(F.col("kw"))).alias("f")
    return t.keyword_index().terms.select(forms).groupBy("f.word").agg(F.max("f.score").alias("score"))


@query("B1 B4 B5 B6 O4", """
with s0 as (select fid, 0 as stage from functions where name = 'hotgear'),
s1 as (select fid, 1 from functions where name = '_hotgear'),
s2 as (select fid, 2 from functions where name = 'hot_gear'),
s3 as (select fid, 3 from functions where name like '%gear%'),
a as (select * from s0 union all select * from s1 union all select * from s2 union all select * from s3)
select fid, stage from a where stage = (select min(stage) from a)""", "functions")
def fallback_staged(t):
    fn = A.functions(t).select("fid", "name")
    stages = [("as written", fn.where("name = 'hotgear'")), ("private twin", fn.where("name = '_hotgear'")), ("other case", fn.where(F.col("name") == T.to_snake(F.lit("hotGear")))), ("contains", fn.where(P.wildcard(F.col("name"), "*gear*")))]
    return search.staged(stages).select("fid", "stage")


@query("O4", "select module, fid, rank from (select module, fid, row_number() over (partition by module order by score desc, fid) as rank from functions) where rank <= 10", "functions")
def topk_per_group(t):
    w = Window.partitionBy("module").orderBy(F.col("score").desc(), "fid")
    return A.functions(t).withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10").select("module", "fid", "rank")


@query("A25", "select module, count(*) as n from (select module from functions order by score desc, fid limit 10) group by module order by n desc, module limit 1", "functions")
def top_module_in_topk(t):
    best = A.functions(t).orderBy(F.col("score").desc(), "fid").limit(10)
    return best.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "module").limit(1)
