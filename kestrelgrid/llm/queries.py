"""The pipeline operators as registered queries: each reads its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _remainder(spark: SparkSession, divisor: int):
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score

    return score(documents(spark, sf_dir), _remainder(spark, 7) == 2)


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .length_histogram import by_limit, histogram

    return by_limit(histogram(documents(spark, sf_dir), *vocabulary()))


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii import find

    # what the sanitised text is (null: unchanged) shows in its hash
    return find(documents(spark, sf_dir)).withColumn("sanitised_sha256", F.sha2(F.col("sanitised").cast("binary"), 256)).drop("sanitised")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import find_repeats

    return find_repeats(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = documents(spark, sf_dir)
    held_out = _remainder(spark, 4) == 2
    return identify(docs.withColumn("held_out", held_out), train(docs, ~held_out), ("doc_id", "held_out"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import classify, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return classify(docs, train(docs, labels, ("low_quality", "toxic")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .set_join import groups

    return groups(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import against_edits

    return against_edits(documents(spark, sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    return plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    return encode(documents(spark, sf_dir), *vocabulary(), with_ids=False)


def op11_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .block_search import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import digests, planted

    return digests(documents(spark, sf_dir), edit=planted)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import counted, misspell, runs, variants

    # runs of fewer letters can't become words, as the edit only deletes
    return variants(counted(misspell(runs(documents(spark, sf_dir)), every=199)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_tree, op2_length_histogram, op3_sanitise, op4_exact_dedup, op5_language_id, op6_toxicity_chain, op7_ngram_join, op8_weighted_fingerprints,
        op9_mix_sources, op10_byte_bpe, op11_block_top_k, op12_periodic_runs, op13_spelling_variants,
    )
}

ORACLES = {
    "op4_exact_dedup": """
with n as (select doc_id, coalesce(length(text), 0) as chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents),
r as (select *, count(*) over (partition by text_sha256) as group_size, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r""",
    "op9_mix_sources": """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, ('0x' || substr(md5('7:' || doc_id), 1, 15))::bigint as draw from documents),
s as (select source, sum(size)::double as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (select *, [5.0, 2.0, 1.0][(k - 1) % 3 + 1] as weight, 2 * source_size as cap from s),
o as (select *, 1.5 * sum(source_size) over () as asked, coalesce(sum(cap) over (order by cap / weight, k rows between unbounded preceding and 1 preceding), 0) as filled, sum(weight) over (order by cap / weight, k rows between current row and unbounded following) as free from w),
l as (select *, (asked - filled) / free as level from o),
t as (select source, source_size::bigint as source_size, least(cap, weight * coalesce((select level from l where level * weight <= cap order by cap / weight, k limit 1), 1e300)) as target from l),
r as (select *, case when source_size > 0 then floor(target / source_size + 1e-12) else 0 end as whole from t),
c as (select d.*, r.source_size, r.target, whole, r.target - whole * r.source_size as rest, sum(size) over (partition by d.source order by draw, doc_id) as upto from d join r on d.source is not distinct from r.source)
select doc_id, size, source_size, target, (size * whole + least(size, greatest(0, floor(rest - (upto - size)))))::bigint as taken from c""",
    "op11_block_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as c from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, c as terms from v where vec_id % 20 = 0),
s as (select query_id, vec_id, coalesce(list_sum(list_transform(list_zip(terms, c), lambda p: p[1] * p[2])), 0)::bigint as score from q join v on query_id <> vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
}
