"""The queries opN_<name> and their SQL, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, html, mixing, pii, quality, simhash, substring, topk, toxicity
from .common import table


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_lm_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm.Model(docs).score(docs)


def op3_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs))


def op5_decontaminate_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_substring_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(table(spark, sf_dir, "documents")).drop("text")


def op8_simhash_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_mix_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_bradley_terry, op2_lm_hidden_markov, op3_html_line_blocks, op4_pii_weak_supervision, op5_decontaminate_spaced_seeds, op6_toxicity_nb_ngrams, op7_substring_count_min, op8_simhash_vantage_point, op9_topk_branch_and_bound, op10_mix_entropy_balancing)}


OP9_SQL = """
with v as (
    select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
    select q.row, q.vec_id as query_id, c.vec_id as vec_id,
        list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
    from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
    where q.vec_id % 100 = 0
), r as (
    select *, row_number() over (partition by row order by score desc, vec_id) as rank from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""


OP7_SQL = r"""
with d as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
    select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50) q
), f as (
    select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as least from s) q where least < doc_id
), g as (
    select distinct doc_id, unnest(range(i, i + 50)) as p from f
), n as (
    select doc_id, count(*) as n_removed from g group by doc_id
), x as (
    select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d
), t as (
    select doc_id, string_agg(x, ' ' order by p) as kept from x anti join g using (doc_id, p) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join n using (doc_id) left join t using (doc_id)
"""


OP5_SQL = r"""
with b as (
    select distinct item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where text is not null
), t as (
    select distinct doc_id, text from documents
), d as (
    select doc_id, row_number() over () as row, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from t
), x as (
    select item_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as j from b
), y as (
    select doc_id, row, unnest(w) as word, generate_subscripts(w, 1) as i from d
), m as (
    select doc_id, row, item_id, n, least(n, 20) as size, i - j as shift, j from x join y using (word)
), a as (
    select doc_id, item_id, n, size, count(*) over (partition by row, item_id, shift order by j range between current row and (size - 1) following) as agreeing from m
)
select doc_id, item_id, max(agreeing)::int as agreeing, max(size)::int as "window" from a
where agreeing >= case when n < 8 then n else ceil(size * 0.8) end group by doc_id, item_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate_spaced_seeds": OP5_SQL, "op7_substring_count_min": OP7_SQL, "op9_topk_branch_and_bound": OP9_SQL}
