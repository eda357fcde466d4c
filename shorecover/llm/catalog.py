"""The registered queries of the operators: thin wrappers that derive the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, embedding_graph, fingerprints, hard_negatives, licenses, ngram_lm, pii, resampling, simhash, substring, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(divisor: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor == rest


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~_held_out(3, 1)))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(_held_out(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.edited(_table(spark, sf_dir, "documents")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digest(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), spec), spec))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judge(pages, urls.fit(urls.seed_labels(pages)), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(_table(spark, sf_dir, "embeddings")).rows


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_licenses, op4_bpe, op5_lm_scoring, op6_url_filter, op7_substring_dedup, op8_decontamination, op9_simhash, op10_pii, op11_hard_negatives, op12_embedding_dedup, op13_resampling)}


OP7 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w),
s as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as win from p where i + 12 <= len(words)),
f as (select win, min(doc_id) as least from s group by win),
r as (select distinct doc_id, unnest(range(s.i, s.i + 13)) as i from s join f using (win) where least < doc_id),
k as (select p.doc_id, count(r.i) as n_removed,
        coalesce(string_agg(p.words[p.i], ' ' order by p.i) filter (where r.i is null), '') as kept
      from p left join r on p.doc_id = r.doc_id and p.i = r.i group by p.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle(), "op7_substring_dedup": OP7}
