"""The corpus pipeline: five stages over documents, each one of the library's operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of documents. Null and empty texts, null ids and repeated rows pass
through each stage as the operator it calls says; an empty table gives an empty one; texts are
worked on whole. Columns beside doc_id and text are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorecover.llm import bpe, decontamination, near_copies, pii, toxicity
from shorecover.llm.tables import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold, by a model of a bounded sample of the labelled rows; a null text counts as empty."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (a SimHash similarity of 0.8 or more): that of the smallest id; rows with a null id stay."""
    return near_copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item; a row with a null id is judged by its own text."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hash of the ids of each text, a row for each row; a null text counts as empty."""
    import public_tokenizers

    spec = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(docs, spec).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact_pii), ("bpe", encode)]

#: SQL can't express the toxicity model; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
