"""A training-corpus pipeline of five operators, each a stage that reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import byte_pairs, decontaminate, jaccard, secrets, toxicity
from claimweave.llm._common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject.

    Null and empty texts have no words and stay, as null or empty; repeated rows share their fate; a table without
    documents, or without labels of both classes, loses nothing.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, that of the least doc_id.

    Null, empty and blank texts link with nothing and all stay; of fully repeated rows one stays; a null doc_id
    is kept only where its component has no other.
    """
    return jaccard.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window.

    Null and empty texts have no words and stay as they are; repeated rows share their fate; an empty benchmark drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    others = [c for c in COLUMNS if c != "text"]
    return decontaminate.matches(docs, benchmark, keep=others).where("size(spans) = 0").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; n_chars follows the text.

    Null texts stay null, with a null n_chars; overlapping secrets become one mark; repeated rows stay.
    """
    from pyspark.sql import functions as F

    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes, and token_ids of each document.

    Null and empty texts have no ids; repeated rows stay; words and texts of any length are encoded whole.
    """
    return byte_pairs.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, texts=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_pairs", encode),
]

#: The models and tokenizers of the first and last stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
