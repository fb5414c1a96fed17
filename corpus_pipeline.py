"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it back as the next stage's docs. All stages but the last return the columns of documents, and each keeps what
its operator's module says of odd rows: a null or empty text fails the quality rules; a null doc_id is in no group of near
copies and stays; rows that repeat a doc_id are documents of their own, but equal texts are copies of each other; other
columns pass through to the last stage; an empty table runs through to no pieces.

The key of the pseudonyms is the session's spark.xsfactor.pii.key; only where it is unset, as in tests, the public
DEMO_KEY stands in, with which anyone could take pseudonyms back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xsfactor.llm import jaccard_join, packing, pii, quality_rules, toxicity
from xsfactor.llm.common import durable, table
from xsfactor.llm.pii import DEMO_KEY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that aren't rejected."""
    return quality_rules.kept_documents(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model of the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.clean_documents(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, p=80, q=100)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars, where there is one, counts the new text."""
    out = pii.pseudonymise(docs, spark.conf.get("spark.xsfactor.pii.key", DEMO_KEY))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", keep_clean),
    ("ngram_jaccard_join", keep_distinct),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: Models and tokenisers have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
