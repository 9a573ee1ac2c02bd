"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, as a stored table, and all but the last return the columns of
`documents`. Filters keep the rows they don't reject as they are.
"""

from __future__ import annotations

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, exact_dedup, minhash, packing, toxicity
from tidegauge.llm.common import run_folder, stored

SIMILAR = (80, 100)  # near copies share this much of their shingles, at least; op1_minhash has a contract of its own


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled ones of the documents this stage gets."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs, similar=SIMILAR)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

# the classifier, the similarity search and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is stored in the shared folder before the next one reads it."""
    docs, folder = _table(spark, sf_dir, "documents"), run_folder(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
