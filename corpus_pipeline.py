"""A corpus pipeline: toxic documents go, copies go, near copies go, contaminated documents go, the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of documents. Stages are written to the shared folder between each other, so that a lost executor
costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symweave.llm import common, decontaminate, exact_dedup, simhash, spm, toxicity

#: Fingerprints of near copies differ in at most so many bits; more bits catch looser copies and cost many more candidates.
NEAR_BITS = 4


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal texts."""
    return simhash.drop_near_copies(docs, k=NEAR_BITS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with their count and whether they decode to the text."""
    return spm.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", tokenise_stage),
]

#: SQL cannot express the learned and iterative stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"stage-{i}-{name}")
    return docs
