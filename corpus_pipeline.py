"""From raw documents to packed training sequences.

Each stage works on all documents that the one before it kept, and is written and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from quartzite.llm.common import discard, materialise
from quartzite.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weak labels of all documents train a scorer; the documents that it rejects go."""
    return quality.filter_quality(docs, quality.fit(docs))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8, the smallest id stays."""
    return jaccard_join.drop_similar(docs, words=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut from the texts."""
    clean = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts, placed in sequences."""
    return packing.pack(docs, tokenizer_path()).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed_sequences),
]

#: The stages can't be said in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
