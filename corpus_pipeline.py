"""The corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvaspark.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from sylvaspark.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 4)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lower-cased (operator 2)."""
    return exact_dedup.deduplicate(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: five-word shingles, Jaccard 0.8 (operator 1)."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mixture takes them (operator 9)."""
    return mixing.mix_sources(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): the token ids of every document of the mixture, and the hash of their decoded text (operator 5)."""
    return bpe.encode_and_decode(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("BPE encoding", tokenize),
]

#: The classifier has no SQL form, so the pipeline has none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
