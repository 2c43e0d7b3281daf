"""A training corpus from raw documents: five stages, each the work of one operator.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it as the next stage's documents. All
stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linelift.llm import (decontaminate, exact_dedup, jaccard_join, packing, quality)
from linelift.llm.common import materialize, read_table
from linelift.llm.queries import tokenizer_path

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 3), fitted on the labels, accepts."""
    weights = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.scores(docs, weights, keep_above=QUALITY_THRESHOLD, column="_quality_score")
    return scored.select(*docs.columns)


def exact_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 7)."""
    return exact_dedup.keep_one(docs)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links (operator 1)."""
    return jaccard_join.keep_one(docs, k=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy or edited copy of a benchmark item (operator 9)."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences of 2048 ids (operator 10)."""
    return packing.pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_unique),
    ("near_dedup", near_unique),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# The classifier, the alignment and the vocabulary cannot be written in SQL; the tests hold
# the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the rows of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
