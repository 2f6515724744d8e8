"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept,
and returns the columns of ``docs``, whatever they are called; the last one returns packed
token pieces. Empty tables give empty tables. Null doc_id is an id like others, smaller than
all of them; null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastemill.llm import decontamination, exact_dedup, ngram_join, packing, quality
from tastemill.llm._jobs import written

#: No SQL can state the classifier's and the tokenizer's rows; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below 0.5 under a field fitted on the labelled rows of ``docs``.

    Null, empty and blank texts score the share of good documents; repeated rows are judged one by one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays, then the smallest doc_id.

    Null, empty and blank texts are one group; of rows that repeat both id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word shingle similarity of 0.8, that with the smallest id stays.

    Texts without words are linked with nothing; rows that repeat an id stay or go together.
    """
    return ngram_join.drop_similar(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, by four fifths of its five-word shingles; null items are no items."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed without padding; null and empty texts are the end id alone, repeated rows are packed once each."""
    return packing.digest(packing.pack(docs, packing.tokenizer_text()))


STAGES = [
    ("quality", good_quality),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("leaks", without_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
