"""Corpus pipeline: quality, exact duplicates, near duplicates, repeated passages, packing.

Each stage takes what the one before kept, written as Parquet; all but the last return the columns
of ``documents``.  No SQL expresses the stages; ``tests/llm`` holds each against brute force.

Null, empty and very long texts, repeated rows, null ids and empty tables go through every stage; what
each makes of them is said with its operator.  A null or empty text is scored like any other, is a copy of any
other empty text, and near nothing.  Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import exact_dedup, packing, quality, scratch, simhash, substring

#: Near duplicates: five-word shingles in 256 bits.  A Jaccard similarity of 0.8 is some 39 bits apart, give or
#: take 6, so the radius of 44 takes in nearly all of those pairs.  Pairs meet if they differ by at most 2 bits in
#: one of twelve blocks of 20 bits; tests/llm measures how many pairs of 0.8 or more are found.
SHINGLE, LANES, RADIUS = 5, 4, 44
BLOCKS, REACH = [(start, 20) for start in range(0, 12 * 21, 21)], 2


def _alone(spark: SparkSession, stage: str):
    """Tables written within belong to ``stage``; those of the stages before, which have been written by now, go."""
    for name, _ in STAGES[: [name for name, _ in STAGES].index(stage)]:
        scratch.release(spark, f"pipeline {name}")
    return scratch.owner(f"pipeline {stage}")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.3 or more."""
    with _alone(spark, "quality"):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
        return quality.keep(docs, quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels), threshold=0.3)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    with _alone(spark, "exact"):
        return exact_dedup.drop_exact(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    with _alone(spark, "near"):
        return simhash.drop_near(docs, shingle=SHINGLE, radius=RADIUS, lanes=LANES, blocks=BLOCKS, reach=REACH, link_empty=False)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller id has too."""
    with _alone(spark, "substring"):
        return substring.drop_repeats(docs, window=13)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, each in the corpus's mixture of sources."""
    import public_tokenizers

    with _alone(spark, "packing"):
        return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before the last kept is deleted once the next has been written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, fresh = scratch.write(stage(spark, docs, sf_dir), "pipeline")
        if path is not None:
            scratch.delete(spark, path)
        path = fresh
    return STAGES[-1][1](spark, docs, sf_dir)
