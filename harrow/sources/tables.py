"""The retrieval tables, answers, and tables of earlier results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.text import normalize_text, parse_ids, title_of
from harrow.sources.feather import read_feather


@dataclass
class Catalog:
    """Articles, labelled queries and queries to answer, from a folder of Arrow IPC or Parquet files."""

    articles: DataFrame
    calibration: DataFrame
    test: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str, form: str = "feather") -> Catalog:
        ending = {"feather": "f", "parquet": "parquet"}[form]
        read = (lambda p: read_feather(spark, p)) if form == "feather" else spark.read.parquet
        return cls(*(read(f"{folder}/{name}.{ending}") for name in ("articles", "calibration", "test")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_answer(answer: DataFrame, path: str) -> None:
    """One CSV file with a header, ordered by query; answers are small by contract."""
    answer.orderBy("query_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id long, answer string").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, approaches: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """A CSV of results, by approach names or a regular expression; the filters reach the scan."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if approaches is not None:
        rows = rows.where(F.col("approach").isin(approaches))
    return rows if pattern is None else rows.where(F.col("approach").rlike(pattern))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def documents_as_articles(docs: DataFrame) -> DataFrame:
    """Documents in the shape of prepared articles: the first eight tokens stand for the title."""
    clean = docs.select("doc_id", "source", normalize_text(F.col("text"), entities=False).alias("body_clean"))
    return clean.withColumns({"title_clean": title_of(F.col("body_clean")), "body_length": F.length("body_clean")})


__all__ = ["Catalog", "documents_as_articles", "parse_ids", "read_answer", "read_results", "read_summary", "table", "write_answer"]
