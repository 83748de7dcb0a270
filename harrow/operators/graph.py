"""Co-occurrence and link graphs over documents, and scores passed along them.  Edges: ``(src_id, dst_id, weight)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cooccurrence(labels: DataFrame) -> DataFrame:
    """How many queries name two different documents, both ways."""
    other = labels.select("query_id", F.col("doc_id").alias("dst_id"))
    pairs = labels.select("query_id", F.col("doc_id").alias("src_id")).join(other, "query_id").where("src_id <> dst_id")
    return pairs.groupBy("src_id", "dst_id").agg(F.count("*").cast("double").alias("weight"))


def normalise_in(edges: DataFrame) -> DataFrame:
    """Weights over the sum of the target's incoming ones, 1 at least."""
    total = edges.groupBy("dst_id").agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("total"))
    return edges.join(total, "dst_id").select("src_id", "dst_id", (F.col("weight") / F.col("total")).alias("weight"))


def link_graph(articles: DataFrame, id_col: str, links_col: str) -> DataFrame:
    """Edges to known other articles, each once, in-degree normalised."""
    edges = articles.select(F.col(id_col).alias("src_id"), F.explode(links_col).alias("dst_id")).where("src_id <> dst_id").distinct()
    known = articles.select(F.col(id_col).alias("dst_id")).distinct()
    return normalise_in(edges.join(known, "dst_id").withColumn("weight", F.lit(1.0)))


def propagate(scores: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """``scores + factor * (scores x edges)``."""
    moved = scores.join(edges, scores["doc_id"] == edges["src_id"]).groupBy("query_id", F.col("dst_id").alias("doc_id")).agg((factor * F.sum(F.col("score") * F.col("weight"))).alias("score"))
    return scores.select("query_id", "doc_id", "score").unionByName(moved).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def cooccurrence_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    return propagate(scores, cooccurrence(labels).withColumn("weight", F.log1p("weight")), 0.01)


def link_scores(scores: DataFrame, links: DataFrame) -> DataFrame:
    return propagate(scores, links, 0.05)
