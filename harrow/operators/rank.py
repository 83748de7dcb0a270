"""Ranks from scores, and fusion of rankings.  Ties go to the smaller document id everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query with ``rank`` from 1; Spark drops the rest before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(_order(list(by)))).where(F.col("rank") <= k)


def reciprocal_rank(scores: DataFrame, depth: int = 100, offset: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``score`` replaced by ``1 / (rank + offset)`` of the ``depth`` best; the others' is 0 and not stored."""
    return top_k(scores, depth, by).withColumn("score", 1 / (F.col("rank") + offset)).drop("rank")


def rank_power(scores: DataFrame, power: float, depth: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``score`` replaced by ``((depth - rank + 1) / depth) ** power`` of the ``depth`` best."""
    return top_k(scores, depth, by).withColumn("score", F.pow((depth - F.col("rank") + 1) / F.lit(float(depth)), F.lit(float(power)))).drop("rank")


def blend(parts: list[tuple[float, DataFrame]]) -> DataFrame:
    """The weighted sum of score tables; a document that one lacks has 0 there."""
    out = None
    for weight, scores in parts:
        one = scores.select("query_id", "doc_id", (F.col("score") * weight).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def blend_base(models: list[DataFrame], semantic: DataFrame) -> DataFrame:
    """0.8 of two rankers' mean reciprocal ranks (offset 5) and 0.2 of the semantic source's (offset 10)."""
    if len(models) != 2:
        raise ValueError("the base blend takes exactly two rankers")
    return blend([*((0.4, reciprocal_rank(m, 100, 5)) for m in models), (0.2, reciprocal_rank(semantic, 100, 10))])


def blend_final(base: DataFrame, boosted: DataFrame, cross: DataFrame) -> DataFrame:
    """Power blend of the base, the second booster and the pair scorer, ten deep."""
    return blend([(0.85, rank_power(base, 0.5)), (0.12, rank_power(boosted, 1.5)), (0.03, rank_power(cross, 1.0))])


def densify(scores: DataFrame, queries: DataFrame, docs: DataFrame, fill: float) -> DataFrame:
    """Every query with every document; missing scores are ``fill``.  For document tables of known small size."""
    pairs = queries.select("query_id").crossJoin(docs.select("doc_id"))
    return pairs.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(float(fill))).alias("score"))


def z_moments(scores: DataFrame, n_docs: Column | int, fill: Column | float = 0.0, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``(*by, mean, spread, z_fill)``: one row a query, what ``z_scores`` takes scores by."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    rest, fill_c = n - F.count("*"), fill if isinstance(fill, Column) else F.lit(float(fill))
    moments = scores.groupBy(*by).agg(((F.sum("score") + fill_c * rest) / n).alias("__mean"), F.count("*").alias("__present"), F.var_pop("score").alias("__var"), F.avg("score").alias("__own"))
    share = F.col("__present") / n
    # The variance of two groups: within the present rows, and between them and the fill.
    spread = F.sqrt(share * F.col("__var") + share * (1 - share) * F.pow(F.col("__own") - fill_c, 2)) + 1e-6
    named = moments.withColumn("__spread", spread)
    return named.select(*by, F.col("__mean").alias("mean"), F.col("__spread").alias("spread"), ((fill_c - F.col("__mean")) / F.col("__spread")).alias("z_fill"))


def z_scores(scores: DataFrame, n_docs: Column | int, fill: Column | float = 0.0, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Scores less the query's mean over its population standard deviation plus 1e-6.

    The moments count the ``n_docs`` documents of the table, those without a row at ``fill``, so
    nothing is densified; rows without a score have the z-score of ``fill``, which ``z_fill`` gives.
    A fill that is a column may use the columns of ``by`` alone.
    """
    joined = scores.join(z_moments(scores, n_docs, fill, by), list(by))
    return joined.select(*scores.columns, ((F.col("score") - F.col("mean")) / F.col("spread")).alias("z"), "z_fill")
