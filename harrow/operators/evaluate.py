"""Labels, folds, rankings by popularity, MAP@10, answers and their validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import join_ids, parse_ids
from harrow.operators.rank import top_k


def parse_labels(queries: DataFrame, id_col: str, truth_col: str, docs: DataFrame | None = None, doc_col: str = "doc_id") -> DataFrame:
    """Distinct ``(query_id, doc_id)`` from ids joined by spaces; with ``docs`` an unknown id raises."""
    labels = queries.select(F.col(id_col).alias("query_id"), F.explode(parse_ids(F.col(truth_col))).alias("doc_id")).distinct()
    if docs is None:
        return labels
    known = docs.select(F.col(doc_col).alias("doc_id"), F.lit(True).alias("__known")).distinct()
    checked = labels.join(known, "doc_id", "left")
    message = F.concat(F.lit("unknown document "), F.col("doc_id").cast("string"))
    return checked.where(F.when(F.col("__known").isNull(), F.raise_error(message).cast("boolean")).otherwise(True)).select("query_id", "doc_id")


def label_counts(labels: DataFrame) -> DataFrame:
    """``(doc_id, n)``: how many queries name a document."""
    return labels.groupBy("doc_id").agg(F.count("*").alias("n"))


def popularity_ranking(labels: DataFrame, docs: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """The k documents of ``docs(doc_id)`` that most labels name, ties by id; unnamed ones count 0."""
    counts = labels.groupBy(*by, "doc_id").agg(F.count("*").alias("score"))
    if by:
        keys = labels.select(*by).distinct()
        every = keys.crossJoin(docs.select("doc_id")) if docs is not None else keys
        full = every.join(counts, [*by, "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
        return top_k(full, k, by)
    full = docs.select("doc_id").join(counts, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    best = full.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # over k rows


def fold_of(key: Column, folds: int = 5) -> Column:
    return F.pmod(key, F.lit(folds))


def shuffled_folds(positions: DataFrame, n: int, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` to rows with ``query_pos`` 0 to n-1 as a seeded shuffled k-fold split gives it: consecutive slices of the shuffled positions."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    sizes = [n // folds + (i < n % folds) for i in range(folds)]
    fold = np.repeat(np.arange(folds), sizes)
    table = positions.sparkSession.createDataFrame([(int(p), int(f)) for p, f in zip(order, fold, strict=True)], "query_pos long, fold int")
    return positions.join(table, "query_pos")


def average_precision(ranking: DataFrame, labels: DataFrame, queries: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``(query_id, n_relevant, ap)`` of rankings ``(query_id, doc_id, rank)``.

    The sum of precisions at the relevant ranks over ``min(relevant, k)``; a query without relevant
    documents has 0.  ``queries`` names the queries to report; without it those that have labels.
    """
    relevant = labels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranking.where(F.col("rank") <= k).join(labels.withColumn("hit", F.lit(1)), ["query_id", "doc_id"])
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = hits.withColumn("precision", nth / F.col("rank")).groupBy("query_id").agg(F.sum("precision").alias("sum"))
    base = relevant if queries is None else queries.select("query_id").distinct().join(relevant, "query_id", "left")
    n = F.coalesce("n_relevant", F.lit(0))
    return base.join(found, "query_id", "left").select("query_id", n.alias("n_relevant"), (F.coalesce("sum", F.lit(0.0)) / F.greatest(F.least(n, F.lit(k)), F.lit(1))).alias("ap"))


def map_at_k(ranking: DataFrame, labels: DataFrame, queries: DataFrame | None = None, k: int = 10) -> DataFrame:
    """One row ``(n_queries, map)``."""
    return average_precision(ranking, labels, queries, k).agg(F.count("*").alias("n_queries"), F.avg("ap").alias("map"))


def ap_by_label_count(ap: DataFrame) -> DataFrame:
    return ap.groupBy("n_relevant").agg(F.count("*").alias("n_queries"), F.round(F.avg("ap"), 3).alias("mean_ap"))


def make_answer(ranking: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, answer)``: each query's k documents in order, joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return ranking.where(F.col("rank") <= k).groupBy("query_id").agg(join_ids(F.transform(ordered, lambda x: x["doc_id"])).alias("answer"))


def constant_answer(queries: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """The same ranking for every query."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    one = ranking.where(F.col("rank") <= k).agg(join_ids(F.transform(ordered, lambda x: x["doc_id"])).alias("answer"))
    return queries.select("query_id").crossJoin(F.broadcast(one))


def answer_errors(answer: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``(check, n)``: how many rows break each rule; all zero for a valid answer.

    Rules: the same queries, once each, in both tables; exactly ``k`` ids; no id twice; only known ids.
    """
    ids = answer.select("query_id", parse_ids(F.col("answer")).alias("ids"))
    both = answer.groupBy("query_id").agg(F.count("*").alias("a")).join(queries.groupBy("query_id").agg(F.count("*").alias("q")), "query_id", "full_outer")
    known = docs.select("doc_id").distinct()
    unknown = ids.select("query_id", F.explode("ids").alias("doc_id")).join(known, "doc_id", "left_anti").select("query_id").distinct()
    count = lambda df, name, cond: df.agg(F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("check"), "n")
    return (
        count(both, "queries", ~F.col("a").eqNullSafe(F.col("q")))
        .unionByName(count(ids, "length", F.size("ids") != k))
        .unionByName(count(ids, "repeated", F.size("ids") != F.size(F.array_distinct("ids"))))
        .unionByName(count(unknown, "unknown", F.lit(True)))
    )


def validate_answer(answer: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> None:
    """Raise ValueError naming the first rule that the answer breaks, column names and query order included."""
    if answer.columns != ["query_id", "answer"]:
        raise ValueError(f"columns are {answer.columns}, not query_id and answer")
    for row in answer_errors(answer, queries, docs, k).collect():  # four rows
        if row["n"]:
            raise ValueError(f"{row['n']} rows break the rule '{row['check']}'")


def validate_order(answer: DataFrame, queries: DataFrame) -> None:
    """Raise if the written order, carried by ``query_pos`` in both tables, differs."""
    moved = answer.select("query_id", F.col("query_pos").alias("a")).join(queries.select("query_id", F.col("query_pos").alias("q")), "query_id").where("a <> q").limit(1).count()
    if moved:
        raise ValueError("the answer's queries are not in the order of the query table")


def describe(values: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (interpolated) and greatest of one column."""
    c = F.col(column).cast("double")
    return values.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        *(F.percentile(c, p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)), F.max(c).alias("max"),
    )
