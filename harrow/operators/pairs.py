"""Candidate pairs of queries and documents with their ranking features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import tokens
from harrow.operators.rank import reciprocal_rank, top_k, z_moments

# How deep a source is taken for candidates, and the rank thresholds that are counted.
STATIC_DEPTH, QUERY_DEPTH = 20, 30
THRESHOLDS = (0.1, 0.05)


def candidates(scores: DataFrame, static_sources: list[str], seen: DataFrame, queries: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id)``: the best of every source, every seen document, and in training the true ones.

    ``scores`` is ``(query_id, doc_id, source, score)``; ``seen(doc_id)`` are the documents with a label.
    """
    static = F.col("source").isin(*static_sources) if static_sources else F.lit(False)
    depth = F.when(static, STATIC_DEPTH).otherwise(QUERY_DEPTH)
    best = top_k(scores, max(STATIC_DEPTH, QUERY_DEPTH), ("query_id", "source")).where(F.col("rank") <= depth).select("query_id", "doc_id")
    out = best.unionByName(queries.select("query_id").distinct().crossJoin(seen.select("doc_id").distinct()))
    if labels is not None:
        out = out.unionByName(labels.join(queries.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id"))
    return out.distinct()


def token_recall(queries: DataFrame, docs: DataFrame, query_text: str, doc_text: str) -> DataFrame:
    """``(query_id, doc_id, score)``: the share of a query's distinct tokens that a document has, pairs with none left out."""
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    d = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col(doc_text)))).alias("term"))
    size = q.groupBy("query_id").agg(F.count("*").alias("n"))
    common = q.join(d, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    return common.join(size, "query_id").select("query_id", "doc_id", (F.col("c") / F.greatest("n", F.lit(1))).alias("score"))


def metadata(pairs: DataFrame, queries: DataFrame, docs: DataFrame, query_text: str = "query_clean", title: str = "title_clean", body: str = "body_clean") -> DataFrame:
    """Add token recalls and logarithms of lengths to ``pairs(query_id, doc_id, ...)``; nothing is tiled over all pairs."""
    q = queries.select("query_id", F.log1p(F.length(query_text)).alias("query_length"), F.log1p(F.size(tokens(F.col(query_text)))).alias("query_tokens"))
    d = docs.select("doc_id", F.log1p(F.length(title)).alias("title_length"), F.log1p(F.length(body)).alias("body_length"))
    out = pairs
    for name, text in (("title_token_recall", title), ("body_token_recall", body)):
        recall = token_recall(queries, docs, query_text, text).withColumnRenamed("score", name)
        out = out.join(recall, ["query_id", "doc_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out.join(d, "doc_id").join(q, "query_id")


def pair_features(pairs: DataFrame, scores: DataFrame, sources: dict[str, float], n_docs: int) -> DataFrame:
    """Each pair's score, reciprocal rank and z-score by source, and a summary of its ranks.

    ``sources`` maps names to fills.  Features are ``<source>``, ``<source>_rr`` and ``<source>_z``; the
    summary is mean, greatest, population deviation and how many ranks reach each threshold.
    """
    by = ("query_id", "source")
    names = list(sources)
    scores = scores.where(F.col("source").isin(names))
    fill = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(sources[n]))]), F.col("source"))
    # Of all scores only moments and the best ranks are taken; what is joined and pivoted are the pairs' own.
    moments = z_moments(scores, n_docs, fill, by)
    ranks = reciprocal_rank(scores, 100, 10, by).withColumnRenamed("score", "rr")
    own = scores.join(pairs.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    long = own.join(ranks.select("query_id", "doc_id", "source", "rr"), ["query_id", "doc_id", "source"], "left").withColumn("rr", F.coalesce("rr", F.lit(0.0)))
    long = long.join(moments, list(by)).withColumn("z", (F.col("score") - F.col("mean")) / F.col("spread"))
    # A source may hold no row of a pair, but some of the query: its z-score of the fill is the query's.
    fills = moments.select("query_id", "source", "z_fill")
    wide = pairs.join(
        long.groupBy("query_id", "doc_id").pivot("source", names).agg(F.first("score").alias("s"), F.first("rr").alias("rr"), F.first("z").alias("z")), ["query_id", "doc_id"], "left"
    ).join(fills.groupBy("query_id").pivot("source", names).agg(F.first("z_fill")).select("query_id", *(F.col(f"`{n}`").alias(f"{n}__fill") for n in names)), "query_id", "left")
    out = wide.select(
        *pairs.columns,
        *(F.coalesce(f"`{n}_s`", F.lit(float(sources[n]))).alias(n) for n in names),
        *(F.coalesce(f"`{n}_rr`", F.lit(0.0)).alias(f"{n}_rr") for n in names),
        *(F.coalesce(f"`{n}_z`", f"`{n}__fill`", F.lit(0.0)).alias(f"{n}_z") for n in names),
    )
    rr = F.array(*(F.col(f"`{n}_rr`") for n in names))
    mean = F.aggregate(rr, F.lit(0.0), lambda a, x: a + x) / len(names)
    out = out.withColumn("rank_mean", mean).withColumn("rank_max", F.array_max(rr))
    out = out.withColumn("rank_std", F.sqrt(F.aggregate(rr, F.lit(0.0), lambda a, x: a + (x - F.col("rank_mean")) * (x - F.col("rank_mean"))) / len(names)))
    reach = lambda t: F.size(F.filter(rr, lambda x: x >= t))
    return out.withColumns({f"ranks_at_{str(t).replace('.', '')}": reach(t) for t in THRESHOLDS})
