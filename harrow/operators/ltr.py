"""Learning to rank: LambdaMART on Spark's distributed trees, and an interface for pair scorers.

Each round turns the current scores into gradients per query (bounded by a query's candidates),
fits one regression tree on them over all rows, and sets every leaf to its Newton step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators.lineage import cut

#: What a document that is no candidate scores.
MISSING = -1e6


def lambdas(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the pairwise logistic loss, pairs weighed by the change of NDCG; gains are ``2^label - 1``."""
    order = np.lexsort((np.arange(len(score)), -score))
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    gain, discount = 2.0**label - 1, 1 / np.log2(rank + 2)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2)).sum()
    if ideal == 0:
        return np.zeros(len(score)), np.zeros(len(score))
    out, curves = np.zeros(len(score)), np.zeros(len(score))
    # Only rows of different labels make a pair.  Rows of equal score and label meet others alike but for their discounts, which
    # differ with one sign between two scores: so scores meet, not rows, with counts and summed discounts of their rows.
    values, of = np.unique(score, return_inverse=True)
    levels = np.unique(label)
    for i, level in enumerate(levels):
        for lower in levels[:i]:
            up, low = np.flatnonzero(label == level), np.flatnonzero(label == lower)
            weight = (2.0**level - 2.0**lower) / ideal
            for here, sign, pull, curve in _sides(values, of, discount, up, low):
                out[here] += sign * weight * pull
                curves[here] += weight * curve
    return out, curves


def _sides(values: np.ndarray, of: np.ndarray, discount: np.ndarray, up: np.ndarray, low: np.ndarray, cells: int = 250_000):
    """For the upper rows, then the lower ones: rows, a sign, and the sums of both derivatives times the difference of discounts."""
    scores, rows = [], []
    for mine in (up, low):
        found, place = np.unique(of[mine], return_inverse=True)
        scores.append(found)
        rows.append((place, np.bincount(place), np.bincount(place, discount[mine])))
    sums = [np.zeros((4, len(x))) for x in scores]  # of either derivative: counts and discounts of the others
    step = max(1, cells // len(scores[1]))
    for at in range(0, len(scores[0]), step):
        own = slice(at, at + step)
        gap = values[scores[0][own], None] - values[scores[1]]
        p = 1 / (1 + np.exp(np.clip(gap, -30, 30)))
        for k, x in ((0, p * np.sign(gap)), (2, p * (1 - p) * np.sign(gap))):
            for j in (0, 1):
                sums[0][k + j][own] += x @ rows[1][1 + j]
                sums[1][k + j] += rows[0][1 + j][own] @ x
    for side, (mine, others) in enumerate(((up, low), (low, up))):
        place, turn = rows[side][0], 1 - 2 * side
        pull, curve = (turn * (sums[side][k][place] * discount[mine] - sums[side][k + 1][place]) for k in (0, 2))
        # Of equal scores either derivative is known, and discounts are summed up to each row's own.
        order = np.lexsort((discount[others], of[others]))
        upto, known = np.append(0, np.cumsum(discount[others][order])), of[others][order]
        first, last = np.searchsorted(known, of[mine], "left"), np.searchsorted(known, of[mine], "right")
        middle = _places(known, discount[others][order], of[mine], discount[mine])
        equal = discount[mine] * (2 * middle - first - last) - 2 * upto[middle] + upto[first] + upto[last]
        yield mine, turn, pull + equal / 2, curve + equal / 4


def _places(groups: np.ndarray, values: np.ndarray, group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many of the sorted ``(groups, values)`` come before each ``(group, value)``."""
    both = np.lexsort((np.append(values, value), np.append(groups, group)))
    before = np.cumsum(both < len(groups))
    place = np.empty(len(both), np.int64)
    place[both] = before
    return place[len(groups) :]


def _gradients(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", ignore_index=True)
    pdf["gradient"], pdf["curve"] = lambdas(pdf["prediction"].to_numpy(), pdf["label"].to_numpy())
    return pdf[["query_id", "doc_id", "gradient", "curve"]]


@dataclass
class LambdaMart:
    """A boosted ranker.  ``trees`` and ``rate`` trade fit for time; a tree is one Spark job of ``depth`` passes."""

    trees: int = 20
    depth: int = 5
    rate: float = 0.1
    min_rows: int = 15
    l2: float = 4.0
    row_share: float = 0.85
    seed: int = 42
    models: list[tuple[DecisionTreeRegressionModel, dict[float, float]]] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def fit(self, pairs: DataFrame, features: list[str]) -> LambdaMart:
        """``pairs`` has ``query_id``, ``doc_id``, ``label`` and the features, one row a query and document."""
        if "label" not in pairs.columns:
            raise ValueError("training pairs need labels")
        self.features, self.models = list(features), []
        now = self._assembled(pairs).select("query_id", "doc_id", F.col("label").cast("double").alias("label"), "x", F.lit(0.0).alias("prediction"))
        now = cut(now)
        for k in range(self.trees):
            grads = now.groupBy("query_id").applyInPandas(_gradients, "query_id long, doc_id long, gradient double, curve double")
            data = now.join(grads, ["query_id", "doc_id"]).persist()
            tree = DecisionTreeRegressor(featuresCol="x", labelCol="gradient", leafCol="leaf", predictionCol="fitted", maxDepth=self.depth, minInstancesPerNode=self.min_rows, seed=self.seed + k).fit(
                data.sample(self.row_share, seed=self.seed + k) if self.row_share < 1 else data
            )
            leaves = tree.transform(data).groupBy("leaf").agg(F.sum("gradient").alias("g"), F.sum("curve").alias("h")).collect()  # at most 2**depth rows
            self.models.append((tree, {float(r["leaf"]): self.rate * r["g"] / (r["h"] + self.l2) for r in leaves}))
            # The running score takes one tree a round, and each round starts from a written table.
            now = cut(self._add(data, len(self.models) - 1).select(*now.columns))
            data.unpersist()
        return self

    def _add(self, rows: DataFrame, k: int) -> DataFrame:
        """The step of tree ``k`` put to ``prediction``."""
        tree, steps = self.models[k]
        tree.setLeafCol("__leaf").setPredictionCol("__fitted")
        table = F.create_map(*[F.lit(v) for pair in steps.items() for v in pair])
        step = F.coalesce(F.element_at(table, F.col("__leaf")), F.lit(0.0))
        return tree.transform(rows).withColumn("prediction", F.col("prediction") + step).drop("__leaf", "__fitted")

    def _assembled(self, pairs: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="x", handleInvalid="error").transform(pairs)

    def _scored(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("prediction", F.lit(0.0))
        for k in range(len(self.models)):
            out = self._add(out, k)
        return out

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``(query_id, doc_id, score)`` of the pairs; ``rank.densify`` with ``MISSING`` scores all other documents."""
        if not self.models:
            raise ValueError("fit the ranker before predicting")
        return self._scored(self._assembled(pairs)).select("query_id", "doc_id", F.col("prediction").alias("score"))


def bagged(pairs: DataFrame, features: list[str], seeds: tuple[int, ...] = (42, 123), **settings) -> list[LambdaMart]:
    return [LambdaMart(seed=s, **settings).fit(pairs, features) for s in seeds]


def rescore(ranking: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[DataFrame], DataFrame], depth: int = 10) -> DataFrame:
    """A pair scorer on the ``depth`` best of a ranking only.

    ``scorer`` adds ``score`` to rows of query and document columns; ``recall_scorer`` stands in for
    a cross-encoder where no weights are at hand.
    """
    best = ranking.where(F.col("rank") <= depth).select("query_id", "doc_id")
    return scorer(best.join(queries, "query_id").join(docs, "doc_id")).select("query_id", "doc_id", "score")


def recall_scorer(query_text: str, doc_text: str) -> Callable[[DataFrame], DataFrame]:
    """The share of the query's distinct tokens in the document: a declared stand-in, not a language model."""

    def score(pairs: DataFrame) -> DataFrame:
        q, d = F.array_distinct(F.split(query_text, " ")), F.array_distinct(F.split(doc_text, " "))
        return pairs.withColumn("score", F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1)))

    return score
