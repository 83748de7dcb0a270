"""Embedding near-deduplication with a pivot-permutation index.

A bounded sample of the vectors serves as reference points.  A vector is described by its nearest
reference points in order, and stands in the inverted list of each, list by list within a label.
Two vectors of a list are candidates if they share enough reference points; each such pair is taken
up once, in the list of the first point they share, and verified by cosine in double precision.

Reference points lie at least ``COVER`` apart, so a dense group has few of its own.  A vector within
``COVER`` of a point is covered: whatever links with it lies within ``COVER`` and the link's angle of
that point, by the triangle inequality.  So every vector stands in the lists of all points that near,
covered ones in no others, and all pairs with a covered vector are verified: none of their links is lost.

There are at most about ``4 * sqrt(vectors)`` points, so lists grow much slower than the table.  A list of
more than ``LIST_ROWS`` rows is dealt into cells of two parts each, which bounds what a task holds
however many near copies one vector has.  Tasks return degrees and the links of a forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import scratch
from harrow.llm.components import components, named
from harrow.llm.simhash import Forest

MAX_PIVOTS, LIST_ROWS, TILE = 16_384, 2048, 512
#: Reference points are further apart than this angle (a cosine of 0.85).
COVER = float(np.arccos(0.85))


def _usable(vector: str, label: str, id_col: str):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _apart(points: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` rows that are further than ``COVER`` from every row taken before."""
    free, taken = np.ones(len(points), dtype=bool), []
    while len(taken) < n and free.any():
        taken.append(int(np.argmax(free)))
        free &= points @ points[taken[-1]] < np.cos(COVER)
        free[taken[-1]] = False
    return points[taken]


def pivots(unique: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Unit reference points by dimension: at most ``n`` of the vectors with the smallest hash, which are at most ``MAX_PIVOTS``."""
    by_size: dict[int, list] = {}
    for r in unique.orderBy(F.xxhash64("label", "v"), "node").select("v").limit(min(2 * n, MAX_PIVOTS)).collect():
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    return {d: _apart(_unit(np.array(v, dtype=float)), n) for d, v in by_size.items()}


def describe(unique: DataFrame, points: dict[int, np.ndarray], nearest: int, least: float) -> DataFrame:
    """Add ``perm``, the ids of the reference points in whose lists a row stands, nearest first, and ``covered``.

    Those are the points within reach of a link, and for rows that are not covered the ``nearest`` at
    least; a dimension without any point has one list.
    """
    # Slightly wide, so that rounding loses nothing.
    reach = np.cos(min(np.pi, COVER + np.arccos(np.clip(least, -1, 1)))) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            perm: list[list[int]] = [[-1]] * len(vectors)
            covered = [False] * len(vectors)
            for d, known in points.items():
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                for s in range(0, len(at), 1000):
                    near = _unit(np.array([vectors[i] for i in at[s : s + 1000]], dtype=float)) @ known.T
                    order, within, close = np.argsort(-near, axis=1, kind="stable"), (near >= reach).sum(axis=1), near.max(axis=1) >= np.cos(COVER)
                    for i, p, k, c in zip(at[s : s + 1000], order, within.tolist(), close.tolist(), strict=True):
                        perm[i], covered[i] = p[: k if c else max(k, nearest)].tolist(), c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perm, pa.list_(pa.int32())), pa.array(covered, pa.bool_())], names=[*batch.schema.names, "perm", "covered"])

    rows = unique.select("label", "v", "node", "copies")
    return rows.mapInArrow(run, f"label string, v {unique.schema['v'].dataType.simpleString()}, node long, copies long, perm array<int>, covered boolean")


class _Found:
    def __init__(self) -> None:
        self.forest, self.degree = Forest(), {}

    def add(self, pivot: int, cross: bool, rows: list[tuple], least: float, shared: int) -> None:
        """Verify one cell: all pairs of its rows, or only those of its two parts."""
        for d in {len(r[1]) for r in rows}:
            own = [r for r in rows if len(r[1]) == d]
            v, node, copies = _unit(np.array([r[1] for r in own], dtype=float)), [r[0] for r in own], [r[2] for r in own]
            width = max(len(r[3]) for r in own)
            perm = np.array([r[3] + [-2 - i] * (width - len(r[3])) for i, r in enumerate(own)])
            part, covered = np.array([r[4] for r in own]), np.array([r[5] for r in own])
            node, copies, degree, root = np.array(node), np.array(copies), np.zeros(len(own), dtype=np.int64), np.arange(len(own))
            step = max(1, 5_000_000 // width**2)
            for a in range(0, len(own), TILE):
                for b in range(a, len(own), TILE):
                    near = v[a : a + TILE] @ v[b : b + TILE].T >= least
                    x, y = np.nonzero(np.triu(near, 1) if a == b else near)
                    x, y = x + a, y + b
                    if cross:
                        x, y = x[part[x] != part[y]], y[part[x] != part[y]]
                    for s in range(0, len(x), step):
                        ok = self._ours(x[s : s + step], y[s : s + step], perm, covered, pivot, shared, node)
                        i, j = x[s : s + step][ok], y[s : s + step][ok]
                        degree += np.bincount(i, copies[j], len(own)).astype(np.int64) + np.bincount(j, copies[i], len(own)).astype(np.int64)
                        self._join(i, j, root, node)
            at = np.flatnonzero(degree)
            for k, n in zip(node[at].tolist(), degree[at].tolist(), strict=True):
                self.degree[k] = self.degree.get(k, 0) + n

    def _join(self, i: np.ndarray, j: np.ndarray, root: np.ndarray, node: np.ndarray) -> None:
        """Join the pairs' rows; ``root`` tells which rows of the cell are joined already, so that few pairs of a dense cell are looked at."""
        while len(i):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            # One pair for each row, then the roots are brought up to date.
            _, first = np.unique(i, return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                self.forest.join(int(node[a]), int(node[b]))
                low, high = sorted((root[a], root[b]))
                if low != high:
                    root[root == high] = low

    def _ours(self, x, y, perm, covered, pivot, shared, node) -> np.ndarray:
        """Which pairs are candidates and meet first in this list."""
        same = (perm[x][:, :, None] == perm[y][:, None, :]).any(axis=2)
        enough = np.where(covered[x] | covered[y], 1, min(shared, perm.shape[1]))
        first = perm[x, np.argmax(same, axis=1)]
        # The first shared point in the order of the smaller node, which both lists agree on.
        swap = node[x] > node[y]
        other = (perm[y][:, :, None] == perm[x][:, None, :]).any(axis=2)
        first = np.where(swap, perm[y, np.argmax(other, axis=1)], first)
        return (same.sum(axis=1) >= enough) & (first == pivot)

    def rows(self) -> Iterator[pa.RecordBatch]:
        out = [(a, b, None) for a, b in self.forest.links] + [(k, None, n) for k, n in self.degree.items()]
        self.forest.links.clear()
        self.degree.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n"])


def _verify(least: float, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, key, held = _Found(), None, []
        for batch in batches:
            for label, pivot, low, high, node, v, copies, perm, part, covered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, pivot, low, high) != key:
                    if len(held) > 1:
                        found.add(key[1], key[2] != key[3], held, least, shared)
                    key, held = (label, pivot, low, high), []
                held.append((node, v, copies, perm, part, covered))
            if len(found.degree) > 200_000:
                yield from found.rows()
        if len(held) > 1:
            found.add(key[1], key[2] != key[3], held, least, shared)
        yield from found.rows()

    return run


def group_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
    nearest: int = 8,
    shared: int = 2,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row; vectors compare within a label and dimension only.

    Vectors that are null, zero or hold null or non-finite components, and rows without label or id,
    link with nothing: no links, their own component, kept.  Equal vectors are found by grouping, so
    a group of copies is one entry of the index; ``n_links`` counts its members.  Ids must be whole numbers.
    Vectors of floats travel as such; every product is taken in double precision.
    """
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("v", F.when(_usable("v", "label", "id"), F.col("v")))
    # A vector of a label is a node of its own; its number is fixed as the table is written.
    unique = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    unique = scratch.materialize(unique, "vectors")
    n = unique.count()
    points = pivots(unique, max(16, int(4 * n**0.5)))
    entries = scratch.materialize(describe(unique.drop("least"), points, nearest, least), "vectors")
    posted = entries.withColumn("pivot", F.explode("perm"))
    sizes = entries.select("label", F.explode("perm").alias("pivot")).groupBy("label", "pivot").agg(F.ceil(F.count("*") / F.lit(LIST_ROWS)).cast("int").alias("parts"))
    # Written, so that by its size it is broadcast where it is small and the vectors are not shuffled to meet it.
    sizes = scratch.materialize(sizes, "vectors")
    posted = posted.join(sizes, ["label", "pivot"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = posted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("label", "pivot", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "node", "v", "copies", "perm", "part", "covered")
    keys = ["label", "pivot", "low", "high"]
    found = scratch.materialize(cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(least, shared), "a long, b long, n long"), "vectors")
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    degrees = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    known = named(unique, groups).join(degrees, "node", "left").select("label", "v", "copies", "degree", "component")
    return rows.join(known, ["label", "v"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce(F.coalesce("degree", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"),
    )
