"""Quality classifier by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is trained on good and one on bad labelled texts.  A text is compressed
with both, in blocks so that a long text cannot teach the compressor its own style, and the
difference of the two sizes over their sum is the evidence.  A logistic curve, fitted on labelled
rows that the dictionaries have not seen, turns it into a score from 0 to 1.

Fitting uses a bounded sample of labelled rows, whole: at most ``dictionary_rows`` per class for the
dictionaries and ``calibration_rows`` per class for the curve, the ids with the smallest hash first,
and of each class no more rows than ``sample_bytes`` hold (documented bounds).  Scoring reads every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm import scratch

BLOCK = 2048


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    bias: float
    slope: float
    level: int = 3

    def __post_init__(self) -> None:
        self._tools = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._tools is None:
            options = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._tools = [zstandard.ZstdCompressor(dict_data=_prepared(d, self.level), **options) for d in (self.good, self.bad)]
        return self._tools

    def evidence(self, text: bytes) -> float:
        """Positive when the good dictionary fits better; 0 for an empty text."""
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.compressors())
        return (bad - good) / max(good + bad, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.evidence(t) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * x, -30, 30)))


def _prepared(content: bytes, level: int) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(content)
    if content:
        d.precompute_compress(level=level)
    return d


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too few samples the texts themselves serve as one."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge; the classes weigh as they occur."""
    scale = x.std() or 1.0
    z = np.c_[np.ones_like(x), x / scale]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    dictionary_rows: int = 1500,
    calibration_rows: int = 1000,
    sample_bytes: int = 32_000_000,
    dictionary_bytes: int = 112_640,
) -> CompressionModel:
    """Fit on the texts of ``docs`` that ``labels`` marks 0 or 1; of an id's labels the smallest counts.

    The sample is drawn from the ids alone, so it has at most ``2 * (dictionary_rows + calibration_rows)``
    rows and is broadcast to find its texts in one scan.  They are written, and their sizes decide
    how many rows of each class, in order of hash, reach the driver: up to ``sample_bytes``, one at
    least.  Of an id's texts the smallest counts; null counts as empty.  A class without rows leaves both
    dictionaries empty; the score is then the share of label 1 (1/2 with no labels).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(counts) < 2:
        return CompressionModel(b"", b"", prior, 0.0)
    n = dictionary_rows + calibration_rows
    drawn = known.where("y = 0").orderBy("h", "id").limit(n).unionAll(known.where("y = 1").orderBy("h", "id").limit(n))
    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("t"))
    found, path = scratch.write(texts.join(F.broadcast(drawn), "id").groupBy("id", "h", "y").agg(F.min("t").alias("t")), "labelled")
    sizes, chosen, room = found.select("h", "id", "y", F.octet_length("t").alias("n")).collect(), [], {0: sample_bytes, 1: sample_bytes}
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"])):
        if room[r["y"]] == sample_bytes or r["n"] <= room[r["y"]]:
            chosen.append(r["id"])
            room[r["y"]] -= r["n"]
        else:
            room[r["y"]] = -1
    rows = sorted((r["h"], r["id"], r["y"], bytes(r["t"])) for r in found.where(F.col("id").isin(chosen)).collect())
    scratch.delete(docs.sparkSession, path)
    by_class = {v: [t for _, _, y, t in rows if y == v] for v in (0, 1)}
    # Of a small class a third is left for the curve.
    own = {v: min(dictionary_rows, len(by_class[v]) * 2 // 3 or 1) for v in (0, 1)}
    model = CompressionModel(*(_dictionary(by_class[v][: own[v]], dictionary_bytes) for v in (1, 0)), 0.0, 0.0)
    rest = [(t, v) for v in (0, 1) for t in by_class[v][own[v] :]]
    x, y = np.array([model.evidence(t) for t, _ in rest]), np.array([v for _, v in rest], dtype=float)
    if len(set(y)) < 2:
        return CompressionModel(model.good, model.bad, prior, 0.0)
    bias, slope = _logistic(x, y)
    # The sample is even by class; put the true share of the classes back into the bias.
    return CompressionModel(model.good, model.bad, bias - float(np.log(y.mean() / (1 - y.mean()))) + prior, slope)


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row; null and empty texts get the curve's value at no evidence.

    Equal texts have equal scores, repeated rows and null ids are scored like others, long texts are
    read whole; other columns, whatever their names, are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(texts))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double")
    return scored.withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns; texts move nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a row is kept from fitting: the remainder of ``crc32(id as text)`` is 0."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds == 0
