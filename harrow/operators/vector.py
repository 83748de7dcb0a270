"""Sparse document vectors as long tables, and their product with queries as an equi-join on terms.

Tables: counts ``(doc_id, term, tf)``, vocabulary ``(term, df, total)``, postings ``(doc_id, term,
weight)`` and scores ``(query_id, doc_id, score)``.  Rows that would be zero do not exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import char_wb_ngrams, word_ngrams
from harrow.operators.blocks import numbering, pack, parts_of, small
from harrow.operators.lineage import cut

# BM25's saturation and length weights.
K1, B = 1.5, 0.75


def ngrams(text: Column, analyzer: str, low: int, high: int) -> Column:
    return {"word": word_ngrams, "char_wb": char_wb_ngrams}[analyzer](text, low, high)


def dealt(docs: DataFrame, id_col: str, parts: int | None = None) -> DataFrame:
    """``docs`` partitioned by id, before texts are cleaned and cut: terms take many times a text's room.

    The number of partitions is named, as Spark would else choose it by the texts' size alone.
    """
    return docs.repartition(parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def term_counts(docs: DataFrame, id_col: str, text: Column, analyzer: str = "word", low: int = 1, high: int = 1) -> DataFrame:
    """``(doc_id, term, tf)``; of ``dealt`` documents the terms are counted where they arise and never shuffled."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(ngrams(text, analyzer, low, high)).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """``(term, df, total)``: terms in at least ``min_df`` documents, of those the most frequent, ties by term."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return terms if max_features is None else terms.orderBy(F.desc("total"), "term").limit(max_features)


@dataclass
class BM25Fitted:
    """What BM25 knows of a table: ``counts``, ``vocab``, ``lengths(doc_id, length)`` in vocabulary terms, and ``stats``, one row ``(n, mean)``."""

    counts: DataFrame
    vocab: DataFrame
    lengths: DataFrame
    stats: DataFrame


def fit_bm25(docs: DataFrame, id_col: str, counts: DataFrame, vocab: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> BM25Fitted:
    """Documents without a term count in the number and mean length of documents."""
    lengths = keep(counts.join(small(vocab.select("term")), "term", "left_semi").groupBy("doc_id").agg(F.sum("tf").alias("length")))
    mean = F.greatest(F.coalesce(F.col("sum_length"), F.lit(0)) / F.greatest("n", F.lit(1)), F.lit(1.0)).alias("mean")
    stats = lengths.agg(F.sum("length").alias("sum_length")).crossJoin(docs.agg(F.count(id_col).alias("n"))).select("n", mean)
    return BM25Fitted(counts, vocab, lengths, keep(stats))


def bm25_for(queries: DataFrame, fitted: BM25Fitted, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """BM25 scores ``(query_id, doc_id, score)`` of queries that are counts whose ``doc_id`` is the query's id.

    The queries' terms come first and are written: by their size they are broadcast, so that of the
    postings only those of the queries' terms leave the scan.
    """
    queries = keep(queries)
    wanted = keep(queries.select("term").distinct().join(fitted.vocab.select("term", "df"), "term"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    met = fitted.counts.join(small(wanted), "term").join(small(fitted.lengths), "doc_id").crossJoin(F.broadcast(fitted.stats))
    postings = met.select("doc_id", "term", (saturated * idf).alias("weight"))
    return dot(queries.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").cast("double").alias("weight")), postings)


def l2(postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows scaled to length one."""
    norm = postings.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return postings.join(norm, id_col).where("norm > 0").select(*[c for c in postings.columns if c != "weight"], (F.col("weight") / F.col("norm")).alias("weight"))


def smooth_idf(vocab: DataFrame, n_docs: DataFrame) -> DataFrame:
    """``(term, idf)``; ``n_docs`` is one row with ``n``."""
    return vocab.crossJoin(F.broadcast(n_docs)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf_postings(counts: DataFrame, idf: DataFrame, sublinear: bool = True) -> DataFrame:
    """Unit vectors of ``(1 + ln tf) idf``; terms outside the vocabulary are dropped."""
    tf = 1 + F.log(F.col("tf")) if sublinear else F.col("tf").cast("double")
    return l2(counts.join(idf, "term").select("doc_id", "term", (tf * F.col("idf")).alias("weight")))


def dot(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: the sum over common terms of the product of weights."""
    pairs = queries.withColumnRenamed("weight", "q_weight").join(postings, "term")
    return pairs.groupBy("query_id", "doc_id").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("score"))


def _weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    return counts.join(idf, "term").select("doc_id", "term", ((1 + F.log(F.col("tf"))) * F.col("idf")).alias("weight"))


@dataclass
class TfidfIndex:
    """A fitted field: the vocabulary's weights, the documents' counts and the lengths of their vectors."""

    idf: DataFrame
    counts: DataFrame
    norms: DataFrame
    analyzer: str
    low: int
    high: int
    keep: Callable[[DataFrame], DataFrame]

    @property
    def postings(self) -> DataFrame:
        """The documents' unit vectors."""
        return self._unit(_weighted(self.counts, small(self.idf)))

    def _unit(self, weighted: DataFrame) -> DataFrame:
        return weighted.join(small(self.norms), "doc_id").where("norm > 0").select("doc_id", "term", (F.col("weight") / F.col("norm")).alias("weight"))

    def transform(self, queries: DataFrame, id_col: str, text: Column) -> DataFrame:
        """Query vectors ``(query_id, term, weight)``."""
        counts = term_counts(queries, id_col, text, self.analyzer, self.low, self.high)
        return tfidf_postings(counts, self.idf).withColumnRenamed("doc_id", "query_id")

    def score(self, queries: DataFrame, id_col: str, text: Column) -> DataFrame:
        """Cosines of queries and documents; of the postings only those of the queries' terms are weighted."""
        vectors = self.keep(self.transform(queries, id_col, text))
        wanted = self.keep(vectors.select("term").distinct().join(self.idf, "term"))
        return dot(vectors, self._unit(_weighted(self.counts, small(wanted))))


def fit_tfidf(docs: DataFrame, id_col: str, text: Column, analyzer: str = "word", low: int = 1, high: int = 2, min_df: int = 1, max_features: int | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> TfidfIndex:
    """``keep`` is applied to what a fitted index holds; it writes it, unless told otherwise."""
    counts = keep(term_counts(docs, id_col, text, analyzer, low, high))
    idf = keep(smooth_idf(vocabulary(counts, min_df, max_features), docs.agg(F.count(id_col).alias("n"))))
    norms = keep(_weighted(counts, small(idf)).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")))
    return TfidfIndex(idf, counts, norms, analyzer, low, high, keep)


class BlockSpace:
    """Unit TF-IDF vectors as blocks, for products of many vectors with many: ``fit`` texts, then ``transform`` texts.

    Terms are counted anew for each step and not written; blocks are.
    """

    def __init__(self, analyzer: str, low: int, high: int, max_features: int | None = None) -> None:
        self.analyzer, self.low, self.high, self.max_features, self.idf = analyzer, low, high, max_features, None

    def _counts(self, docs: DataFrame, id_col: str, text: Column) -> DataFrame:
        # Texts are dealt by their number, and not written: to clean them anew is little beside cutting them.
        rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
        return term_counts(dealt(rows, "doc_id", parts_of(rows.sparkSession, docs.count())), "doc_id", F.col("__text"), self.analyzer, self.low, self.high)

    def fit(self, docs: DataFrame, id_col: str, text: Column) -> BlockSpace:
        vocab = cut(numbering(vocabulary(self._counts(docs, id_col, text), 1, self.max_features), "df"))
        n = docs.agg(F.count(id_col).alias("n"))
        self.idf = cut(vocab.crossJoin(F.broadcast(n)).select("term", "number", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
        return self

    def transform(self, docs: DataFrame, id_col: str, text: Column) -> DataFrame:
        if self.idf is None:
            raise ValueError("fit the space before using it")
        weight = ((1 + F.log(F.col("tf"))) * F.col("idf")).alias("w0")
        return pack(self._counts(docs, id_col, text).join(small(self.idf), "term").select("doc_id", "number", weight), "doc_id", unit=True)


class BM25Index:
    """BM25 over word n-grams: ``fit`` documents, then ``score`` queries."""

    def __init__(self, low: int = 1, high: int = 2, max_features: int | None = 150_000) -> None:
        self.low, self.high, self.max_features, self.fitted = low, high, max_features, None

    def fit(self, docs: DataFrame, id_col: str, text: Column, keep: Callable[[DataFrame], DataFrame] = cut) -> BM25Index:
        counts = keep(term_counts(docs, id_col, text, "word", self.low, self.high))
        self.fitted, self.keep = fit_bm25(docs, id_col, counts, keep(vocabulary(counts, 1, self.max_features)), keep), keep
        return self

    def score(self, queries: DataFrame, id_col: str, text: Column) -> DataFrame:
        if self.fitted is None:
            raise ValueError("fit the index before scoring")
        return bm25_for(term_counts(queries, id_col, text, "word", self.low, self.high), self.fitted, self.keep)


@dataclass(frozen=True)
class Field:
    """A source of scores: which text of the document, how it is cut, and which view of the query it meets."""

    name: str
    parts: tuple[str, ...]
    analyzer: str
    low: int
    high: int
    min_df: int
    max_features: int
    view: str = "query_clean"
    bm25: bool = False
    chars: int | None = None


# The fifteen lexical sources.
BODY_CHARS = 30_000
_TITLE2_BODY, _STEM2_BODY = ("title_clean", "title_clean", "body_clean"), ("title_stem", "title_stem", "body_stem")
FIELDS = [
    Field("bm25", _TITLE2_BODY, "word", 1, 2, 1, 120_000, bm25=True, chars=BODY_CHARS),
    Field("stem_bm25", _STEM2_BODY, "word", 1, 2, 1, 150_000, view="query_stem", bm25=True),
    Field("body_word", ("body_clean",), "word", 1, 2, 2, 120_000, chars=BODY_CHARS),
    Field("body_char", ("body_clean",), "char_wb", 3, 5, 2, 120_000, chars=BODY_CHARS),
    Field("title_char", ("title_clean",), "char_wb", 3, 6, 1, 80_000),
    Field("stem_tfidf", _STEM2_BODY, "word", 1, 2, 2, 150_000, view="query_stem"),
    Field("title_word", ("title_clean",), "word", 1, 3, 1, 150_000),
    Field("title_char_wide", ("title_clean",), "char_wb", 2, 6, 1, 150_000),
    Field("heading_word", ("important_clean",), "word", 1, 3, 1, 150_000),
    Field("heading_char", ("important_clean",), "char_wb", 3, 6, 1, 150_000),
    Field("anchor_word", ("anchor_clean",), "word", 1, 3, 1, 150_000),
    Field("intro_word", ("intro_clean",), "word", 1, 3, 1, 150_000),
    Field("intro_char", ("intro_clean",), "char_wb", 3, 5, 2, 150_000),
    Field("title_heading_word", ("title_clean", "title_clean", "important_clean"), "word", 1, 3, 1, 150_000),
    Field("structured_word", ("title_clean", "title_clean", "title_clean", "important_clean", "anchor_clean", "alt_clean", "intro_clean"), "word", 1, 3, 1, 150_000),
]
# The sources that are scored with the noise-free and the corrected query as well.
NOISE_BM25, NOISE_FIELDS = ("bm25", "stem_bm25"), ("title_word", "title_char", "title_heading_word", "structured_word", "intro_word")


def field_text(field: Field) -> Column:
    """A field's text; a missing part is empty."""
    return F.concat_ws(" ", *(F.substring(c, 1, field.chars) if field.chars and c == "body_clean" else F.col(c) for c in field.parts))


class ArticleIndex:
    """All lexical sources over one table of articles, scored into one long table."""

    def __init__(self, fields: list[Field] | None = None) -> None:
        self.fields, self.fitted = FIELDS if fields is None else fields, {}

    def fit(self, articles: DataFrame, id_col: str, keep: Callable[[DataFrame], DataFrame] = cut) -> ArticleIndex:
        for f in self.fields:
            text = field_text(f)
            self.fitted[f.name] = (
                BM25Index(f.low, f.high, f.max_features).fit(articles, id_col, text, keep) if f.bm25 else fit_tfidf(articles, id_col, text, f.analyzer, f.low, f.high, f.min_df, f.max_features, keep)
            )
        return self

    def score(self, queries: DataFrame, id_col: str) -> DataFrame:
        """``(query_id, doc_id, source, score)`` of every source."""
        return self._score(queries, id_col, [(f.name, f.name, f.view) for f in self.fields])

    def score_views(self, queries: DataFrame, id_col: str) -> DataFrame:
        """The sources of the noise-free and corrected views of the queries."""
        known, jobs = {f.name: f for f in self.fields}, []
        for view in ("core", "spell"):
            for name in NOISE_BM25 + NOISE_FIELDS:
                if name in known:
                    jobs.append((f"{name}_{view}", name, f"query_{view}_stem" if known[name].view == "query_stem" else f"query_{view}"))
        return self._score(queries, id_col, jobs)

    def _score(self, queries: DataFrame, id_col: str, jobs: list[tuple[str, str, str]]) -> DataFrame:
        if not self.fitted:
            raise ValueError("fit the index before scoring")
        out = None
        for source, name, view in jobs:
            one = self.fitted[name].score(queries, id_col, F.col(view)).select("query_id", "doc_id", F.lit(source).alias("source"), "score")
            out = one if out is None else out.unionByName(one)
        return out


class QueryFeatureSpace:
    """Queries as unit vectors of word and character n-grams; the halves' terms are kept apart by a prefix."""

    def __init__(self, word_features: int = 50_000, char_features: int = 80_000) -> None:
        self.word_features, self.char_features, self.fitted = word_features, char_features, None

    def fit(self, queries: DataFrame, id_col: str, text: Column, keep: Callable[[DataFrame], DataFrame] = cut) -> QueryFeatureSpace:
        self.fitted = (
            fit_tfidf(queries, id_col, text, "word", 1, 2, 1, self.word_features, keep),
            fit_tfidf(queries, id_col, text, "char_wb", 3, 5, 1, self.char_features, keep),
        )
        return self

    def _halves(self, queries: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
        if self.fitted is None:
            raise ValueError("fit the space before using it")
        return tuple(index.transform(queries, id_col, text) for index in self.fitted)

    def transform(self, queries: DataFrame, id_col: str, text: Column, word_weight: float = 0.2) -> DataFrame:
        """``(query_id, term, weight)``: both halves, weighted so that their cosines mix as ``word_weight`` says."""
        word, char = self._halves(queries, id_col, text)
        scaled = [half.select("query_id", F.concat(F.lit(p), "term").alias("term"), (F.col("weight") * w**0.5).alias("weight")) for half, p, w in ((word, "w:", word_weight), (char, "c:", 1 - word_weight))]
        return l2(scaled[0].unionByName(scaled[1]), "query_id")

    def transform_char(self, queries: DataFrame, id_col: str, text: Column) -> DataFrame:
        return self._halves(queries, id_col, text)[1]
