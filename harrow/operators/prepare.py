"""Articles and queries made ready for the indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.html import extract_fields
from harrow.functions.stem import stem_text
from harrow.functions.text import normalize_text, remove_noise, token_count
from harrow.operators import spell


def prepare_articles(articles: DataFrame, id_col: str = "article_id", title: str = "title", body: str = "body") -> DataFrame:
    """``doc_id`` with clean, stemmed and structural texts, links and the body's length."""
    parsed = extract_fields(articles.select(F.col(id_col).cast("long").alias("doc_id"), F.col(title).alias("title"), F.col(body).alias("body")), "body")
    clean = parsed.select(
        "doc_id",
        normalize_text(F.col("title")).alias("title_clean"),
        F.col("visible").alias("body_clean"),
        F.col("important").alias("important_clean"),
        F.col("anchors").alias("anchor_clean"),
        F.col("alt_text").alias("alt_clean"),
        F.col("intro").alias("intro_clean"),
        "internal_links",
    )
    return clean.withColumns({"title_stem": stem_text("title_clean"), "body_stem": stem_text("body_clean"), "body_length": F.length("body_clean")})


def prepare_queries(queries: DataFrame, vocab: DataFrame, id_col: str = "query_id", text: str = "query_text") -> DataFrame:
    """``query_id`` with clean, noise-free and corrected views, their stems, and lengths; other columns stay."""
    named = queries.withColumnRenamed(id_col, "query_id")
    clean = named.withColumn("query_clean", normalize_text(F.col(text)))
    core = clean.withColumn("query_core", remove_noise(F.col("query_clean")))
    fixed = spell.fix(core, "query_core", vocab)
    stems = {f"query{v}_stem": stem_text(f"query{v or '_clean'}") for v in ("", "_core", "_spell")}
    return fixed.withColumns(stems | {"query_length": F.length("query_clean"), "token_count": token_count(F.col("query_clean"))})
