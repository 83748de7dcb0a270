"""The whole ranking run, brought to its end on a small catalog."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import evaluate
from harrow.operators.vector import FIELDS
from harrow.plans import runs
from harrow.sources.tables import Catalog

WORDS = [a + b for a in ("ко", "ма", "ри", "ле", "so", "tan", "vel", "kur") for b in ("та", "ник", "doma", "pel", "ris", "gon")]
ARTICLES = 24


def words_of(article):
    return [WORDS[(2 * article + j) % len(WORDS)] for j in range(4)]


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(1)
    articles = []
    for i in range(ARTICLES):
        own = words_of(i)
        text = " ".join(rng.choices(own + WORDS[:10], k=40))
        articles.append((i, " ".join(own[:2]), f"<h2>{own[0]} {own[1]}</h2><p>{text}</p><a href='/article/{(i + 1) % ARTICLES}'>{own[2]}</a>"))
    labelled = [(q, " ".join(rng.choices(words_of(q % ARTICLES), k=5)), str(q % ARTICLES), q) for q in range(40)]
    new = [(100 + q, " ".join(rng.choices(words_of(q * 5 % ARTICLES), k=5))) for q in range(8)]
    return Catalog(
        spark.createDataFrame(articles, "article_id long, title string, body string"),
        spark.createDataFrame(labelled, "query_id long, query_text string, ground_truth string, query_pos long"),
        spark.createDataFrame(new, "query_id long, query_text string"),
    )


def test_ranking_run(spark, catalog):
    fields = [f for f in FIELDS if f.name in ("bm25", "stem_bm25", "title_char", "title_heading_word")]
    answer = runs.fit_predict(catalog, fields=fields, trees=2, folds=2)
    docs = catalog.articles.select(F.col("article_id").alias("doc_id"))
    evaluate.validate_answer(answer, catalog.test, docs)
    best = {r["query_id"] - 100: [int(x) for x in r["answer"].split()] for r in answer.collect()}
    hits = sum(q * 5 % ARTICLES in ranking[:3] for q, ranking in best.items())
    assert hits >= 7  # a query's words are its article's own; the nearest articles share two of the four
