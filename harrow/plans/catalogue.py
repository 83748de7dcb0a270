"""Every query of the retrieval engine with the SQL it is held against.

The driver's tables stand in for the retrieval tables: ``documents`` are the articles (their first
eight tokens the title), ``benchmark`` the queries, ``lineitem`` the labelled queries of labels alone
(order names part), ``conversations`` those with texts (turn names conversation), ``embeddings`` dense queries.
Scores are rounded to nine places before ranks are taken, so that the order of summation cannot
decide a tie, and to six in results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions import html as html_fields
from harrow.functions.stem import stem_text
from harrow.functions.text import instruct, normalize_text, remove_noise, shingles, title_of, token_count, tokens
from harrow.operators import classify, evaluate, graph, ltr, neighbors, pairs, rank, spell
from harrow.operators.blocks import small
from harrow.operators.fields import best_of_fields
from harrow.operators.lineage import cut
from harrow.operators.vector import FIELDS, ArticleIndex, BlockSpace, BM25Index, Field, TfidfIndex, dealt, fit_tfidf, term_counts, vocabulary
from harrow.plans import runs
from harrow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _six(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


def _nine(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


# Tables in the roles of the retrieval engine.


def _docs(spark: SparkSession, d: str, by_id: bool = False) -> DataFrame:
    """The articles; ``by_id`` deals them out for queries that count their terms."""
    rows = table(spark, d, "documents")
    clean = (dealt(rows, "doc_id") if by_id else rows).select("doc_id", "source", normalize_text(F.col("text"), entities=False).alias("body_clean"))
    return clean.withColumn("title_clean", title_of(F.col("body_clean")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), normalize_text(F.col("text"), entities=False).alias("query_clean"))


def _order_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).distinct()


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"))


def _class_labels(docs: DataFrame) -> DataFrame:
    """Documents as labelled queries: the number in ``source`` is the class."""
    return docs.select(F.col("doc_id").alias("query_id"), F.substring("source", 4, 10).cast("long").alias("doc_id"))


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` where the document holds the item's tokens in a row.

    They meet on the item's first five tokens, so no document is compared to an item it shares nothing with.
    """
    first = items.select("query_id", "query_clean", F.array_join(F.slice(tokens(F.col("query_clean")), 1, 5), " ").alias("gram")).where(F.size(tokens(F.col("query_clean"))) >= 5)
    words = tokens(F.col("body_clean"))
    grams = docs.select("doc_id", "body_clean", F.explode(F.array_distinct(shingles(words, 5))).alias("gram"))
    near = grams.join(first, "gram").where(F.contains(F.concat(F.lit(" "), "body_clean", F.lit(" ")), F.concat(F.lit(" "), "query_clean", F.lit(" "))))
    return near.select("query_id", "doc_id").distinct()


# The same in DuckDB's SQL.

_CLEAN = r"trim(regexp_replace(regexp_replace(replace(lower(coalesce({0}, '')), 'ё', 'е'), 'https?://\S+|www\.\S+', ' ', 'g'), '[^0-9a-zа-я]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_WORDS = "list_filter(string_split({0}, ' '), lambda w: length(w) >= 2)"


def _words_sql(text: str, low: int, high: int) -> tuple[str, str]:
    """The words, and the n-grams of a column ``w`` that holds them."""
    parts = ["w"] if low == 1 else []
    for n in range(max(low, 2), high + 1):
        gram = " || ' ' || ".join(f"z[{k + 1}]" for k in range(n))
        shifted = ", ".join(f"w[{k + 1}:len(w) - {n - 1 - k}]" for k in range(n))
        parts.append(f"list_transform(list_zip({shifted}), lambda z: {gram})")
    return _WORDS.format(text), parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"


def _chars_sql(text: str, low: int, high: int) -> str:
    return (
        f"flatten(list_transform({_TOKENS.format(text)}, lambda w: flatten(list_transform(range({low}, greatest({low}, least({high}, length(w) + 2)) + 1), "
        f"lambda n: list_transform(range(1, greatest(length(w) + 3 - n, 1) + 1), lambda i: substr(' ' || w || ' ', i, n))))))"
    )


_BASE = f"""
    docs AS (SELECT doc_id, source, {_CLEAN.format("text")} AS body_clean FROM documents),
    d AS (SELECT *, array_to_string(({_TOKENS.format("body_clean")})[1:8], ' ') AS title_clean FROM docs),
    q AS (SELECT item_id AS query_id, {_CLEAN.format("text")} AS query_clean FROM benchmark)"""


def _tf(name: str, source: str, id_col: str, grams: str | tuple[str, str]) -> str:
    words, of = grams if isinstance(grams, tuple) else ("NULL", grams)
    return f"{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({of}) AS term FROM (SELECT *, {id_col} AS id, {words} AS w FROM {source})) GROUP BY ALL)"


def _tfidf(prefix: str, fit: str, tf: str, n: str) -> str:
    """Unit vectors ``{prefix}v`` of the counts ``tf`` with weights fitted on the counts ``fit``."""
    return f"""
    {prefix}i AS (SELECT term, ln((1 + ({n})) / (1 + count(*))) + 1 AS idf FROM {fit} GROUP BY term),
    {prefix}r AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM {tf} JOIN {prefix}i USING (term)),
    {prefix}v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {prefix}r)"""


_BM25 = f"""{_BASE},
    t AS (SELECT doc_id, title_clean || ' ' || title_clean || ' ' || substr(body_clean, 1, 30000) AS x FROM d),
    {_tf("c", "t", "doc_id", _words_sql("x", 1, 2))},
    {_tf("qc", "q", "query_id", _words_sql("query_clean", 1, 2))},
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 120000),
    len AS (SELECT id, sum(tf) AS dl FROM c JOIN vocab USING (term) GROUP BY id),
    st AS (SELECT (SELECT count(doc_id) FROM d) AS n, greatest((SELECT sum(dl) FROM len) / (SELECT count(doc_id) FROM d), 1) AS mean),
    bm25 AS (SELECT qc.id AS query_id, c.id AS doc_id, round(sum(qc.tf * c.tf * 2.5 / (c.tf + 1.5 * (0.25 + 0.75 * dl / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 9) AS score
             FROM qc JOIN c USING (term) JOIN vocab USING (term) JOIN len ON len.id = c.id, st GROUP BY ALL)"""
_CHAR = f"""
    {_tf("tc", "d", "doc_id", _chars_sql("title_clean", 3, 6))},
    {_tf("tq", "q", "query_id", _chars_sql("query_clean", 3, 6))},
    {_tfidf("td", "tc", "tc", "SELECT count(*) FROM d")},
    {_tfidf("tq", "tc", "tq", "SELECT count(*) FROM d")},
    chars AS (SELECT tqv.id AS query_id, tdv.id AS doc_id, round(sum(tqv.w * tdv.w), 9) AS score FROM tqv JOIN tdv USING (term) GROUP BY ALL)"""


def _top(scores: str, k: int = 10) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {scores} QUALIFY rank <= {k})"


_indexes: dict[tuple, ArticleIndex | BM25Index | DataFrame | TfidfIndex] = {}


def _index(spark: SparkSession, d: str, name: str, fit: Callable[[DataFrame], ArticleIndex | BM25Index | DataFrame | TfidfIndex]):
    """The fitted index over a session's documents, used by several queries until the table is written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, d, name, status.getModificationTime(), status.getLen())
    if key not in _indexes:
        _indexes[key] = fit(None if name == "parts" else dealt(_articles(spark, d), "doc_id") if name != "articles" else _docs(spark, d, by_id=True))
    return _indexes[key]


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """``_docs`` written: else every expression that names a cleaned text cleans it anew, some once a term."""
    return _index(spark, d, "articles", cut)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "title_clean", "title_clean", F.substring("body_clean", 1, 30_000))
    index = _index(spark, d, "bm25", lambda docs: BM25Index(1, 2, 120_000).fit(docs, "doc_id", text))
    return _nine(index.score(_items(spark, d), "query_id", F.col("query_clean")))


def _title_chars(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d, "title_char", lambda docs: fit_tfidf(docs, "doc_id", F.col("title_clean"), "char_wb", 3, 6))
    return _nine(index.score(_items(spark, d), "query_id", F.col("query_clean")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top10(spark, d)


# Popularity (labels only).


@_query("""SELECT p_partkey AS doc_id, coalesce(n, 0) AS score, row_number() OVER (ORDER BY coalesce(n, 0) DESC, p_partkey) AS rank
    FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey ORDER BY rank LIMIT 10""")
def popularity_top10(spark, d):
    return evaluate.popularity_ranking(_order_labels(spark, d), _parts(spark, d))


_OOF = """
    l AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS a, l_orderkey % 5 AS f FROM lineitem),
    c AS (SELECT f.f, p_partkey AS a, (SELECT count(*) FROM l WHERE l.a = p_partkey AND l.f <> f.f) AS n FROM part, (SELECT DISTINCT f FROM l) f),
    r AS (SELECT f, a, row_number() OVER (PARTITION BY f ORDER BY n DESC, a) AS k FROM c QUALIFY k <= 10),
    h AS (SELECT l.q, r.k, row_number() OVER (PARTITION BY l.q ORDER BY r.k) AS i FROM l JOIN r ON l.f = r.f AND l.a = r.a),
    ap AS (SELECT q, any_value(f) AS f, coalesce((SELECT sum(i / k) FROM h WHERE h.q = l.q), 0) / least(count(*), 10) AS ap FROM l GROUP BY q)"""


@_query(f"WITH {_OOF} SELECT f::INTEGER AS fold, count(*) AS n_queries, round(avg(ap), 6) AS map FROM ap GROUP BY f UNION ALL SELECT -1, count(*), round(avg(ap), 6) FROM ap")
def popularity_oof_map(spark, d):
    return runs.popularity_oof(_order_labels(spark, d), _parts(spark, d)).withColumn("map", F.round("map", 6))


@_query("SELECT l_partkey AS doc_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def label_frequency(spark, d):
    return evaluate.label_counts(_order_labels(spark, d))


# Text.


@_query(f"WITH {_BASE} SELECT doc_id, md5(body_clean) AS body_md5, title_clean, length(body_clean) AS body_length, len({_TOKENS.format('body_clean')}) AS n_tokens FROM d")
def normalize_docs(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.col("body_clean").cast("binary")).alias("body_md5"), "title_clean", F.length("body_clean").alias("body_length"), token_count(F.col("body_clean")).alias("n_tokens"))


_PHRASES = "здравствуйте|здраствуйте|здравствуй|привет|добрый  (день|вечер|утро)|подскажите|скажите|пожалуйста|будьте  добры|можете  подсказать|хочу  узнать|у  меня  вопрос"
_GREETING = "Здравствуйте! Подскажите, добрый день, "


@_query(f"""WITH x AS (SELECT item_id, {_CLEAN.format(f"'{_GREETING}' || text")} AS c FROM benchmark)
    SELECT item_id, trim(regexp_replace(regexp_replace(' ' || replace(c, ' ', '  ') || ' ', ' ({_PHRASES}) ', ' ', 'g'), ' +', ' ', 'g')) AS core FROM x""")
def remove_noise_items(spark, d):
    greeted = F.concat(F.lit(_GREETING), "text")
    return table(spark, d, "benchmark").select("item_id", remove_noise(normalize_text(greeted)).alias("core"))


@_query(f"WITH {_BASE}, {_tf('c', 'q', 'query_id', _words_sql('query_clean', 1, 3))} SELECT id AS doc_id, term, tf FROM c")
def word_ngrams_tf(spark, d):
    return term_counts(_items(spark, d), "query_id", F.col("query_clean"), "word", 1, 3)


@_query(f"WITH {_BASE}, {_tf('c', 'q', 'query_id', _chars_sql('query_clean', 3, 5))} SELECT id AS doc_id, term, tf FROM c")
def char_wb_tf(spark, d):
    return term_counts(_items(spark, d), "query_id", F.col("query_clean"), "char_wb", 3, 5)


@_query(f"""WITH {_BASE}, {_tf('c', 'd', 'doc_id', _words_sql('body_clean', 1, 1))}
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, round(ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1, 6) AS idf FROM c GROUP BY term HAVING count(*) >= 2""")
def df_idf(spark, d):
    docs = _docs(spark, d, by_id=True)
    vocab = vocabulary(term_counts(docs, "doc_id", F.col("body_clean")), min_df=2)
    n = docs.agg(F.count("doc_id").alias("n"))
    return vocab.crossJoin(F.broadcast(n)).select("term", "df", "total", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


@_query(f"WITH {_BASE}, {_tf('c', 'd', 'doc_id', _words_sql('body_clean', 1, 2))} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 5000")
def vocab_topk(spark, d):
    return vocabulary(term_counts(_docs(spark, d, by_id=True), "doc_id", F.col("body_clean"), "word", 1, 2), 1, 5000)


@_query()
def stem_tokens(spark, d):
    return _items(spark, d).select("query_id", stem_text("query_clean").alias("query_stem"))


@_query(f"""WITH {_BASE}, u AS (SELECT unnest({_TOKENS.format("title_clean || ' ' || body_clean")}) AS word FROM d), voc AS (SELECT word, count(*) AS n FROM u WHERE length(word) >= 4 GROUP BY 1),
    w AS (SELECT query_id, unnest({_TOKENS.format('query_clean')}) AS w FROM q), lw AS (SELECT query_id, w FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(w) DESC, w) = 1),
    t AS (SELECT q.query_id, CASE WHEN w IS NULL THEN NULL ELSE replace(query_clean, w, substr(w, 1, 2) || substr(w, 4)) END AS typed FROM q LEFT JOIN lw USING (query_id)),
    tok AS (SELECT query_id, unnest({_TOKENS.format('typed')}) AS token, generate_subscripts({_TOKENS.format('typed')}, 1) AS pos FROM t),
    odd AS (SELECT DISTINCT token FROM tok WHERE length(token) >= 4 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN (SELECT word FROM voc)),
    best AS (SELECT token, word FROM odd JOIN voc ON abs(length(token) - length(word)) <= 2 AND damerau_levenshtein(token, word) <= 2
             QUALIFY row_number() OVER (PARTITION BY token ORDER BY damerau_levenshtein(token, word), n DESC, word) = 1),
    done AS (SELECT query_id, string_agg(coalesce(word, token), ' ' ORDER BY pos) AS query_spell FROM tok LEFT JOIN best USING (token) GROUP BY 1)
    SELECT query_id, typed, coalesce(query_spell, '') AS query_spell FROM t LEFT JOIN done USING (query_id)""")
def spell_fix(spark, d):
    """Every item with a letter dropped from its longest word, corrected against the documents' words."""
    docs, items = _docs(spark, d), _items(spark, d)
    longest = F.array_sort(tokens(F.col("query_clean")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))[0]
    broken = items.withColumn("w", longest).withColumn("typed", F.regexp_replace("query_clean", F.col("w"), F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)"))))
    return spell.fix(broken.select("query_id", "typed"), "typed", spell.vocabulary(docs, "title_clean", "body_clean")).select("query_id", "typed", "query_spell")


@_query()
def html_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    return html_fields.extract_fields(pages, "html").select("page_id", "visible", "important", "anchors", "alt_text", "intro")


@_query("""SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(html, '') || '<a href="/articles/' || page_id || '">/articles/7', '/articles/(\\d+)', 1), lambda x: x::BIGINT)))::VARCHAR AS links FROM pages""")
def html_links(spark, d):
    """The raw-text link rule, on pages with two links put behind the body."""
    body = F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="/articles/'), F.col("page_id").cast("string"), F.lit('">/articles/7'))
    links = html_fields.internal_links(body)
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("["), F.array_join(links.cast("array<string>"), ", "), F.lit("]")).alias("links"))


# Lexical retrieval.


@_query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('bm25')}")
def bm25_top10(spark, d):
    return rank.top_k(_bm25(spark, d), 10).select("query_id", "doc_id", _six("score"), "rank")


@_query(f"""WITH {_BASE}, {_tf('c', 'd', 'doc_id', _words_sql('substr(body_clean, 1, 30000)', 1, 2))}, {_tf('qc', 'q', 'query_id', _words_sql('query_clean', 1, 2))},
    m AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 120000), cm AS (SELECT c.* FROM c JOIN m USING (term)),
    {_tfidf('d', 'cm', 'cm', 'SELECT count(*) FROM d')}, {_tfidf('q', 'cm', 'qc', 'SELECT count(*) FROM d')},
    s AS (SELECT qv.id AS query_id, dv.id AS doc_id, round(sum(qv.w * dv.w), 9) AS score FROM qv JOIN dv USING (term) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('s')}""")
def tfidf_word_top10(spark, d):
    index = _index(spark, d, "body_word", lambda docs: fit_tfidf(docs, "doc_id", F.substring("body_clean", 1, 30_000), "word", 1, 2, 2, 120_000))
    return rank.top_k(_nine(index.score(_items(spark, d), "query_id", F.col("query_clean"))), 10).select("query_id", "doc_id", _six("score"), "rank")


@_query(f"WITH {_BASE}, {_CHAR} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('chars')}")
def tfidf_char_top10(spark, d):
    return rank.top_k(_title_chars(spark, d), 10).select("query_id", "doc_id", _six("score"), "rank")


# Fusion, features, evaluation.

_RRF = f"""{_BM25}, {_CHAR},
    f AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM (
        SELECT query_id, doc_id, 0.8 / (rank + 5) AS w FROM {_top('bm25', 100)} UNION ALL SELECT query_id, doc_id, 0.2 / (rank + 10) FROM {_top('chars', 100)}) GROUP BY ALL)"""


@_query(f"WITH {_RRF} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('f')}")
def rr_fusion(spark, d):
    fused = rank.blend([(0.8, rank.reciprocal_rank(_bm25(spark, d), 100, 5)), (0.2, rank.reciprocal_rank(_title_chars(spark, d), 100, 10))])
    return rank.top_k(_nine(fused), 10).select("query_id", "doc_id", _six("score"), "rank")


@_query(f"""WITH {_BM25}, {_CHAR}, f AS (SELECT query_id, doc_id, round(sum(w), 9) AS score FROM (
        SELECT query_id, doc_id, 0.85 * pow((11 - rank) / 10, 0.5) AS w FROM {_top('bm25')} UNION ALL SELECT query_id, doc_id, 0.12 * pow((11 - rank) / 10, 1.5) FROM {_top('chars')}
        UNION ALL SELECT query_id, doc_id, 0.03 * (11 - rank) / 10 FROM {_top('chars')}) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {_top('f')}""")
def rank_power_blend(spark, d):
    chars = _title_chars(spark, d)
    return rank.top_k(_nine(rank.blend_final(_bm25(spark, d), chars, chars)), 10).select("query_id", "doc_id", _six("score"), "rank")


@_query(f"""WITH {_BM25}, n AS (SELECT count(*) AS n FROM d),
    m AS (SELECT query_id, sum(score) / any_value(n) AS mean, sqrt(greatest(sum(score * score) / any_value(n) - pow(sum(score) / any_value(n), 2), 0)) + 1e-6 AS sd FROM bm25, n GROUP BY 1)
    SELECT query_id, doc_id, round((score - mean) / sd, 4) AS z FROM {_top('bm25', 30)} JOIN m USING (query_id)""")
def zscore_features(spark, d):
    scores = _bm25(spark, d)
    z = rank.z_scores(scores, table(spark, d, "documents").count())
    return rank.top_k(z, 30).select("query_id", "doc_id", F.round("z", 4).alias("z"))


_CONTAIN = "lab AS (SELECT query_id, doc_id FROM q, d WHERE len(string_split(query_clean, ' ')) >= 5 AND contains(' ' || body_clean || ' ', ' ' || query_clean || ' '))"
_CANDIDATES = f"""{_BM25}, {_CHAR}, {_CONTAIN},
    cand AS (SELECT query_id, doc_id FROM {_top('bm25', 20)} UNION SELECT query_id, doc_id FROM {_top('chars', 30)} UNION SELECT query_id, doc_id FROM lab
             UNION SELECT query_id, doc_id FROM q, (SELECT DISTINCT doc_id FROM lab))"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    named = lambda scores, name: scores.select("query_id", "doc_id", F.lit(name).alias("source"), "score")
    return named(_bm25(spark, d), "bm25").unionByName(named(_title_chars(spark, d), "title_char"))


def _featured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with their features, and the labels; scores, labels and candidates are read several times, so written."""
    items = _items(spark, d)
    scores, labels = cut(_sources(spark, d)), cut(_contained(_articles(spark, d), items))
    chosen = cut(pairs.candidates(scores, ["bm25"], labels.select("doc_id"), items, labels))
    return pairs.pair_features(small(chosen), scores, {"bm25": 0.0, "title_char": 0.0}, table(spark, d, "documents").count()), labels


@_query(f"WITH {_CANDIDATES} SELECT query_id, doc_id FROM cand")
def candidate_union(spark, d):
    docs, items = _docs(spark, d, by_id=True), _items(spark, d)
    labels = _contained(docs, items)
    return pairs.candidates(_sources(spark, d), ["bm25"], labels.select("doc_id"), items, labels)


@_query(f"""WITH {_CANDIDATES}, n AS (SELECT count(*) AS n FROM d),
    mb AS (SELECT query_id, sum(score) / any_value(n) AS mean, sqrt(greatest(sum(score * score) / any_value(n) - pow(sum(score) / any_value(n), 2), 0)) + 1e-6 AS sd FROM bm25, n GROUP BY 1),
    mc AS (SELECT query_id, sum(score) / any_value(n) AS mean, sqrt(greatest(sum(score * score) / any_value(n) - pow(sum(score) / any_value(n), 2), 0)) + 1e-6 AS sd FROM chars, n GROUP BY 1),
    rb AS {_top('bm25', 100)}, rc AS {_top('chars', 100)},
    x AS (SELECT query_id, doc_id, coalesce(b.score, 0) AS bm25, coalesce(1 / (rb.rank + 10), 0) AS bm25_rr, (coalesce(b.score, 0) - mb.mean) / mb.sd AS bm25_z,
            coalesce(c.score, 0) AS title_char, coalesce(1 / (rc.rank + 10), 0) AS title_char_rr, (coalesce(c.score, 0) - mc.mean) / mc.sd AS title_char_z
          FROM cand LEFT JOIN bm25 b USING (query_id, doc_id) LEFT JOIN chars c USING (query_id, doc_id) LEFT JOIN rb USING (query_id, doc_id) LEFT JOIN rc USING (query_id, doc_id)
          LEFT JOIN mb USING (query_id) LEFT JOIN mc USING (query_id))
    SELECT query_id, doc_id, round(bm25, 4) AS bm25, round(bm25_rr, 6) AS bm25_rr, round(bm25_z, 4) AS bm25_z, round(title_char, 4) AS title_char, round(title_char_rr, 6) AS title_char_rr,
           round(title_char_z, 4) AS title_char_z, round((bm25_rr + title_char_rr) / 2, 6) AS rank_mean, round(greatest(bm25_rr, title_char_rr), 6) AS rank_max,
           round(abs(bm25_rr - title_char_rr) / 2, 6) AS rank_std, ((bm25_rr >= 0.1)::INT + (title_char_rr >= 0.1)::INT) AS ranks_at_01, ((bm25_rr >= 0.05)::INT + (title_char_rr >= 0.05)::INT) AS ranks_at_005
    FROM x""")
def pair_features(spark, d):
    out, _ = _featured(spark, d)
    places = {"bm25": 4, "bm25_z": 4, "title_char": 4, "title_char_z": 4, "bm25_rr": 6, "title_char_rr": 6, "rank_mean": 6, "rank_max": 6, "rank_std": 6}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@_query(f"""WITH {_BASE}, qt AS (SELECT query_id, unnest(list_distinct({_TOKENS.format('query_clean')})) AS t FROM q),
    dt AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('title_clean')})) AS t FROM d), n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1)
    SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM qt JOIN dt USING (t) JOIN n USING (query_id) GROUP BY ALL""")
def token_recall(spark, d):
    return pairs.token_recall(_items(spark, d), _docs(spark, d), "query_clean", "title_clean").withColumn("score", F.round("score", 6))


_AP = f"""{_BM25}, {_CONTAIN},
    n AS (SELECT query_id, count(*) AS n FROM lab GROUP BY 1),
    h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM {_top('bm25')} JOIN lab USING (query_id, doc_id)),
    ap AS (SELECT q.query_id, coalesce(n, 0) AS n_relevant, coalesce(s, 0) / greatest(least(coalesce(n, 0), 10), 1) AS ap
           FROM q LEFT JOIN n USING (query_id) LEFT JOIN (SELECT query_id, sum(i / rank) AS s FROM h GROUP BY 1) USING (query_id))"""


def _average_precision(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _docs(spark, d, by_id=True), _items(spark, d)
    return evaluate.average_precision(rank.top_k(_bm25(spark, d), 10), _contained(docs, items), items)


@_query(f"WITH {_AP} SELECT count(*) AS n_queries, round(avg(ap), 6) AS map FROM ap")
def map_at_10(spark, d):
    return _average_precision(spark, d).agg(F.count("*").alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"))


@_query(f"WITH {_AP} SELECT n_relevant, count(*) AS n_queries, round(avg(ap), 3) AS mean_ap FROM ap GROUP BY 1")
def ap_by_label_count(spark, d):
    return evaluate.ap_by_label_count(_average_precision(spark, d))


@_query(f"WITH {_BM25} SELECT query_id, string_agg(doc_id::VARCHAR, ' ' ORDER BY rank) AS answer FROM {_top('bm25')} GROUP BY 1")
def answer_format(spark, d):
    return evaluate.make_answer(rank.top_k(_bm25(spark, d), 10))


@_query(f"""WITH {_BM25}, a AS (SELECT query_id, list(doc_id) AS ids FROM {_top('bm25')} GROUP BY 1)
    SELECT 'queries' AS "check", (SELECT count(*) FROM q FULL JOIN a USING (query_id) WHERE a.ids IS NULL OR q.query_clean IS NULL) AS n
    UNION ALL SELECT 'length', count(*) FILTER (len(ids) <> 10) FROM a UNION ALL SELECT 'repeated', count(*) FILTER (len(ids) <> len(list_distinct(ids))) FROM a UNION ALL SELECT 'unknown', 0""")
def validate_answer(spark, d):
    return evaluate.answer_errors(evaluate.make_answer(rank.top_k(_bm25(spark, d), 10)), _items(spark, d), _docs(spark, d).select("doc_id"))


@_query("""SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS "min", quantile_cont(n_chars, 0.25)::DOUBLE AS p25,
    quantile_cont(n_chars, 0.5)::DOUBLE AS p50, quantile_cont(n_chars, 0.75)::DOUBLE AS p75, max(n_chars)::DOUBLE AS "max" FROM documents""")
def describe_lengths(spark, d):
    return evaluate.describe(table(spark, d, "documents"), "n_chars").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("""WITH l AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS a FROM lineitem), pq AS (SELECT q, count(*) AS n FROM l GROUP BY 1), pa AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT (SELECT count(*) FROM part) AS n_articles, (SELECT count(*) FROM pq) AS n_queries, (SELECT count(*) FROM pa) AS n_labelled, (SELECT count(*) FROM pa WHERE n = 1) AS n_single,
           (SELECT count(*) FROM pq WHERE n > 1) AS n_multi, (SELECT round(avg(n), 6) FROM pq) AS mean_labels, (SELECT median(n)::DOUBLE FROM pq) AS median_labels""")
def dataset_summary(spark, d):
    labels, parts = _order_labels(spark, d), _parts(spark, d)
    per_q = labels.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_queries"), F.count_if(F.col("n") > 1).alias("n_multi"), F.round(F.avg("n"), 6).alias("mean_labels"), F.median("n").alias("median_labels"))
    per_a = evaluate.label_counts(labels).agg(F.count("*").alias("n_labelled"), F.count_if(F.col("n") == 1).alias("n_single"))
    return parts.agg(F.count("*").alias("n_articles")).crossJoin(per_q).crossJoin(per_a)


@_query("""SELECT l_partkey AS doc_id, count(DISTINCT l_orderkey) AS n, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1 ORDER BY rank LIMIT 15""")
def label_bars(spark, d):
    """The fifteen most frequent labels, as a bar chart shows them."""
    counts = evaluate.label_counts(_order_labels(spark, d))
    return counts.orderBy(F.desc("n"), "doc_id").limit(15).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "doc_id")))


@_query(f"WITH {_BASE} SELECT query_id, 'query: ' || query_clean AS prompt FROM q")
def instructed_queries(spark, d):
    return _items(spark, d).select("query_id", instruct(F.col("query_clean")).alias("prompt"))


@_query(f"""WITH {_CANDIDATES}, qt AS (SELECT query_id, unnest(list_distinct({_TOKENS.format('query_clean')})) AS t FROM q), n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
    tt AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('title_clean')})) AS t FROM d), bt AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('body_clean')})) AS t FROM d),
    a AS (SELECT query_id, doc_id, count(*) AS c FROM qt JOIN tt USING (t) GROUP BY ALL), b AS (SELECT query_id, doc_id, count(*) AS c FROM qt JOIN bt USING (t) GROUP BY ALL)
    SELECT query_id, doc_id, round(coalesce(a.c, 0) / greatest(n, 1), 6) AS title_token_recall, round(coalesce(b.c, 0) / greatest(n, 1), 6) AS body_token_recall, round(ln(1 + length(title_clean)), 6) AS title_length,
           round(ln(1 + length(body_clean)), 6) AS body_length, round(ln(1 + length(query_clean)), 6) AS query_length, round(ln(1 + len({_TOKENS.format('query_clean')})), 6) AS query_tokens
    FROM cand JOIN q USING (query_id) JOIN d USING (doc_id) LEFT JOIN n USING (query_id) LEFT JOIN a USING (query_id, doc_id) LEFT JOIN b USING (query_id, doc_id)""")
def pair_metadata(spark, d):
    docs, items = cut(_docs(spark, d, by_id=True)), _items(spark, d)
    labels = _contained(docs, items)
    chosen = pairs.candidates(_sources(spark, d), ["bm25"], labels.select("doc_id"), items, labels)
    out = pairs.metadata(chosen.select("query_id", "doc_id"), items, docs)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("query_id", "doc_id")})


@_query(f"WITH {_BM25} SELECT query_id, doc_id, coalesce(round(t.score, 6), -1e6) AS score FROM q CROSS JOIN (SELECT doc_id FROM d) LEFT JOIN {_top('bm25', 20)} t USING (query_id, doc_id)")
def predict_fill(spark, d):
    """Scores of every document, those that are no candidates at the fill."""
    best = rank.top_k(_bm25(spark, d), 20).select("query_id", "doc_id", _six("score"))
    return rank.densify(best, _items(spark, d), table(spark, d, "documents").select("doc_id"), ltr.MISSING)


# All lexical fields.  A document's tokens 9 to 20 stand for its headings, 21 to 30 for anchors, 31 to 40 for
# image texts and its first 1,200 characters for the opening; stems are the words themselves.

_PARTS = f"""{_BASE}, art AS (SELECT doc_id, title_clean, body_clean, title_clean AS title_stem, body_clean AS body_stem, substr(body_clean, 1, 1200) AS intro_clean,
    array_to_string(({_TOKENS.format("body_clean")})[9:20], ' ') AS important_clean, array_to_string(({_TOKENS.format("body_clean")})[21:30], ' ') AS anchor_clean,
    array_to_string(({_TOKENS.format("body_clean")})[31:40], ' ') AS alt_clean FROM d)"""


def _field_sql(f: Field, tag: str) -> str:
    """CTEs that end in ``s{tag}(query_id, doc_id, score)``."""
    grams = (lambda c: _words_sql(c, f.low, f.high)) if f.analyzer == "word" else (lambda c: _chars_sql(c, f.low, f.high))
    text = ", ".join(f"substr({c}, 1, {f.chars})" if f.chars and c == "body_clean" else c for c in f.parts)
    base = f"""t{tag} AS (SELECT doc_id, concat_ws(' ', {text}) AS x FROM art), {_tf(f'c{tag}', f't{tag}', 'doc_id', grams('x'))}, {_tf(f'q{tag}', 'q', 'query_id', grams('query_clean'))},
        m{tag} AS (SELECT term, count(*) AS df FROM c{tag} GROUP BY term HAVING count(*) >= {f.min_df} ORDER BY sum(tf) DESC, term LIMIT {f.max_features}),
        k{tag} AS (SELECT c{tag}.*, df FROM c{tag} JOIN m{tag} USING (term))"""
    if f.bm25:
        return f"""{base}, l{tag} AS (SELECT id, sum(tf) AS dl FROM k{tag} GROUP BY id),
            s{tag} AS (SELECT q{tag}.id AS query_id, k{tag}.id AS doc_id, round(sum(q{tag}.tf * k{tag}.tf * 2.5 / (k{tag}.tf + 1.5 * (0.25 + 0.75 * dl / greatest((SELECT sum(dl) FROM l{tag}) / (SELECT count(*) FROM art), 1)))
                * ln(1 + ((SELECT count(*) FROM art) - df + 0.5) / (df + 0.5))), 9) AS score FROM q{tag} JOIN k{tag} USING (term) JOIN l{tag} ON l{tag}.id = k{tag}.id GROUP BY ALL)"""
    n = "SELECT count(*) FROM art"
    return f"""{base}, {_tfidf(f'd{tag}', f'k{tag}', f'k{tag}', n)}, {_tfidf(f'e{tag}', f'k{tag}', f'q{tag}', n)},
        s{tag} AS (SELECT e{tag}v.id AS query_id, d{tag}v.id AS doc_id, round(sum(e{tag}v.w * d{tag}v.w), 9) AS score FROM e{tag}v JOIN d{tag}v USING (term) GROUP BY ALL)"""


_ALL_FIELDS = "UNION ALL".join(f" SELECT query_id, doc_id, '{f.name}' AS source, round(score, 6) AS score, rank FROM {_top(f's_{k}', 5)} " for k, f in enumerate(FIELDS))


def _parts_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """The articles' parts, written: they are read twice for each way of cutting.  Texts of few files are dealt out."""
    docs = _docs(spark, d)
    docs = docs if docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else _docs(spark, d, by_id=True)
    piece = lambda a, n: F.array_join(F.slice(tokens(F.substring_index("body_clean", " ", 40)), a, n), " ")
    return cut(docs.select("doc_id", "body_clean", piece(1, 8).alias("title_clean"), piece(9, 12).alias("important_clean"), piece(21, 10).alias("anchor_clean"), piece(31, 10).alias("alt_clean")))


@_query(f"WITH {_PARTS}, {', '.join(_field_sql(f, f'_{k}') for k, f in enumerate(FIELDS))} {_ALL_FIELDS}")
def lexical_fields(spark, d):
    """The five best documents of every item by each of the fifteen lexical sources."""
    parts, items = _index(spark, d, "parts", lambda _: _parts_of_documents(spark, d)), _items(spark, d)
    docs = parts.withColumns({"title_stem": F.col("title_clean"), "body_stem": F.col("body_clean"), "intro_clean": F.substring("body_clean", 1, 1200)})
    scores = best_of_fields(docs, "doc_id", items.withColumn("query_stem", F.col("query_clean")), "query_id", FIELDS, 5)
    return rank.top_k(scores, 5, ("query_id", "source")).select("query_id", "doc_id", "source", _six("score"), "rank")


# Graphs.

_LAB = "l AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS a FROM lineitem)"
_LINKS = """e AS (SELECT DISTINCT x.l_partkey AS s, y.l_partkey AS t FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey),
    g AS (SELECT s, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY t) AS w FROM e)"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    linked = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy("l_partkey").agg(F.collect_set("dst").alias("links"))
    articles = _parts(spark, d).join(linked, F.col("doc_id") == F.col("l_partkey"), "left").select("doc_id", F.coalesce("links", F.array().cast("array<bigint>")).alias("links"))
    return graph.link_graph(articles, "doc_id", "links")


@_query(f"WITH {_LINKS} SELECT s AS src_id, t AS dst_id, round(w, 6) AS weight FROM g")
def link_graph(spark, d):
    return _links(spark, d).withColumn("weight", F.round("weight", 6))


@_query(f"WITH {_LAB} SELECT x.a AS src_id, y.a AS dst_id, count(*)::DOUBLE AS weight FROM l x JOIN l y ON x.q = y.q AND x.a <> y.a GROUP BY ALL")
def cooccurrence(spark, d):
    return graph.cooccurrence(_order_labels(spark, d))


@_query(f"""WITH {_LAB}, {_LINKS}, m AS (SELECT q, a, 1.0::DOUBLE AS w FROM l UNION ALL SELECT q, t, 0.05 * w FROM l JOIN g ON l.a = g.s)
    SELECT q AS query_id, a AS doc_id, round(sum(w), 6) AS score FROM m GROUP BY ALL""")
def link_propagation(spark, d):
    scores = _order_labels(spark, d).withColumn("score", F.lit(1.0))
    return graph.link_scores(scores, _links(spark, d)).withColumn("score", F.round("score", 6))


# Labelled queries: the turns of conversations, whole; a turn names its conversation.  Every fold (the query's
# number modulo five) is answered by the other four; term weights come from all queries.

FOLDS = 5
_SPLIT = f"""
    d AS (SELECT conv_id * 1000 + turn AS id, (conv_id * 1000 + turn) % {FOLDS} AS f, conv_id AS c, {_CLEAN.format("text")} AS x FROM conversations),
    lab AS (SELECT id, c FROM d), fo AS (SELECT unnest(range({FOLDS})) AS f),
    {_tf('tc', 'd', 'id', _chars_sql('x', 3, 5)).replace("SELECT *, id AS id,", "SELECT *,")}, {_tfidf('t', 'tc', 'tc', 'SELECT count(*) FROM d')},
    va AS (SELECT id % {FOLDS} AS f, * FROM tv), tn AS (SELECT f, tv.* FROM tv JOIN fo ON tv.id % {FOLDS} <> f),
    sim AS (SELECT a.id AS q, b.id AS t, round(sum(a.w * b.w), 9) AS s FROM va a JOIN va b ON a.term = b.term AND a.f <> b.f GROUP BY ALL)"""


def _near(k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, t) AS r FROM sim QUALIFY r <= {k})"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Labelled queries ``(query_id, doc_id, query_clean)``."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, d, "conversations").select(number.alias("query_id"), F.col("conv_id").alias("doc_id"), normalize_text(F.col("text"), entities=False).alias("query_clean"))


def _turn_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Unit vectors and labels of all labelled queries."""
    turns = _turns(spark, d)
    index = fit_tfidf(dealt(turns, "query_id"), "query_id", F.col("query_clean"), "char_wb", 3, 5)
    return index.postings.withColumnRenamed("doc_id", "query_id"), turns.select("query_id", "doc_id")


def _every_fold(answer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``answer(valid, train, train's labels)`` of every fold."""
    fold, out = evaluate.fold_of(F.col("query_id"), FOLDS), None
    for k in range(FOLDS):
        one = answer(vectors.where(fold == k), vectors.where(fold != k), labels.where(fold != k))
        out = one if out is None else out.unionByName(one)
    return out


def _by_folds(method: Callable, spark: SparkSession, d: str, *settings: float) -> DataFrame:
    """``method`` of all folds in one run."""
    vectors, labels = _turn_vectors(spark, d)
    return method(vectors, vectors, labels, *settings, folds=FOLDS)


def _sims(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest of every turn across folds, of all folds at once, and the labels."""
    turns, text = _turns(spark, d), F.col("query_clean")
    vectors = BlockSpace("char_wb", 3, 5).fit(turns, "query_id", text).transform(turns, "query_id", text)
    return neighbors.nearest_of_blocks(vectors, vectors, k, FOLDS), small(turns.select("query_id", "doc_id"))


@_query(f"WITH {_SPLIT} SELECT q AS query_id, c AS doc_id, round(sum(pow(greatest(s, 0), 3)), 6) AS score FROM {_near(80)} n JOIN lab ON lab.id = n.t GROUP BY ALL")
def knn_char_sum(spark, d):
    return neighbors.knn_sum(*_sims(spark, d, 80)).withColumn("score", F.round("score", 6))


@_query(f"WITH {_SPLIT} SELECT q AS query_id, c AS doc_id, round(max(s), 6) AS score FROM {_near(40)} n JOIN lab ON lab.id = n.t GROUP BY ALL")
def knn_char_max(spark, d):
    return neighbors.knn_max(*_sims(spark, d, 40)).withColumn("score", F.round("score", 6))


@_query(f"""WITH {_SPLIT}, full_sim AS (SELECT a.id AS q, b.id AS t, coalesce(s, 0) AS s FROM d a JOIN d b ON a.f <> b.f LEFT JOIN sim ON sim.q = a.id AND sim.t = b.id),
    n AS (SELECT *, max(s) OVER (PARTITION BY q) AS b, row_number() OVER (PARTITION BY q ORDER BY s DESC, t) AS r FROM full_sim QUALIFY r <= 40)
    SELECT q AS query_id, c AS doc_id, round(sum(exp((s - b) / 0.07)), 5) AS score FROM n JOIN lab ON lab.id = n.t GROUP BY ALL""")
def knn_char_soft(spark, d):
    sims, labels = _sims(spark, d, 40)
    sims = cut(sims)  # read several times by every fold

    def answer(near: DataFrame, turns: DataFrame, known: DataFrame) -> DataFrame:
        rest = known.select(F.col("query_id").alias("train_id"))
        return neighbors.knn_soft(near, known, rest, labels.join(known, "query_id", "left_anti"))

    return _every_fold(answer, sims, labels).withColumn("score", F.round("score", 5))


@_query(f"""WITH {_SPLIT}, cs AS (SELECT f, c, term, sum(w) AS w FROM tn JOIN lab USING (id) GROUP BY ALL), cv AS (SELECT f, c, term, w / sqrt(sum(w * w) OVER (PARTITION BY f, c)) AS w FROM cs)
    SELECT va.id AS query_id, c AS doc_id, round(sum(va.w * cv.w), 6) AS score FROM va JOIN cv USING (f, term) GROUP BY ALL""")
def rocchio(spark, d):
    return _by_folds(classify.rocchio, spark, d).withColumn("score", F.round("score", 6))


_NB = f"""{_SPLIT}, n AS (SELECT f, c, term, sum(w) AS w FROM tn JOIN lab USING (id) GROUP BY ALL), ft AS (SELECT f, term, sum(w) AS ft FROM n GROUP BY ALL),
    cl AS (SELECT f, c, count(*) AS k FROM (SELECT DISTINCT f, id FROM tn) JOIN lab USING (id) GROUP BY ALL), wc AS (SELECT f, c, sum(w) AS w FROM n GROUP BY ALL),
    v AS (SELECT f, count(*) AS v, sum(ft) AS all_w FROM ft GROUP BY 1), kk AS (SELECT f, sum(k) AS kk FROM cl GROUP BY 1),
    x AS (SELECT va.f, va.id AS q, term, va.w AS x, ft.ft FROM va JOIN ft USING (f, term)), own AS (SELECT x.f, q, n.c, x.x, n.w, ft FROM x JOIN n USING (f, term)),
    qs AS (SELECT DISTINCT f, id AS q FROM va)"""
_NB_END = """t AS (SELECT q, max(s) AS m FROM j GROUP BY 1), z AS (SELECT j.q, any_value(m) + ln(sum(exp(s - m))) AS z FROM j JOIN t USING (q) GROUP BY 1)
    SELECT j.q AS query_id, j.c AS doc_id, round(s - z, 5) + 0.0 AS score FROM j JOIN z USING (q)"""


def _mnb_sql(alpha: float) -> str:
    return f"""WITH {_NB}, lx AS (SELECT f, q, sum(x) AS lx FROM x GROUP BY ALL), g AS (SELECT f, q, c, sum(x * (ln(w + {alpha}) - ln({alpha}))) AS g FROM own GROUP BY ALL),
        j AS (SELECT qs.q, cl.c, ln(k / kk) + coalesce(lx, 0) * (ln({alpha}) - ln(wc.w + {alpha} * v)) + coalesce(g, 0) AS s
              FROM qs JOIN cl USING (f) JOIN wc USING (f, c) JOIN v USING (f) JOIN kk USING (f) LEFT JOIN lx USING (f, q) LEFT JOIN g USING (f, q, c)), {_NB_END}"""


def _cnb_sql(alpha: float) -> str:
    return f"""WITH {_NB}, lx AS (SELECT f, q, sum(x) AS lx, sum(x * ln(ft + {alpha})) AS base FROM x GROUP BY ALL), g AS (SELECT f, q, c, sum(x * (ln(ft + {alpha}) - ln(ft + {alpha} - w))) AS g FROM own GROUP BY ALL),
        j AS (SELECT qs.q, cl.c, coalesce(lx, 0) * ln(all_w + {alpha} * v - wc.w) - coalesce(base, 0) + coalesce(g, 0) AS s
              FROM qs JOIN cl USING (f) JOIN wc USING (f, c) JOIN v USING (f) LEFT JOIN lx USING (f, q) LEFT JOIN g USING (f, q, c)), {_NB_END}"""


@_query(_mnb_sql(0.05))
def mnb_logproba(spark, d):
    return _by_folds(classify.multinomial_nb, spark, d, 0.05).withColumn("score", F.round("score", 5) + 0.0)


@_query(_cnb_sql(1.0))
def cnb_logproba(spark, d):
    return _by_folds(classify.complement_nb, spark, d, 1.0).withColumn("score", F.round("score", 5) + 0.0)


@_query(_cnb_sql(0.5))
def cnb_05(spark, d):
    return _by_folds(classify.complement_nb, spark, d, 0.5).withColumn("score", F.round("score", 5) + 0.0)


@_query()
def svc_decision(spark, d):
    return _by_folds(classify.linear_svc, spark, d, 0.3, None).withColumn("score", F.round("score", 2))


def _profile_sql(grams: Callable[[str], str | tuple[str, str]]) -> str:
    """Profiles of conversations: three times the first turn, the training turns, 4,000 characters of all turns."""
    return f"""WITH {_SPLIT}, head AS (SELECT c, string_agg(x, ' ' ORDER BY id) AS body, arg_min(x, id) AS title FROM d GROUP BY 1),
        ex AS (SELECT fo.f, c, string_agg(x, ' ' ORDER BY id) AS ex FROM d JOIN fo ON d.f <> fo.f GROUP BY ALL),
        p AS (SELECT fo.f, head.c, concat_ws(' ', title, title, title, ex, substr(body, 1, 4000)) AS px, fo.f * 1000000000 + head.c AS pid FROM fo, head LEFT JOIN ex ON ex.f = fo.f AND ex.c = head.c),
        {_tf('pc', 'p', 'pid', grams('px'))}, {_tf('vc', 'd', 'id', grams('x')).replace("SELECT *, id AS id,", "SELECT *,")},
        g AS (SELECT id // 1000000000 AS f, term, count(*) AS df, sum(tf) AS tf FROM pc GROUP BY ALL),
        m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY f ORDER BY tf DESC, term) <= 100000),
        i AS (SELECT f, term, ln((1 + (SELECT count(*) FROM head)) / (1 + df)) + 1 AS idf FROM m),
        a AS (SELECT i.f, pc.id, term, (1 + ln(tf)) * idf AS w FROM pc JOIN i USING (term) WHERE i.f = pc.id // 1000000000), av AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM a),
        b AS (SELECT i.f, vc.id, term, (1 + ln(tf)) * idf AS w FROM vc JOIN i USING (term) WHERE i.f = vc.id % {FOLDS}), bv AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM b)
        SELECT bv.id AS query_id, av.id % 1000000000 AS doc_id, round(sum(bv.u * av.u), 6) AS score FROM bv JOIN av USING (f, term) GROUP BY ALL"""


def _profiles(spark: SparkSession, d: str, analyzer: str, low: int, high: int) -> DataFrame:
    turns = cut(_turns(spark, d))
    ordered = F.array_sort(F.collect_list(F.struct("query_id", "query_clean")))
    articles = cut(turns.groupBy("doc_id").agg(F.min_by("query_clean", "query_id").alias("title_clean"), F.array_join(F.transform(ordered, lambda x: x["query_clean"]), " ").alias("body_clean")))
    return classify.profile_scores_by_folds(articles, turns, turns.select("query_id", "doc_id"), FOLDS, analyzer, low, high).withColumn("score", F.round("score", 6))


@_query(_profile_sql(lambda c: _words_sql(c, 1, 2)))
def profile_word(spark, d):
    return _profiles(spark, d, "word", 1, 2)


@_query(_profile_sql(lambda c: _chars_sql(c, 3, 6)))
def profile_char(spark, d):
    return _profiles(spark, d, "char_wb", 3, 6)


@_query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label AS c, round(list_inner_product(a.e, b.e), 9) AS s FROM v a, v b WHERE a.vec_id % 5 <> b.vec_id % 5),
    n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, t) AS r FROM s QUALIFY r <= 20),
    f AS (SELECT f, label AS c, count(*) AS k FROM embeddings JOIN (SELECT unnest(range(5)) AS f) ON vec_id % 5 <> f GROUP BY ALL)
    SELECT q AS query_id, n.c::BIGINT AS doc_id, round(sum(pow(greatest(s, 0), 8)) / pow(any_value(k), 0.3), 6) AS score FROM n JOIN f ON f.c = n.c AND f.f = n.q % 5 GROUP BY q, n.c""")
def dense_knn_label_transfer(spark, d):
    """Every fold is answered by the other four."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("long").alias("doc_id"))

    def answer(valid: DataFrame, train: DataFrame, labels: DataFrame) -> DataFrame:
        return neighbors.semantic_scores(_nine(neighbors.nearest_vectors(valid, train, 20)).drop("rank"), labels)

    return _every_fold(answer, vectors, vectors.select("query_id", "doc_id")).withColumn("score", F.round("score", 6))


@_query()
def lambda_rank(spark, d):
    """A boosted ranker on the pair features, each half of the items ranked by the model of the other half."""
    featured, labels = _featured(spark, d)
    rows = featured.join(labels.withColumn("label", F.lit(1.0)), ["query_id", "doc_id"], "left").fillna(0.0, ["label"])
    rows = cut(rows)
    features = [c for c in rows.columns if c not in ("query_id", "doc_id", "label")]
    half, out = evaluate.fold_of(F.col("query_id"), 2), None
    for k in range(2):
        one = ltr.LambdaMart().fit(rows.where(half != k), features).predict(rows.where(half == k))
        out = one if out is None else out.unionByName(one)
    return rank.top_k(out, 10).select("query_id", "doc_id", "score", "rank")
