from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.functions import html, text
from harrow.functions.stem import stem
from harrow.operators import spell
from harrow.operators.prepare import prepare_articles, prepare_queries


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_normalise(spark):
    cases = {
        "Привет, Ёлка! www.a.b/c x_y": "привет елка x y", "a&amp;b&nbsp;c": "a b c", "www.a&nbsp;b": "b", "": "", None: "", "  A  ": "a",
    }
    for value, want in cases.items():
        assert one(spark, value, text.normalize_text) == want


def test_noise_and_counts(spark):
    assert one(spark, "здравствуйте подскажите добрый день как привет привет123", text.remove_noise) == "как привет123"
    assert one(spark, "", text.token_count) == 0
    assert one(spark, "a b", text.token_count) == 2


def test_ngrams(spark):
    assert one(spark, "кот", lambda c: text.char_wb_ngrams(c, 3, 5)) == [" ко", "кот", "от ", " кот", "кот ", " кот "]
    assert one(spark, "a bb cc", lambda c: text.word_ngrams(c, 1, 2)) == ["bb", "cc", "bb cc"]
    assert one(spark, "aa bb cc dd", lambda c: text.word_ngrams(c, 2, 3)) == ["aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"]
    assert one(spark, "", lambda c: text.word_ngrams(c, 1, 3)) == []


def test_ids(spark):
    assert one(spark, "1909  4396", text.parse_ids) == [1909, 4396]
    assert one(spark, "", text.parse_ids) == []


def test_stems():
    known = "важная важн;важнейшими важн;важничал важнича;важностию важност;валандался валанда;валериановых валерианов;павлиньим павлин;падающего пада;падением паден;падучая падуч;table table"
    for pair in known.split(";"):
        word, want = pair.split()
        assert stem(word) == want


def test_html(spark):
    body = '<h2><strong>x</strong></h2><script>var a="</p>"</script><a href="/articles/12">t</a><img alt="pic"><!-- /articles/3 --><input value="q"><p>open'
    row = html.extract_fields(spark.createDataFrame([(body,), (None,)], "body string"), "body").collect()
    assert row[0].asDict() == {"body": body, "visible": "x t open", "important": "x x", "anchors": "t", "alt_text": "pic", "intro": "x t open", "internal_links": [3, 12]}
    assert row[1]["visible"] == "" and row[1]["internal_links"] == []


def test_spelling(spark):
    vocab = spark.createDataFrame([("заказ", 5), ("показ", 2)], "word string, n long")
    queries = spark.createDataFrame([(1, "закзз абв 12345 xxxxxxxx"), (2, "")], "query_id long, t string")
    got = {r["query_id"]: r["query_spell"] for r in spell.fix(queries, "t", vocab).collect()}
    assert got == {1: "заказ абв 12345 xxxxxxxx", 2: ""}


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_distance_is_symmetric(a, b):
    assert spell.edit_distance(a, b) == spell.edit_distance(b, a)
    assert (spell.edit_distance(a, b) == 0) == (a == b)


def test_distance_counts_a_swap_once():
    assert spell.edit_distance("abcd", "abdc") == 1
    assert spell.edit_distance("ca", "abc") == 3


def test_prepare(spark):
    articles = spark.createDataFrame([(7, "Заказ", "<p>заказы отменить</p>"), (8, None, None)], "article_id int, title string, body string")
    ready = prepare_articles(articles)
    vocab = spell.vocabulary(ready, "title_clean", "body_clean")
    queries = prepare_queries(spark.createDataFrame([(1, "Привет! отмениить закз")], "query_id long, query_text string"), vocab).first()
    assert ready.where("doc_id = 7").first()["body_stem"] == "заказ отмен"
    assert (queries["query_core"], queries["query_spell"], queries["token_count"]) == ("отмениить закз", "отменить заказ", 3)
