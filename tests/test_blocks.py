import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrow.operators import blocks, classify, neighbors
from harrow.operators.vector import BlockSpace, fit_tfidf
from harrow.plans import catalogue

# Numbers on either side of the dense columns.
NUMBERS = [0, 1, 2, blocks.DENSE - 1, blocks.DENSE, blocks.DENSE + 7, 90_000]


def sparse(rng, rows, share=0.6):
    return rng.random((rows, len(NUMBERS))) * (rng.random((rows, len(NUMBERS))) < share)


def table(spark, m, base=0, width=1):
    rows = [(base + i, NUMBERS[j], *([float(m[i, j])] * width)) for i in range(len(m)) for j in range(len(NUMBERS)) if m[i, j]]
    return spark.createDataFrame(rows, "id long, number int, " + ", ".join(f"w{k} double" for k in range(width)))


def scores(df, other="doc_id"):
    return {(r["query_id"], r[other]): r["score"] for r in df.collect()}


def test_products_by_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = sparse(rng, 9), sparse(rng, 14)
    got = scores(blocks.products(blocks.pack(table(spark, a), "id"), blocks.pack(table(spark, b, 100), "id")))
    want = a @ b.T
    assert got == {(i, 100 + j): pytest.approx(want[i, j]) for i in range(9) for j in range(14) if want[i, j]}


def test_variants_and_missing_vectors(spark):
    rng = np.random.default_rng(4)
    a, b = sparse(rng, 6, 0.9), sparse(rng, 5, 0.9)
    right = table(spark, b, 100, 2).withColumn("w1", F.when(F.col("id") != 102, 2 * F.col("w1")))  # 102 is missing in variant 1
    got = scores(blocks.products(blocks.pack(table(spark, a), "id", part=F.col("id") % 2), blocks.pack(right, "id", 2), every=True))
    assert got == {(i, 100 + j): pytest.approx((1 + i % 2) * (a @ b.T)[i, j]) for i in range(6) for j in range(5) if (i % 2, j) != (1, 2)}
    unit = scores(blocks.products(blocks.pack(table(spark, a), "id", unit=True), blocks.pack(table(spark, a), "id", unit=True)))
    assert all(unit[i, i] == pytest.approx(1) for i in range(6))


def test_nearest_breaks_ties_by_id_and_skips_the_own_fold(spark):
    m = np.array([[1.0] + [0.0] * 6] * 12)
    vectors = blocks.pack(table(spark, m), "id")
    got = neighbors.nearest_of_blocks(vectors, vectors, 3, 5).groupBy("query_id").agg(F.sort_array(F.collect_list("train_id")).alias("t")).collect()
    assert {r["query_id"]: r["t"] for r in got} == {q: [t for t in range(12) if t % 5 != q % 5][:3] for q in range(12)}


def test_nearest_is_that_of_the_similarities(spark):
    rng = np.random.default_rng(5)
    rows = table(spark, sparse(rng, 40)).withColumnsRenamed({"id": "query_id", "number": "term", "w0": "weight"})
    fold = lambda c: F.pmod(F.col(c), F.lit(5))
    joined = neighbors.similarities(rows, rows, fold("query_id") != fold("train_id")).withColumn("score", F.round("score", 9))
    vectors = blocks.pack(rows.withColumnsRenamed({"term": "number", "weight": "w0"}), "query_id")
    assert scores(neighbors.nearest_of_blocks(vectors, vectors, 7, 5), "train_id") == scores(neighbors.nearest(joined, 7), "train_id")


def labelled(spark):
    rng = np.random.default_rng(6)
    m = sparse(rng, 30, 0.5)
    vectors = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(30) for j in range(7) if m[i, j]], "query_id long, term string, weight double")
    # Class 9 has rows of one fold alone, query 7 two labels.
    labels = spark.createDataFrame([(i, 9 if i in (3, 13) else i % 4) for i in range(30)] + [(7, 2)], "query_id long, doc_id long")
    return m, vectors, labels


METHODS = {"rocchio": classify.rocchio, "cnb_05": lambda *a, **k: classify.complement_nb(*a, alpha=0.5, **k), "cnb_logproba": classify.complement_nb, "mnb_logproba": classify.multinomial_nb}


@pytest.mark.parametrize("name", METHODS)
def test_all_folds_at_once(spark, name):
    """What is answered fold by fold, classes without training rows left out."""
    m, vectors, labels = labelled(spark)
    got, want = scores(METHODS[name](vectors, vectors, labels, folds=5)), {}
    classes = {(r["query_id"], r["doc_id"]) for r in labels.collect()}
    for q in range(30):
        if not m[q].any():
            continue
        rows = {c: [i for i, d in classes if d == c and i % 5 != q % 5 and m[i].any()] for c in (0, 1, 2, 3, 9)}
        n = {c: m[i].sum(0) for c, i in rows.items() if i}
        f = sum(n.values())
        if name == "rocchio":
            one = {c: m[q] @ x / np.linalg.norm(m[q]) / np.linalg.norm(x) * np.linalg.norm(m[q]) for c, x in n.items()}
            one = {c: s for c, s in one.items() if s}
        elif name == "mnb_logproba":
            one = {c: np.log(len(rows[c]) / sum(map(len, rows.values()))) + m[q] @ np.log((x + 0.05) / (x + 0.05).sum()) for c, x in n.items()}
        else:
            alpha = 0.5 if name == "cnb_05" else 1.0
            one = {c: -(m[q] @ np.log((f + alpha - x) / (f + alpha - x).sum())) for c, x in n.items()}
        z = 0.0 if name == "rocchio" else np.log(np.exp(list(one.values())).sum())
        want |= {(q, c): pytest.approx(s - z) for c, s in one.items()}
    assert got == want


@pytest.mark.parametrize("name", METHODS)
def test_pairs_of_queries_and_classes_are_not_summed_by_shuffle(spark, name):
    _, vectors, labels = labelled(spark)
    plan = METHODS[name](vectors, vectors, labels, folds=5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange hashpartitioning(query_id" not in plan


@pytest.mark.parametrize("analyzer", ["word", "char_wb"])
def test_profiles_meet_in_blocks(spark, analyzer):
    docs = spark.createDataFrame([(1, "red fox and hen"), (2, "blue fish"), (3, "a red fish")], "doc_id long, profile string")
    queries = spark.createDataFrame([(7, "red fish"), (8, "fox"), (9, "zzz")], "query_id long, t string")
    by_join = fit_tfidf(docs, "doc_id", F.col("profile"), analyzer, 1, 2, 1, 12).score(queries, "query_id", F.col("t"))
    got = classify.profile_scores(docs, queries, F.col("t"), analyzer, 1, 2, 12)
    assert scores(got) == {k: pytest.approx(v) for k, v in scores(by_join).items()}
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        BlockSpace(analyzer, 1, 2).transform(docs, "doc_id", F.col("profile"))


def test_pairs_reach_python_in_small_batches_with_one_variant(spark):
    """Two tasks of an executor hold some batches each beside its heap; Spark's own limit is 64 MB a batch."""
    rows = spark.range(2400).select("id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("number"), *(F.lit(1.0 + k).alias(f"w{k}") for k in range(5)))
    left, right = blocks.pack(rows.select("id", "number", "w0"), "id", part=F.col("id") % 5), blocks.pack(rows, "id", 5)

    def sizes(batches):
        for batch in batches:
            pair = max(sum(batch.column(c)[i].as_buffer().size for c in range(batch.num_columns) if str(batch.schema.types[c]) == "binary") for i in range(batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes]), pa.array([pair])], names=["pairs", "bytes", "pair"])

    got = blocks._met(left, right, sizes, "pairs long, bytes long, pair long").agg(F.sum("pairs"), F.max("bytes"), F.max("pair")).first()
    assert got[0] == left.count() * right.count()
    assert got[1] <= 2 * blocks.BATCH and got[2] <= blocks.BATCH
    assert right.select(F.size("weights")).distinct().collect() == [(5,)]


@pytest.mark.parametrize("analyzer", ["word", "char_wb"])
def test_profiles_of_all_folds_in_one_run(spark, analyzer, monkeypatch):
    """What is answered fold by fold, by five fitted spaces; class 3 has labelled queries of one fold alone."""
    words = ["red", "fox", "a", "hen", "blue", "fish", "pond"]
    queries = spark.createDataFrame([(i, " ".join(words[(i * j + j) % 7] for j in range(1, 5))) for i in range(12)], "query_id long, query_clean string")
    labels = spark.createDataFrame([(i, 3 if i in (4, 9) else i % 3) for i in range(12)], "query_id long, doc_id long")
    articles = spark.createDataFrame([(0, "red fox", "a fox and a hen"), (1, "pond", ""), (2, None, "blue fish"), (3, "hen", "x" * 3998 + " fish")], "doc_id long, title_clean string, body_clean string")
    fold, want = F.pmod(F.col("query_id"), F.lit(5)), {}
    for k in range(5):
        profile = classify.profiles(articles, queries, labels.where(fold != k))
        want |= scores(classify.profile_scores(profile, queries.where(fold == k), F.col("query_clean"), analyzer, 1, 2, 9))
    fitted = []
    monkeypatch.setattr(BlockSpace, "fit", lambda self, *a: fitted.append(a))
    got = classify.profile_scores_by_folds(articles, queries, labels, 5, analyzer, 1, 2, 9)
    assert scores(got) == {k: pytest.approx(v) for k, v in want.items()} and not fitted


def test_blocks_of_texts_are_small_and_exact(spark):
    """TF-IDF weights have few values before vectors are scaled; a block took 12 bytes an entry, four numbers and a length besides."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words[j] for j in (300 * rng.random(60) ** 2).astype(int))) for i in range(400)], "query_id long, t string")
    vectors = BlockSpace("char_wb", 3, 5).fit(docs, "query_id", F.col("t")).transform(docs, "query_id", F.col("t"))
    got, n, size = {}, 0, 0
    for b in vectors.collect():
        row, term, weight = blocks.entries(*(pa.py_buffer(x) for x in (b["terms"], b["rows"], b["base"], b["weights"][0])))
        ids = np.frombuffer(b["ids"], np.int64)
        got |= {int(i): np.sort(weight[row == k]) for k, i in enumerate(ids)}
        n, size = n + len(row), size + sum(map(len, (b["ids"], b["terms"], b["rows"], b["base"], b["weights"][0])))
    want = {}
    for r in fit_tfidf(docs, "query_id", F.col("t"), "char_wb", 3, 5).postings.collect():
        want.setdefault(r["doc_id"], []).append(r["weight"])
    assert got.keys() == want.keys() and all(np.allclose(got[i], np.sort(want[i])) for i in want)
    assert size < 6 * n


def test_nearest_leave_a_task_as_one_row_a_query(spark):
    vectors = blocks.pack(table(spark, sparse(np.random.default_rng(8), 40, 0.9)), "id")
    near = neighbors.nearest_of_blocks(vectors, vectors, 7, 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "scores#" in plan and "Window" not in plan and near.count() == 40 * 7


@pytest.mark.parametrize("name", ["knn_char_sum", "knn_char_max"])
def test_neighbours_meet_their_labels_without_a_shuffle(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning(train_id" not in plan


def test_variants_that_agree_are_kept_once(spark):
    """Of a class's weights in five folds mostly those of the folds that hold its rows differ; each was kept five times."""
    rng = np.random.default_rng(9)
    rows = [(i, j, *(None if k == (i + j) % 5 else x if (i * j + k) % 9 else x / 2 for k in range(5))) for i in range(60) for j in range(200) for x in (float(rng.random()) + 0.1,)]
    made = blocks.pack(spark.createDataFrame(rows, "id long, number int, " + ", ".join(f"w{k} double" for k in range(5))), "id", 5).collect()
    want = {(r[0], r[1]): r[2:] for r in rows}
    for b in made:
        ids = np.frombuffer(b["ids"], np.int64)
        for k in range(5):
            row, term, weight = blocks.entries(*(pa.py_buffer(x) for x in (b["terms"], b["rows"], b["base"], b["weights"][k])))
            assert all(np.isnan(w) if (x := want[int(ids[i]), int(t)][k]) is None else w == x for i, t, w in zip(row, term, weight, strict=True))
    assert sum(b["size"] for b in made) < 20 * len(rows)


def test_profiles_of_words_are_dealt_as_one_row_a_class(spark):
    queries = spark.createDataFrame([(i, f"red fox {i}") for i in range(10)], "query_id long, query_clean string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "query_id long, doc_id long")
    articles = spark.createDataFrame([(0, "a hen", "a hen on a pond"), (1, None, "blue fish"), (2, "no queries", "")], "doc_id long, title_clean string, body_clean string")
    rows = classify._fold_pieces(articles, queries, labels, 5, "word", "title_clean", "body_clean", "query_clean")
    assert rows.count() == 3
    got = {(r["doc_id"], r["seen"]): r["text"].split() for r in classify._fold_profiles(rows, 5).collect()}
    fold = F.pmod(F.col("query_id"), F.lit(5))
    want = {(r["doc_id"], 1 << k): r["profile"].split() for k in range(5) for r in classify.profiles(articles, queries, labels.where(fold != k)).collect()}
    assert got == want
