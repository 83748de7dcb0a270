import math

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.operators import classify, evaluate, graph, ltr, neighbors, pairs, rank
from harrow.operators.vector import BM25Index, QueryFeatureSpace, fit_tfidf
from harrow.plans import runs
from harrow.sources import tables
from harrow.sources.feather import read_feather
from harrow.streaming.score import answer_stream


def scores(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double")


def as_dict(df, *keys, value="score"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa aa cc"), (3, "")], "doc_id long, t string")
    queries = spark.createDataFrame([(9, "aa zz")], "query_id long, t string")
    with pytest.raises(ValueError):
        BM25Index().score(queries, "query_id", F.col("t"))
    got = as_dict(BM25Index(1, 1).fit(docs, "doc_id", F.col("t")).score(queries, "query_id", F.col("t")), "doc_id")
    idf, mean = math.log1p((3 - 2 + 0.5) / 2.5), 5 / 3
    weigh = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) * idf
    assert got == {(1,): pytest.approx(weigh(1, 2)), (2,): pytest.approx(weigh(2, 3))}


def test_tfidf_is_a_cosine(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa aa cc")], "doc_id long, t string")
    got = as_dict(fit_tfidf(docs, "doc_id", F.col("t"), "word", 1, 1).score(docs.withColumnRenamed("doc_id", "query_id"), "query_id", F.col("t")), "query_id", "doc_id")
    idf = {"aa": 1.0, "bb": math.log(3 / 2) + 1, "cc": math.log(3 / 2) + 1}
    a, b = np.array([1.0, idf["bb"], 0]), np.array([1 + math.log(2), 0, idf["cc"]])
    assert got[1, 2] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert got[1, 1] == pytest.approx(1)


def test_query_space_renormalises_empty_halves(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "ab cd")], "query_id long, t string")
    vectors = QueryFeatureSpace().fit(queries, "query_id", F.col("t")).transform(queries, "query_id", F.col("t"))
    norms = as_dict(vectors.groupBy("query_id").agg(F.sum(F.col("weight") ** 2).alias("score")), "query_id")
    assert norms == {(1,): pytest.approx(1), (2,): pytest.approx(1)}


def test_ranks(spark):
    table = scores(spark, [(1, 5, 1.0), (1, 3, 1.0), (1, 9, 2.0)])
    for n in (1, 3):
        assert [r["doc_id"] for r in rank.top_k(table.repartition(n), 2).orderBy("rank").collect()] == [9, 3]
    assert as_dict(rank.reciprocal_rank(table, 2, 10), "doc_id") == {(9,): pytest.approx(1 / 11), (3,): pytest.approx(1 / 12)}
    assert as_dict(rank.rank_power(table, 0.5), "doc_id")[(5,)] == pytest.approx(math.sqrt(0.8))
    with pytest.raises(ValueError):
        rank.blend_base([table], table)


def test_z_scores_count_the_fill(spark):
    dense = np.array([1.0, 2.0, 4.0, -1.0, -1.0])
    z = rank.z_scores(scores(spark, [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 4.0)]), 5, -1.0)
    want = (dense - dense.mean()) / (dense.std() + 1e-6)
    assert [r["z"] for r in z.orderBy("doc_id").collect()] == pytest.approx(want[:3].tolist())
    assert z.first()["z_fill"] == pytest.approx(want[3])
    assert as_dict(rank.z_scores(scores(spark, [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 4.0)]), 3), "doc_id", value="z")[(3,)] == pytest.approx((4 - 7 / 3) / (1.2472191289 + 1e-6))


def test_average_precision(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    labels = spark.createDataFrame([(1, 10), (1, 12)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert as_dict(evaluate.average_precision(ranking, labels, queries), "query_id", value="ap") == {(1,): pytest.approx((1 + 2 / 3) / 2), (2,): 0.0}


def test_labels(spark):
    truth = spark.createDataFrame([(1, "1909 4396"), (2, "1909"), (3, "7 7")], "query_id long, truth string")
    assert evaluate.parse_labels(truth, "query_id", "truth").count() == 4
    docs = spark.createDataFrame([(1909,)], "doc_id long")
    with pytest.raises(Exception, match="unknown document"):
        evaluate.parse_labels(truth, "query_id", "truth", docs).collect()


def test_folds(spark):
    frame = spark.range(500).withColumnRenamed("id", "query_pos")
    folds = {r["query_pos"]: r["fold"] for r in evaluate.shuffled_folds(frame, 500).collect()}
    assert [folds[p] for p in (361, 73, 374, 155)] == [0] * 4
    assert sorted(np.bincount(list(folds.values()))) == [100] * 5


def test_validator(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"))
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    ten = " ".join(map(str, range(10)))
    make = lambda a, b: spark.createDataFrame([(1, a), (2, b)], "query_id long, answer string")
    evaluate.validate_answer(make(ten, ten), queries, docs)
    for bad, rule in ((ten[:-2], "length"), (ten[:-1] + "0", "repeated"), (ten[:-1] + "99", "unknown")):
        with pytest.raises(ValueError, match=rule):
            evaluate.validate_answer(make(ten, bad), queries, docs)
    with pytest.raises(ValueError, match="queries"):
        evaluate.validate_answer(make(ten, ten).limit(1), queries, docs)
    with pytest.raises(ValueError, match="columns"):
        evaluate.validate_answer(make(ten, ten).withColumnRenamed("answer", "x"), queries, docs)
    with pytest.raises(ValueError, match="order"):
        evaluate.validate_order(spark.createDataFrame([(1, 1), (2, 0)], "query_id long, query_pos long"), spark.createDataFrame([(1, 0), (2, 1)], "query_id long, query_pos long"))


def test_links(spark):
    articles = spark.createDataFrame([(1, [2, 3, 1]), (2, [3]), (3, [99])], "doc_id long, links array<long>")
    assert as_dict(graph.link_graph(articles, "doc_id", "links"), "src_id", "dst_id", value="weight") == {(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5}


def test_naive_bayes_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((12, 6)) * (rng.random((12, 6)) < 0.6), np.arange(12) % 3
    v = rng.random((4, 6)) * (rng.random((4, 6)) < 0.7)
    table = lambda m, base: spark.createDataFrame([(base + i, f"t{j}", float(m[i, j])) for i in range(len(m)) for j in range(6) if m[i, j]], "query_id long, term string, weight double")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "query_id long, doc_id long")
    n = np.array([x[y == c].sum(0) for c in range(3)])
    norm = lambda j: j - np.log(np.exp(j).sum(1, keepdims=True))
    mnb = norm(v @ np.log((n + 0.05) / (n + 0.05).sum(1, keepdims=True)).T + np.log(1 / 3))
    comp = n.sum(0) + 1 - n
    cnb = norm(-(v @ np.log(comp / comp.sum(1, keepdims=True)).T))
    for got, want in ((classify.multinomial_nb(table(v, 100), table(x, 0), labels, 0.05), mnb), (classify.complement_nb(table(v, 100), table(x, 0), labels, 1.0), cnb)):
        for (q, c), s in as_dict(got, "query_id", "doc_id").items():
            assert s == pytest.approx(want[q - 100, c])


def test_svc_separates(spark):
    train = spark.createDataFrame([(i, "a" if i % 2 else "b", 1.0) for i in range(8)], "query_id long, term string, weight double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "query_id long, doc_id long")
    got = as_dict(classify.linear_svc(train.where("query_id < 2"), train, labels, 1.0), "query_id", "doc_id")
    assert got[1, 1] > 0 > got[1, 0] and got[0, 0] > 0 > got[0, 1]
    few = classify.linear_svc(train, train, labels, 1.0, max_rows=6)  # a bounded sample is fitted, every row is scored
    assert {r["query_id"] for r in few.collect()} == set(range(8))


def test_soft_neighbours_are_filled_up(spark):
    sims = spark.createDataFrame([(9, 1, 0.5)], "query_id long, train_id long, score double")
    labels = spark.createDataFrame([(1, 7), (2, 8)], "query_id long, doc_id long")
    train = spark.createDataFrame([(1,), (2,)], "train_id long")
    got = as_dict(neighbors.knn_soft(sims, labels, train, spark.createDataFrame([(9,)], "query_id long"), 2), "doc_id")
    assert got == {(7,): pytest.approx(1.0), (8,): pytest.approx(math.exp(-0.5 / 0.07))}


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 4))
    table = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "query_id long, embedding array<double>")
    got = neighbors.nearest_vectors(table.where("query_id < 7"), table, 3, block=3).collect()
    want = {(q, t) for q in range(7) for t in np.argsort(-(m @ m[q]))[:3]}
    assert {(r["query_id"], r["train_id"]) for r in got} == want


def test_pair_features(spark):
    table = spark.createDataFrame([(1, 1, "s", 2.0), (1, 2, "s", 1.0), (1, 1, "t", 1.0)], "query_id long, doc_id long, source string, score double")
    chosen = spark.createDataFrame([(1, 1), (1, 3)], "query_id long, doc_id long")
    got = {r["doc_id"]: r for r in pairs.pair_features(chosen, table, {"s": 0.0, "t": -1.0}, 4).collect()}
    s = np.array([2.0, 1, 0, 0])
    assert got[1]["s_z"] == pytest.approx((2 - s.mean()) / (s.std() + 1e-6)) and got[3]["s_z"] == pytest.approx(-s.mean() / (s.std() + 1e-6))
    assert (got[3]["t"], got[3]["t_rr"], got[1]["ranks_at_01"], got[1]["ranks_at_005"]) == (-1.0, 0.0, 0, 2)
    assert got[1]["rank_mean"] == pytest.approx(1 / 11)


@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 2)), min_size=2, max_size=8))
def test_lambdas_cancel_out(rows):
    g, h = ltr.lambdas(np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]))
    assert abs(g.sum()) < 1e-9 and (h >= 0).all()


def test_lambda_mart_learns(spark):
    rows = [(q, d, float(d == q % 5), float(d == q % 5) + 0.01 * d) for q in range(20) for d in range(5)]
    table = spark.createDataFrame(rows, "query_id long, doc_id long, label double, f double")
    model = ltr.LambdaMart(trees=2, depth=2, min_rows=1, row_share=1.0).fit(table, ["f"])
    best = rank.top_k(model.predict(table), 1).collect()
    assert all(r["doc_id"] == r["query_id"] % 5 for r in best)


def test_baseline_and_files(spark, tmp_path):
    labels = spark.createDataFrame([(1, 3), (2, 3), (2, 4)], "query_id long, doc_id long")
    docs = spark.range(12).select(F.col("id").alias("doc_id"))
    answer = runs.popularity_baseline(labels, docs, labels.select("query_id").distinct())
    assert {r["answer"] for r in answer.collect()} == {"3 4 0 1 2 5 6 7 8 9"}
    tables.write_answer(answer, str(tmp_path / "answer"))
    assert tables.read_answer(spark, str(tmp_path / "answer")).count() == 2
    (tmp_path / "r.csv").write_text("approach,map\nA LambdaMART,0.6\nB,0.5\n")
    assert tables.read_results(spark, str(tmp_path / "r.csv"), pattern="LambdaMART|LightGBM").count() == 1
    assert tables.read_results(spark, str(tmp_path / "r.csv"), approaches=["B"]).count() == 1


def test_feather(spark, tmp_path):
    path = str(tmp_path / "a.f")
    feather.write_feather(pa.table({"article_id": [1, 2, 3], "title": ["a", None, "c"], "body": ["x", "y", "z"]}), path, chunksize=2)
    assert read_feather(spark, path).orderBy("article_id").collect()[1]["title"] is None
    assert [tuple(r) for r in read_feather(spark, path, ["body", "article_id"]).orderBy("article_id").collect()] == [("x", 1), ("y", 2), ("z", 3)]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fish")], "doc_id long, t string")
    index = BM25Index(1, 1).fit(docs, "doc_id", F.col("t"))
    spark.createDataFrame([(1, "Fox?"), (2, "blue")], "query_id long, query_text string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("query_id long, query_text string").parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda q: index.score(q, "query_id", F.col("query_clean")), lambda df, n: got.extend(df.collect()), str(tmp_path / "check")).awaitTermination()
    assert {(r["query_id"], r["answer"]) for r in got} == {(1, "1"), (2, "2")}


def test_lambdas_of_many_rows_by_brute_force():
    rng = np.random.default_rng(2)
    score, label = np.round(rng.normal(size=60), 1), rng.integers(0, 3, 60).astype(float)
    rank_ = np.empty(60)
    rank_[np.lexsort((np.arange(60), -score))] = np.arange(60)
    gain, ideal = 2.0**label - 1, ((2.0 ** np.sort(label)[::-1] - 1) / np.log2(np.arange(60) + 2)).sum()
    want, curve = np.zeros(60), np.zeros(60)
    for i in range(60):
        for j in range(60):
            if label[i] > label[j]:
                change = abs((gain[i] - gain[j]) * (1 / np.log2(rank_[i] + 2) - 1 / np.log2(rank_[j] + 2))) / ideal
                p = 1 / (1 + np.exp(score[i] - score[j]))
                want += change * p * ((np.arange(60) == i) * 1.0 - (np.arange(60) == j))
                curve += change * p * (1 - p) * ((np.arange(60) == i) * 1.0 + (np.arange(60) == j))
    g, h = ltr.lambdas(score, label)
    assert g == pytest.approx(want) and h == pytest.approx(curve)


def test_lambdas_take_no_room_with_the_square_of_the_rows():
    import tracemalloc

    label = np.zeros(4000)
    label[:3] = 1.0
    tracemalloc.start()
    ltr.lambdas(np.linspace(0, 1, 4000), label)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000  # all pairs of 4,000 rows take 128 MB a matrix


def test_features_read_no_score_table_more_than_four_times(spark, tmp_path):
    spark.createDataFrame([(1, 1, "s", 2.0), (1, 2, "s", 1.0), (2, 5, "s", 1.0)], "query_id long, doc_id long, source string, score double").write.parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    chosen = spark.createDataFrame([(1, 1), (1, 3)], "query_id long, doc_id long")
    plan = pairs.pair_features(chosen, table, {"s": 0.0}, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4 and "LeftSemi" in plan


def test_svc_brings_no_training_row_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = rng.random((24, 6)) * (rng.random((24, 6)) < 0.7)
    m[:, 0] += 0.1
    rows = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(24) for j in range(6) if m[i, j]], "query_id long, term string, weight double")
    labels = spark.createDataFrame([(i, i % 3) for i in range(24)], "query_id long, doc_id long")
    monkeypatch.setattr(type(rows), "toPandas", lambda self: pytest.fail("rows went to the driver"))
    got = as_dict(classify.linear_svc(rows, rows, labels, 0.3), "query_id", "doc_id")
    at = [np.flatnonzero(v) for v in m]
    for c in range(3):
        w = classify._fit_squared_hinge(at, [v[x] for v, x in zip(m, at, strict=True)], np.array([1.0 if i % 3 == c else -1.0 for i in range(24)]), 6, 0.3)
        assert [got[i, c] for i in range(24)] == pytest.approx(list(m @ w[:-1] + w[-1]), abs=1e-3)


def test_svc_fits_every_row_of_a_large_table(spark):
    train = spark.range(50_001).select(F.col("id").alias("query_id"), F.lit("a").alias("term"), F.lit(1.0).alias("weight"))
    last = train.orderBy(F.xxhash64("query_id").desc(), F.desc("query_id")).first()["query_id"]  # the one that a cut at 50,000 rows lost
    got = classify.linear_svc(train.where("query_id < 2"), train, spark.createDataFrame([(last, 7)], "query_id long, doc_id long"), 0.001)
    assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == {(0, 7), (1, 7)}


def test_svc_scores_where_it_fits(spark):
    rng = np.random.default_rng(3)
    m = rng.random((1200, 40)) * (rng.random((1200, 40)) < 0.2)
    m[:, 0] += 0.1
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    rows = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(1200) for j in range(40) if m[i, j]], "query_id long, term string, weight double")
    asked = rows.where("query_id < 50").unionByName(spark.createDataFrame([(9999, "never seen", 1.0)], "query_id long, term string, weight double"))
    made = classify.linear_svc(asked, rows, spark.createDataFrame([(i, i % 400) for i in range(4)], "query_id long, doc_id long"), 0.3)
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no table of terms of classes is summed
    got = as_dict(made, "query_id", "doc_id")
    at = [np.flatnonzero(v) for v in m]
    for c in range(4):
        w = classify._fit_squared_hinge(at, [v[x] for v, x in zip(m, at, strict=True)], np.array([1.0 if i == c else -1.0 for i in range(1200)]), 40, 0.3)
        assert [got[i, c] for i in range(50)] == pytest.approx(list(m[:50] @ w[:-1] + w[-1]), abs=2e-3)
        assert got[9999, c] == pytest.approx(w[-1], abs=2e-3)


def test_lambdas_meet_by_score(monkeypatch):
    rng, seen, plain = np.random.default_rng(5), [], np.exp
    score, label = rng.integers(0, 6, 3000) / 4, (rng.random(3000) < 0.2) * 1.0
    monkeypatch.setattr(np, "exp", lambda x: seen.append(np.size(x)) or plain(x))
    g, h = ltr.lambdas(score, label)
    assert sum(seen) <= 36 and abs(g.sum()) < 1e-9 and (h >= 0).all()  # six scores meet, not 600 rows with 2,400
