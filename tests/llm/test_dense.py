"""Recall where many distinct near copies lie close together, with the query's own parameters."""

import numpy as np
import pytest

from harrow.llm import vector_dedup


@pytest.mark.parametrize("hot", [0.05, 0.33])
def test_vectors_of_a_dense_group(spark, hot):
    rng, n = np.random.default_rng(1), 6000
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    v = unit(rng.normal(size=(n, 64)))
    v[n // 2 : n // 2 + 600] = unit(v[:600] + unit(rng.normal(size=(600, 64))) * rng.uniform(0.1, 0.35, size=(600, 1)))  # pairs of near copies
    at = rng.permutation(n)[: int(hot * n)]
    cosine = rng.uniform(0.95, 0.99, size=(len(at), 1))
    aside = rng.normal(size=(len(at), 64))
    aside[:, 0] = 0
    v[at] = unit(aside) * np.sqrt(1 - cosine**2)
    v[at, 0] = cosine[:, 0]
    table = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_dedup.group_vectors(table, least=0.93).collect()}
    link = v @ v.T >= 0.93
    want, found = link.sum(1) - 1, np.array([got[i]["n_links"] for i in range(n)])
    dense = np.isin(np.arange(n), at)
    print(hot, "dense", found[dense].sum() / want[dense].sum(), "others", found[~dense].sum() / want[~dense].sum())
    assert (found[dense] == want[dense]).all() and (found <= want).all()
    assert found[~dense].sum() >= 0.9 * want[~dense].sum()
    linked = {got[i]["component_id"] for i in at if want[i]}
    assert len(linked) == 1


def test_floats_give_the_links_of_doubles(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    v[200:] = v[:200] + rng.normal(size=(200, 16)).astype(np.float32) * np.float32(0.25)
    rows = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, rows[0][1], 0), (404, [1e-30] * 16, None)]
    tables = [spark.createDataFrame(rows, f"vec_id long, embedding array<{t}>, label int") for t in ("float", "double")]
    one, two = ({r["vec_id"]: tuple(r) for r in vector_dedup.group_vectors(t, least=0.93).collect()} for t in tables)
    assert one == two and len(one) == len(rows)
    assert one[403][1] >= 1 and one[400][1:] == (0, 400, True)
