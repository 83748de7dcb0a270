"""The pipeline's near stage: how many of the pairs within its radius, and of similar texts, it finds."""

import random

import numpy as np

import corpus_pipeline as pipeline
from harrow.llm import simhash

WIDTH = 64 * pipeline.LANES


def test_pairs_within_the_radius_meet(spark):
    rng, n = np.random.default_rng(2), 2000
    a = rng.integers(0, 2, size=(n, WIDTH), dtype=np.uint8)
    b, apart = a.copy(), rng.integers(1, pipeline.RADIUS + 4, size=n)
    for i, k in enumerate(apart):
        b[i, rng.permutation(WIDTH)[:k]] ^= 1
    fp = np.packbits(np.concatenate([a, b]), axis=1, bitorder="little").view("<i8")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(fp)], "node long, fp array<long>")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_links(rows, pipeline.RADIUS, pipeline.BLOCKS, pipeline.REACH).collect()}
    want = {(i, i + n) for i in np.flatnonzero(apart <= pipeline.RADIUS).tolist()}
    edge = {(i, i + n) for i in np.flatnonzero(apart >= pipeline.RADIUS - 3).tolist()} & want
    print("found", len(got & want) / len(want), "of the last four bits", len(got & edge) / len(edge))
    assert got <= want and len(got & want) >= 0.99 * len(want) and len(got & edge) >= 0.96 * len(edge)


def test_all_pairs_of_the_querys_blocks_meet(spark):
    """op8's own radius and blocks lose nothing."""
    rng, n = np.random.default_rng(3), 3000
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    b, apart = a.copy(), rng.integers(1, 6, n)
    for i, k in enumerate(apart):
        for bit in rng.permutation(64)[:k].tolist():
            b[i] ^= np.uint64(1 << bit)
    rows = spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(np.concatenate([a, b]).view(np.int64))], "node long, fp array<long>")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_links(rows, 3, [(0, 32), (32, 32)], 1).collect()}
    assert got == {(i, i + n) for i in np.flatnonzero(apart <= 3).tolist()}


def test_recall_on_texts(spark):
    """Copies with changed, cut and added words, against the Jaccard similarity of their five-word shingles."""
    dice = random.Random(3)
    words = ["".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 9))) for _ in range(20_000)]
    texts, similar = [], []

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for _ in range(900):
        own = [dice.choice(words) for _ in range(dice.choice([30, 80, 150, 400]))]
        rate = dice.choice([0.005, 0.01, 0.015, 0.02, 0.03, 0.1])
        copy = [dice.choice(words) if dice.random() < rate else w for w in own][int(len(own) * max(0, dice.random() - 0.7) * 0.5) :]
        a, b = shingles(own), shingles(copy)
        similar.append(len(a & b) / len(a | b))
        texts += [" ".join(own), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = simhash.group_near(docs, shingle=pipeline.SHINGLE, radius=pipeline.RADIUS, lanes=pipeline.LANES, blocks=pipeline.BLOCKS, reach=pipeline.REACH, link_empty=False)
    group = {r["doc_id"]: r["component"] for r in found.collect()}
    linked, similar = np.array([group[2 * i] == group[2 * i + 1] for i in range(len(similar))]), np.array(similar)
    for low, high in ((0, 0.5), (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        at = (similar >= low) & (similar < high)
        print(low, at.sum(), linked[at].mean())
    assert linked[similar >= 0.8].mean() >= 0.95 and linked[(similar >= 0.8) & (similar < 0.85)].mean() >= 0.9
    assert linked[similar < 0.5].mean() == 0 and linked[(similar >= 0.5) & (similar < 0.6)].mean() <= 0.1
    assert all(group[2 * i] >= 2 * i for i in range(len(similar)))
