"""Word by word ids against the library on made-up texts, and the schedule's laws."""

import random
from itertools import pairwise

import numpy as np
import pytest

import public_tokenizers
from harrow.llm import packing
from harrow.llm.packing import Schedule

PATH = public_tokenizers.path("word_bpe_49k.json")
#: All of ASCII, control characters included, and characters that compose, fold or count as space, letter or digit.
ALPHABET = [chr(c) for c in range(128)] * 2 + list("abcABC xyz.,'s't  \n") * 6 + list("éÀİßſKÅﬁ你好привет̸́̈\u0085　ΣςКй̆१²½")


def test_ids_of_made_up_texts():
    from tokenizers import Tokenizer

    tokenizer, dice = Tokenizer.from_file(PATH), random.Random(5)
    texts = ["".join(dice.choice(ALPHABET) for _ in range(dice.randint(0, 40))) for _ in range(20_000)]
    texts += ["", "<|startoftext|> a", "don't WE'LL 'S x's", "0.\x1e", "a!\x00", "end.\x7f next", "x" * 5000, "a\n" * 3000]
    for text, ids in zip(texts, packing.tokenize(PATH, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_another_kind_of_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello, world!  two\n", "", "é x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.tokenize(path, texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("weighted", [False, True])
def test_schedule(weighted):
    dice = random.Random(1)
    for _ in range(200):
        totals = [dice.randint(1, 300) for _ in range(dice.randint(1, 6))]
        weights = [dice.random() + 0.1 for _ in totals] if weighted else None
        share = weights or totals
        if min(share) * 16 < sum(share):
            continue
        schedule, windows = Schedule(totals, 16, weights), -(-sum(totals) // 16)
        served = [schedule.served(k)[0] for k in range(windows + 1)]
        assert all(sum(s) == min(16 * k, sum(totals)) for k, s in enumerate(served)) and served[-1] == totals
        assert all(x <= y for a, b in pairwise(served) for x, y in zip(a, b, strict=True))
        for q, n in enumerate(totals):
            for t in range(n):
                w = schedule.window_of(q, t)
                assert served[w][q] <= t < served[w + 1][q]


def test_many_sources_hold_the_mixture(spark):
    """300 equal sources: each sequence holds every source, one small source shares a queue, no id is lost."""
    rows = [(i, "word " * 40, f"s{i % 300}") for i in range(3000)] + [(9999, None, "tiny"), (9998, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(docs, PATH, length=1024).toPandas()
    assert got.groupby("doc_id")["length"].sum().equals(got.groupby("doc_id")["doc_tokens"].first())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    full = got[got["sequence_id"] < got["sequence_id"].max()]
    share = full[full["source"].str.startswith("s")].groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    assert share.shape[1] == 300 and share.min().min() >= 2 and share.max().max() <= 5
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, length=1024, weights={"s1": 1.0})
