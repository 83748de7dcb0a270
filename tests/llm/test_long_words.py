"""Words too long for merge rounds against the library, at and around the limit between the two ways."""

import random

import numpy as np
import pytest

import public_tokenizers
from harrow.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["ab", "etaoinshrdlu", "ABCxyz0189+/", "заяцпривет", "漢字かな交じり文", "é́x\x00▁", " ", "a b\n"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def ids(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in codec.encode_texts(PATH, texts)]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_around_the_limit(library, alphabet):
    dice = random.Random(3)
    texts = ["".join(dice.choices(alphabet, k=n)) for n in (1, codec.LONG_WORD - 1, codec.LONG_WORD, codec.LONG_WORD + 1, 700, 4000)]
    assert ids(texts) == [library.encode(t) for t in texts]


def test_very_long(library):
    dice = random.Random(4)
    texts = ["".join(dice.choices("ABCDEFabcdef0123456789+/", k=200_000)), "a" * 200_000, "漢" * 50_000]
    assert ids(texts) == [library.encode(t) for t in texts]


def test_both_ways_agree(library):
    dice = random.Random(5)
    one = codec.Codec(PATH)
    for _ in range(50):
        word = " " + "".join(dice.choices("etaoinshrdlué漢", k=dice.randint(2, codec.LONG_WORD)))
        left = one._merge_long(one._symbols(word))
        assert one._with_bytes(np.zeros(len(left), dtype=np.int32), left)[1].tolist() == np.frombuffer(one.encode_words([word])[0], "<i4").tolist()
