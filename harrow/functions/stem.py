"""Russian Snowball stemming, from the published description of the algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The endings of the published algorithm, by class.
VOWELS = "аеиоуыэюя"
GERUND_1, GERUND_2 = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE_1, PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
VERB_2 = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют",
    "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом",
    "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
SUPERLATIVE, DERIVATIONAL = ("ейш", "ейше"), ("ост", "ость")

_REGION = re.compile(f"[{VOWELS}](.*)$", re.S)
_R1 = re.compile(f"[{VOWELS}][^{VOWELS}](.*)$", re.S)


def _cut(region: str, endings: tuple[str, ...], after: str = "") -> str | None:
    """The region without its longest ending of the class; with ``after`` one of those letters stays before it."""
    for e in sorted((e for e in endings if region.endswith(e)), key=len, reverse=True):
        left = region[: -len(e)]
        if not after or left[-1:] in tuple(after) and left:
            return left
    return None


def _either(region: str, first: tuple[str, ...], second: tuple[str, ...]) -> str | None:
    """The longer cut of two classes, of which the first must follow а or я."""
    cuts = [c for c in (_cut(region, first, "ая"), _cut(region, second)) if c is not None]
    return min(cuts, key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word; words without a Russian vowel stay."""
    word = word.replace("ё", "е")
    m = _REGION.search(word)
    if not m:
        return word
    start = m.start(1)
    head, region = word[:start], word[start:]
    r1 = _R1.search(word)
    r2 = _R1.search(word, r1.start(1)) if r1 else None
    r2_at = max(r2.start(1) - start, 0) if r2 else len(word)

    cut = _either(region, GERUND_1, GERUND_2)
    if cut is None:
        region = _cut(region, REFLEXIVE) if _cut(region, REFLEXIVE) is not None else region
        cut = _cut(region, ADJECTIVE)
        if cut is not None:
            before = _either(cut, PARTICIPLE_1, PARTICIPLE_2)
            cut = before if before is not None else cut
        else:
            cut = _either(region, VERB_1, VERB_2)
            cut = _cut(region, NOUN) if cut is None else cut
    region = region if cut is None else cut

    region = region.removesuffix("и")
    cut = _cut(region, DERIVATIONAL)
    if cut is not None and len(cut) >= r2_at:
        region = cut
    if region.endswith("нн"):
        region = region[:-1]
    elif (cut := _cut(region, SUPERLATIVE)) is not None:
        region = cut[:-1] if cut.endswith("нн") else cut
    else:
        region = region.removesuffix("ь")
    return head + region


@F.pandas_udf(StringType())
def stem_text(texts: pd.Series) -> pd.Series:
    """Every token of a normalised text stemmed."""
    return texts.map(lambda t: " ".join(stem(w) for w in t.split()), na_action="ignore")
