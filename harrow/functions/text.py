"""Text normalisation, tokens and n-grams as column expressions.

All but entity decoding run in the JVM.  Null counts as the empty text throughout.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on: the patterns and phrases of the cleaning rules.
URL = r"https?://(?U:\S+)|www\.(?U:\S+)"
NON_TEXT = "[^0-9a-zа-я]+"
NOISE_PHRASES = [
    "здравствуйте", "здраствуйте", "здравствуй", "привет", "добрый (?:день|вечер|утро)", "подскажите", "скажите", "пожалуйста",
    "будьте добры", "можете подсказать", "хочу узнать", "у меня вопрос",
]


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def normalize_text(text: Column, entities: bool = True) -> Column:
    """Entities decoded, lower case, ё as е, addresses out, all but letters and digits as single spaces.

    ``entities=False`` skips the one step that needs Python, for text that holds no entities.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.translate(F.lower(_unescape(text) if entities else text), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, URL, " "), NON_TEXT, " "))


def remove_noise(clean: Column) -> Column:
    """Greetings and opening phrases out of a normalised text."""
    phrases = "|".join(p.replace(" ", r"\s+") for p in NOISE_PHRASES)
    return F.trim(F.regexp_replace(F.regexp_replace(clean, f"(?<![0-9a-zа-я])(?:{phrases})(?![0-9a-zа-я])", " "), r"\s+", " "))


def tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def token_count(clean: Column) -> Column:
    return F.size(tokens(clean))


def prefix(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n)


def title_of(clean: Column, n: int = 8) -> Column:
    """The first ``n`` tokens, which stand for a title where a table has none."""
    return F.array_join(F.slice(tokens(clean), 1, n), " ")


def word_ngrams(clean: Column, low: int = 1, high: int = 1) -> Column:
    """N-grams over the tokens of two or more characters."""
    words = F.filter(F.split(clean, " "), lambda t: F.length(t) >= 2)
    parts = [shingles(words, n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def shingles(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a space.

    Shifted copies are zipped: a lambda that looked into ``words`` would build the array anew for every run.
    """
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, 1, count) if n > 1 else words
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, k, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def char_wb_ngrams(clean: Column, low: int, high: int) -> Column:
    """Character n-grams within words padded by one space on either side."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        sizes = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(padded))))

        def of_size(n: Column) -> Column:
            # A word shorter than the least size gives itself once.
            last = F.greatest(F.length(padded) - n + 1, F.lit(1))
            return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, n))

        return F.flatten(F.transform(sizes, of_size))

    return F.flatten(F.transform(tokens(clean), of_word))


def parse_ids(text: Column) -> Column:
    """Whole numbers separated by spaces; anything else raises."""
    return F.transform(tokens(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), lambda t: t.cast("bigint"))


def join_ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def instruct(text: Column, instruction: str = "query: ") -> Column:
    """The text as an encoder that expects an instruction takes it."""
    return F.concat(F.lit(instruction), F.coalesce(text, F.lit("")))
