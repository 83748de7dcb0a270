"""Spelling correction against a corpus vocabulary by a symmetric-delete join.

A word and a token within ``MAX_DISTANCE`` edits have a string in common among what deletions leave
of their first ``PREFIX`` characters.  Candidates meet in an equi-join on those strings; the edit
distance, with adjacent swaps as one edit, is verified on distinct pairs only.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from harrow.functions.text import tokens

# The limits of the correction.
MIN_LENGTH, MAX_DISTANCE, PREFIX = 4, 2, 7


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(ArrayType(StringType()))
def _deletes(words: pd.Series) -> pd.Series:
    def of(word: str) -> list[str]:
        start = word[:PREFIX]
        return list({"".join(start[i] for i in range(len(start)) if i not in gone) for n in range(MAX_DISTANCE + 1) for gone in combinations(range(len(start)), min(n, len(start)))})

    return words.map(of)


def vocabulary(docs: DataFrame, *texts: str) -> DataFrame:
    """``(word, n)``: how often each token of four or more characters occurs in the named columns."""
    words = docs.select(F.explode(F.concat(*(tokens(F.col(t)) for t in texts))).alias("word"))
    return words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def needs_check(token: Column) -> Column:
    return (F.length(token) >= MIN_LENGTH) & ~token.rlike("^[0-9]+$")


def corrections(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(token, fixed)`` of those ``words(token)`` that the vocabulary lacks and can correct: nearest, then most frequent, then first."""
    odd = words.select("token").distinct().where(needs_check(F.col("token"))).join(vocab.select(F.col("word").alias("token")), "token", "left_anti")
    left = odd.select("token", F.explode(_deletes("token")).alias("key"))
    right = vocab.select("word", "n", F.explode(_deletes("word")).alias("key"))
    near = left.join(right, "key").where(F.abs(F.length("token") - F.length("word")) <= MAX_DISTANCE).select("token", "word", "n").distinct()
    # A swap is two of Levenshtein's edits, so this bound drops no pair; it runs in the JVM before the exact distance.
    near = near.where(F.levenshtein("token", "word", 2 * MAX_DISTANCE) >= 0).withColumn("d", _distance("token", "word")).where(F.col("d") <= MAX_DISTANCE)
    best = Window.partitionBy("token").orderBy("d", F.desc("n"), "word")
    return near.withColumn("r", F.row_number().over(best)).where("r = 1").select("token", F.col("word").alias("fixed"))


def fix(queries: DataFrame, text: str, vocab: DataFrame, out: str = "query_spell") -> DataFrame:
    """Add ``out``: the text with every token corrected that can be; ``query_id`` identifies rows."""
    words = queries.select("query_id", F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    done = words.join(corrections(words, vocab), "token", "left").select("query_id", "pos", F.coalesce("fixed", "token").alias("t"))
    joined = done.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias(out))
    return queries.join(joined, "query_id", "left").withColumn(out, F.coalesce(out, F.lit("")))
