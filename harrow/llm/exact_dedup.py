"""Exact deduplication: a tree merge of sorted digest runs, with DataFrame operations only.

Each scan task turns its rows into ``(digest, bytes, id)`` and combines equal ones at once, which
is the leaf level: ``2**rounds`` runs, to which the tasks are dealt by number.  Runs then meet in
binomial rounds: in round ``r`` run ``i`` with bit ``r`` set goes to run ``i - 2**r``, the rows of
both are put in order of digest, byte length and identifier, and of equal digests whose lengths agree the
first row stays, with the sum of the counts.  A run is dealt by digest over all tasks, so no task
ever holds a whole run, and a group of copies is one row per run before the first merge.  Texts
never move: only the 32-byte digest, the byte length that verifies it, one identifier and a count do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as binary; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256))


def merge_runs(leaves: DataFrame, rounds: int, keep: str) -> DataFrame:
    """Merge ``leaves(run, digest, n_bytes, id)`` into ``(digest, n_bytes, keep_id, group_size)``.

    ``keep`` is ``"min"`` or ``"max"``: which identifier survives every level; a null does only if all are.
    """
    pick, first = {"min": (F.min, F.asc_nulls_last), "max": (F.max, F.desc_nulls_last)}[keep]
    runs = leaves.groupBy("run", "digest", "n_bytes").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    equal = Window.partitionBy("run", "digest", "n_bytes")  # two rows at most: one of each run that is merged
    for r in range(rounds):
        merged = runs.withColumn("run", F.col("run").bitwiseAND(~(1 << r)))
        ordered = merged.withColumns({"place": F.row_number().over(equal.orderBy(first("keep_id"))), "group_size": F.sum("group_size").over(equal)})
        runs = ordered.where("place = 1").drop("place")
    return runs.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", rounds: int = 3) -> DataFrame:
    """One row per input row: ``(id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when their UTF-8 bytes are; null counts as empty, so null and ``''`` form one
    group.  Other columns, whatever their names, are ignored.  Repeated ids are kept as repeated
    rows and count each; rows with a null id stay in the result (they are kept only if every id of
    their group is null).  An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        text_digest(F.col(text_col)).alias("digest"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
    )
    leaves = rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(1 << rounds)))
    winners = merge_runs(leaves, rounds, keep)
    return rows.join(winners, ["digest", "n_bytes"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group, also of rows that repeat an id and text.

    Null, empty and long texts, null ids and empty tables are as in ``exact_groups``; columns of any name are kept.
    """
    groups = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("kept_id"), F.unhex("text_sha256").alias("kept_digest"))
    # The columns go along as one, so that no name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    left = rows.join(groups, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    one = Window.partitionBy("id", "digest").orderBy(F.lit(0))  # as the join left the rows: no further exchange
    return left.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")
