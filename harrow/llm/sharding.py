"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows of a source are put in a seeded random order; row ``r`` of ``n`` gets the fractional rank
``(r + u) / n``, where ``u`` is a seeded hash of the source between 0 and 1, so that the rows of many
small sources do not all stand at the same rank.  Sorting all rows by it interleaves the sources
evenly, so any stretch of the order holds the mixture, and cutting it at equal counts gives shards
that each match the mixture.

Ranks come from counts per bucket plus a rank inside a bucket, never from one task per source:
the order key's first hex digits bucket a source, and the fractional rank itself buckets the whole.
A source with a third of all rows is thus spread over ``BUCKETS`` windows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Windows per source and over the fractional rank; a power of 16.
BUCKETS = 4096


def interleave(rows: DataFrame, source_col: str, id_col: str, n_shards: int, seed: int = 42) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``: counts at most one apart, slots gapless from 0.

    ``rows`` should hold few and small columns, as they are shuffled twice.  A null source is a
    source of its own; rows that repeat in every column are interchangeable; an empty table gives
    an empty table.  Columns that start with ``__`` are reserved.
    """
    source, everything = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("-")), [c for c in rows.columns]
    keyed = rows.withColumns({"__source": source, "__key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))})
    keyed = keyed.withColumn("__bucket", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"))

    counts = keyed.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    by_source = Window.partitionBy("__source")
    counts = counts.select(
        "__source",
        "__bucket",
        (F.sum("__n").over(by_source.orderBy("__bucket")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(by_source).alias("__total"),
    )
    # 52 bits of a hash as a fraction below 1.
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__source"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    in_bucket = Window.partitionBy("__source", "__bucket").orderBy("__key", id_col, *[c for c in everything if c not in (source_col, id_col)])
    ranked = (
        keyed.withColumn("__rank", F.row_number().over(in_bucket) - 1)
        .join(counts, ["__source", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__rank"))
        .withColumn("__place", (F.col("__rank") + start) / F.col("__total"))
        .withColumn("__slice", F.least(F.floor(F.col("__place") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .select(*everything, "__source", "__rank", "__place", "__slice")
    )
    slices = ranked.groupBy("__slice").agg(F.count("*").alias("__n"))  # at most BUCKETS rows; Spark reuses the exchange behind the ranks
    whole = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows
    slices = slices.select("__slice", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    in_slice = Window.partitionBy("__slice").orderBy("__place", "__source", "__rank")
    placed = ranked.withColumn("__at", F.row_number().over(in_slice) - 1).join(slices, "__slice").withColumn("__at", F.col("__start") + F.col("__at"))
    # Shard k begins at ceil(k * all / n_shards).
    shard = F.expr(f"(__at * {n_shards}) div __all")
    return placed.withColumn("shard", shard.cast("int")).select(*everything, "shard", (F.col("__at") - F.expr(f"(shard * __all + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """Shard, slot, size and checksum of every document; texts are read once and never shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("src"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    return interleave(rows, "src", "id", n_shards, seed).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("src").alias(source_col)
    )
