"""Contiguous shards of equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import named, stored


def byte_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``id, size, text_crc32, shard, slot``.

    A row's size is the UTF-8 bytes of its text, none for null, plus 1. Rows are put in the order of (id, checksum,
    size), null ids first; a row goes to the shard in which the middle of its bytes falls, so shards are contiguous
    in that order and differ by at most two rows' bytes. ``slot`` counts a shard's rows from 0. Rows equal in all
    three are interchangeable. Other columns are left out; an empty table gives an empty result, and with fewer rows
    than shards some shards are empty. Texts are read once, for a stored table of 28 bytes a row; that is what is
    sampled for ranges and sorted.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = named(text_col)
    rows = df.select(
        named(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = stored(rows, "measured")
    order = ["id", "text_crc32", "size"]
    placed = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "placed")
    # as many rows as partitions: one window over them is small at any scale
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("end", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    summed = summed.join(F.broadcast(offsets), "part")
    middle = F.col("bytes_before") + F.col("end") - F.col("size") / 2
    numbered = summed.select(
        "id",
        "size",
        "text_crc32",
        F.least(F.floor(middle * shards / F.col("all_bytes")), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("place"),
    )
    first = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
