"""Keeping an index in step with a folder: what differs between two listings, last event wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index


def snapshot_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, kind, hash`` from two listings: created, modified or deleted. File streams only see insertions, so
    deletions and renames come from comparing snapshots."""
    old, new = before.select("path", F.col("hash").alias("old")), now.select("path", F.col("hash").alias("new"))
    both = old.join(new, "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", kind.alias("kind"), F.col("new").alias("hash")).where("kind is not null")


def keep_in_step(spark: SparkSession, events: DataFrame, table: str, checkpoint: str):
    """Applies file events ``(path, kind, ts, event_id, hash)`` batch by batch to a Parquet index that is written
    anew under a version number, so a repeated batch gives the same table. Returns the started query."""

    def apply(batch: DataFrame, version: int) -> None:
        older = f"{table}/v={version - 1}"
        current = spark.read.parquet(older) if version > 0 else batch.select("path", "hash").limit(0)
        index.apply_events(current, batch).write.mode("overwrite").parquet(f"{table}/v={version}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
