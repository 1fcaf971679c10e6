"""The document index: upserts, deletes, differences to the files, staleness and domain figures.

Files are ``(path, domain, ext, length, mtime, hash)``; the index holds ``(path, domain, hash, indexed_at, …)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(index: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``fresh`` replace those of the same key; all else stays. Applying it twice changes nothing."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete(index: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


def changed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index lacks or holds with another hash."""
    known = index.select("path", F.col("hash").alias("__hash"))
    return files.join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("__hash"))).drop("__hash")


def diff(files: DataFrame, index: DataFrame) -> DataFrame:
    """``(path, state)``: missing, stale, ok or orphaned."""
    left, right = files.select("path", F.col("hash").alias("on_disk")), index.select("path", F.col("hash").alias("indexed"))
    state = F.when(F.col("indexed").isNull(), "missing").when(F.col("on_disk").isNull(), "orphaned").when(F.col("on_disk") != F.col("indexed"), "stale").otherwise("ok")
    return left.join(right, "path", "full_outer").select("path", state.alias("state"))


def orphans(digests: DataFrame, files: DataFrame) -> DataFrame:
    return digests.join(files.select("path"), "path", "left_anti")


def stale_domains(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Domains with files newer than their last indexing, and how many; stale beyond one or 5 % of what is indexed."""
    newer = files.join(F.broadcast(indexed.select("domain", "indexed_at", "n_indexed")), "domain")
    per = newer.groupBy("domain", "n_indexed").agg(F.count_if(F.col("mtime") > F.col("indexed_at")).alias("n_new"))
    return per.select("domain", "n_indexed", "n_new", (F.col("n_new") > F.greatest(F.lit(1), F.floor(0.05 * F.col("n_indexed")))).alias("stale"))


def domain_stats(files: DataFrame, keyword_counts: DataFrame | None = None) -> DataFrame:
    return files.groupBy("domain").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_chars"), F.count_if(F.col("length") == 0).alias("n_empty"), F.max("mtime").alias("newest"))


def type_counts(files: DataFrame, type_col: str) -> DataFrame:
    return files.groupBy(type_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), type_col)


def latest(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last event of each key."""
    return events.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def apply_events(index: DataFrame, events: DataFrame) -> DataFrame:
    """The index after file events ``(path, kind, ts, event_id, hash)``: the last event of a path decides."""
    last = latest(events, "path", [F.desc("ts"), F.desc("event_id")])
    kept = index.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("kind != 'deleted'").select("path", "hash"), allowMissingColumns=True)


def group_files(files: DataFrame, folder: Column, n: int = 4) -> DataFrame:
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(n)


def top_terms(tokens: DataFrame, key: str, n: int = 6) -> DataFrame:
    """The most frequent tokens of each key: ``key, rank, token, n``."""
    counts = tokens.groupBy(key, "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
