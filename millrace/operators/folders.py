"""Folder trees of documents: counts here and below, renames, digest paths, collapsed name groups, reused summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def folder(path: Column) -> Column:
    """The folder of a relative path, empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def tree(files: DataFrame) -> DataFrame:
    """``folder, n_here, n_below`` for every folder that has files in it or under it."""
    here = files.groupBy(folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n_here"))
    parts = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )
    below = here.select(F.explode(above).alias("folder"), "n_here").groupBy("folder").agg(F.sum("n_here").alias("n_below"))
    zero = F.lit(0).cast("long")
    return here.join(below, "folder", "full_outer").select("folder", F.coalesce("n_here", zero).alias("n_here"), F.coalesce("n_below", zero).alias("n_below"))


def rename(index: DataFrame, old: str, new: str) -> DataFrame:
    """Paths under the folder ``old`` move to ``new``; all else stays."""
    inside = F.col("path").startswith(old.rstrip("/") + "/")
    return index.withColumn("path", F.when(inside, F.concat(F.lit(new.rstrip("/")), F.col("path").substr(F.lit(len(old.rstrip("/")) + 1), F.length("path")))).otherwise(F.col("path")))


def digest_path(path: Column) -> Column:
    """Where a source's digest is: the domain as a slug, the folders as they are, the name with ``.md`` added."""
    domain = S.slug(F.substring_index(path, "/", 1))
    return F.when(F.contains(path, F.lit("/")), F.concat_ws("/", domain, F.concat(F.regexp_replace(path, "^[^/]*/", ""), F.lit(".md")))).otherwise(F.concat(path, F.lit(".md")))


def collapse(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``label, n, quarters``: files whose name matches a rule's pattern are one line under its label, the others one
    each; ``quarters`` lists the codes such as Q325 that occur in the names."""
    label = F.coalesce(*(F.when(F.col("name").rlike(p), F.lit(t)) for p, t in rules), F.col("name"))
    code = F.nullif(F.upper(F.regexp_extract("name", r"(?i)(q[1-4]\d{2})", 1)), F.lit(""))
    return files.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(code)), ",").alias("quarters"))


def reused(files: DataFrame, cache: DataFrame, fallback: Column) -> DataFrame:
    """``path, hash, summary, fresh``: the cached summary of an unchanged file, else ``fallback`` marked as fresh."""
    old = cache.select("path", F.col("hash").alias("__hash"), F.col("summary").alias("__summary"))
    same = F.col("hash") == F.col("__hash")
    joined = files.join(old, "path", "left")
    return joined.select("path", "hash", F.when(same, F.col("__summary")).otherwise(fallback).alias("summary"), (~F.coalesce(same, F.lit(False))).alias("fresh"))
