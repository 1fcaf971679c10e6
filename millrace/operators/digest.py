"""Figures for a table's digest: totals by many dimensions in one pass, renewal, twins, equal partitions, keywords."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .profile import DataCard

# Breakdown dimensions in the order in which they are shown, and hints for the customer column.
DIMENSIONS = {
    "product": ("product family", "product name", "product", "brand"),
    "region": ("geography", "region", "geo"),
    "segment": ("client segment type description", "segment"),
    "channel": ("channel type", "channel"),
    "period": ("fiscal quarter", "fiscal month", "quarter", "month", "year", "period"),
}
CUSTOMER = ("customer name", "client name", "account name", "customer")
FEWEST, MOST = 2, 40


def totals_by_dimension(df: DataFrame, metric: str, dimensions: list[str], most: int = 50) -> DataFrame:
    """``dimension, key, value, n_rows``: the largest groups of each dimension and a ``TOTAL`` row, from one scan with
    grouping sets."""
    named = df.select(S.number_of(df, metric).alias("m"), *(S.label(F.col(d)).alias(d) for d in dimensions))
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = named.groupingSets(sets, *dimensions).agg(F.grouping_id().alias("gid"), F.coalesce(S.exact_sum(F.col("m")), F.lit(0.0)).alias("value"), F.count("*").alias("n_rows"))
    full = (1 << len(dimensions)) - 1
    which = F.coalesce(*(F.when(F.col("gid") == full - (1 << (len(dimensions) - 1 - i)), F.lit(d)) for i, d in enumerate(dimensions)), F.lit("TOTAL"))
    keyed = grouped.select(which.alias("dimension"), F.coalesce(*dimensions).alias("key"), F.round("value", 2).alias("value"), "n_rows").where("dimension = 'TOTAL' or key is not null")
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("value"), "key"))
    return keyed.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def breakdowns(df: DataFrame, metrics: list[str], dimensions: list[str], most: int = 8) -> DataFrame:
    """``metric, dimension, key, value, n_rows, n_groups``: the largest groups of every metric in every dimension, and how
    many there are, from one scan with grouping sets."""
    sums = [F.round(S.exact_sum(F.col(f"__m{i}")), 2).alias(f"__m{i}") for i in range(len(metrics))]
    named = df.select(*(S.number_of(df, m).alias(f"__m{i}") for i, m in enumerate(metrics)), *(S.label(F.col(f"`{d}`")).alias(f"__d{i}") for i, d in enumerate(dimensions)))
    columns = [f"__d{i}" for i in range(len(dimensions))]
    grouped = named.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.grouping_id().alias("gid"), F.count("*").alias("n_rows"), *sums)
    full = (1 << len(columns)) - 1
    which = F.coalesce(*(F.when(F.col("gid") == full - (1 << (len(columns) - 1 - i)), F.lit(d)) for i, d in enumerate(dimensions)))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"__m{i}").alias("value")) for i, m in enumerate(metrics)))
    each = grouped.select(which.alias("dimension"), F.coalesce(*columns).alias("key"), "n_rows", F.explode(cells).alias("c")).where("key is not null and c.value is not null")
    rows = each.select("c.metric", "dimension", "key", "c.value", "n_rows")
    rank = F.row_number().over(Window.partitionBy("metric", "dimension").orderBy(F.desc("value"), "key"))
    sizes = rows.groupBy("metric", "dimension").agg(F.count("*").alias("n_groups"))  # metrics x dimensions
    return rows.withColumn("r", rank).where(F.col("r") <= most).drop("r").join(F.broadcast(sizes), ["metric", "dimension"])


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, total, n_values, max_abs`` by unpivoting the metrics."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), S.number_of(df, m).alias("x")) for m in metrics))
    return df.select(F.inline(pairs)).groupBy("metric").agg(F.round(S.exact_sum(F.col("x")), 2).alias("total"), F.count("x").alias("n_values"), F.max(F.abs("x")).alias("max_abs"))


def renewal_rate(df: DataFrame, expired: str, renewed: str, group: str) -> DataFrame:
    """``key, expired, renewed, rate_pct``; without expired value there is no rate."""
    rows = df.select(S.label(F.col(group)).alias("key"), S.number_of(df, expired).alias("e"), S.number_of(df, renewed).alias("r")).where("key is not null")
    sums = rows.groupBy("key").agg(F.coalesce(S.exact_sum(F.col("e")), F.lit(0.0)).alias("expired"), F.coalesce(S.exact_sum(F.col("r")), F.lit(0.0)).alias("renewed"))
    return sums.select("key", F.round("expired", 2).alias("expired"), F.round("renewed", 2).alias("renewed"), S.share(F.col("renewed"), F.col("expired"), 4).alias("rate_pct"))


def twins(df: DataFrame, metrics: list[str]) -> DataFrame:
    """``a, b, twins``: whether two metrics agree in every row, nulls included."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    differ = [F.sum(F.when(S.number_of(df, a).eqNullSafe(S.number_of(df, b)), 0).otherwise(1)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.coalesce(f"p{i}", F.lit(0)) == 0).alias("twins")) for i, (a, b) in enumerate(pairs)))
    return df.agg(*differ).select(F.inline(rows))


def same_partition(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, same_partition``: whether two columns split the rows alike, by their distinct counts."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = {c: S.label(F.col(c)) for c in columns}
    blank = lambda c: F.coalesce(one[c], F.lit(""))
    counts = [F.count_distinct(blank(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    counts += [F.count_distinct(blank(a), blank(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = F.array(
        *(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ((F.col(f"p{i}") == F.col(at[a])) & (F.col(f"p{i}") == F.col(at[b]))).alias("same_partition")) for i, (a, b) in enumerate(pairs))
    )
    return df.agg(*counts).select(F.inline(rows))


def distinct_values(df: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """``column, n_values, listing``: sorted distinct values joined by '|', null if a column has over ``most``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), S.label(F.col(c)).alias("value")) for c in columns))
    values = df.select(F.inline(pairs)).where("value is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    kept = values.withColumn("r", rank).where(F.col("r") <= most + 1)
    out = kept.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("listing"), F.count("*").alias("n"))
    counts = values.groupBy("column").agg(F.count("*").alias("n_values"))
    return counts.join(out, "column").select("column", "n_values", F.when(F.col("n") <= most, F.col("listing")).alias("listing"))


def implausible_units(df: DataFrame, metrics: list[str], limit: float = 100_000) -> DataFrame:
    """Metrics whose header says millions though a value reaches ``limit``."""
    named = [m for m in metrics if re.search(S.MILLIONS_NAME, m)]
    return metric_summary(df, named).where(F.col("max_abs") >= limit) if named else df.sparkSession.createDataFrame([], "metric string, total double, n_values bigint, max_abs double")


def pick_dimensions(card: DataCard) -> dict[str, str]:
    """Label → column: for each dimension the column of the first matching hint with a small cardinality."""
    fit = [c for c in card.columns if c.kind in ("time", "entity", "categorical") and FEWEST <= c.cardinality <= MOST and not re.search(S.PERSONAL_NAME, c.name)]
    out: dict[str, str] = {}
    for label, hints in DIMENSIONS.items():
        spaced = [(c, re.sub(r"[_\-]+", " ", c.name.lower())) for c in fit if c.name not in out.values()]
        hit = next((c for h in hints for c, n in spaced if h in n and not (label == "period" and "key" in n)), None)
        if hit:
            out[label] = hit.name
    return out


def pick_customer(card: DataCard) -> str | None:
    return next((c.name for h in CUSTOMER for c in card.columns if c.kind == "entity" and c.cardinality > MOST and h in re.sub(r"[_\-]+", " ", c.name.lower())), None)


def keywords(values: DataFrame, most: int = 25) -> DataFrame:
    """``nth, keyword``: distinct values of at least three characters, without case, in the order of ``position``."""
    low = F.lower(F.trim("value"))
    first = values.where(F.length(low) >= 3).groupBy(low.alias("keyword")).agg(F.min("position").alias("position"))
    return first.orderBy("position", "keyword").limit(most).select(F.row_number().over(Window.orderBy("position", "keyword")).cast("long").alias("nth"), "keyword")
