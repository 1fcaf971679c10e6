"""Questions about one table: totals, rankings, breakdowns, trends, attrition, comparison.

Every function maps DataFrames to DataFrames. Keys with blank text are dropped, metrics are coerced to finite numbers,
and every ranking has a total order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Period:
    """A time filter: years and quarters that are asked for; none of either means no restriction by it."""

    years: tuple[int, ...] = ()
    quarters: tuple[int, ...] = ()
    text: str = field(default="all", compare=False)

    def condition(self, column: Column) -> Column:
        """Labels are tested for year and quarter, whole numbers for the year alone; null never passes a filter."""
        if not (self.years or self.quarters):
            return F.lit(True)
        is_number = S.number(column).isNotNull()
        year = F.when(is_number, S.whole(column)).otherwise(S.year_of(column))
        test = column.isNotNull()
        if self.years:
            test = test & year.isin(*self.years)
        if self.quarters:
            test = test & (is_number | S.quarter_of(column).isin(*self.quarters))
        return F.coalesce(test, F.lit(False))


def restrict(df: DataFrame, time_col: str | None = None, period: Period | None = None, entity_col: str | None = None, entity: str | None = None) -> DataFrame:
    """Rows of a period and of an entity (compared without case)."""
    if time_col and period:
        df = df.where(period.condition(F.col(time_col)))
    if entity_col and entity is not None:
        df = df.where(F.lower(F.col(entity_col).cast("string")) == entity.strip().lower())
    return df


def total(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.coalesce(S.exact_sum(S.number_of(df, metric)), F.lit(0.0)).alias("total"), F.count("*").alias("n_rows"))


def by_group(df: DataFrame, metric: str, group: str) -> DataFrame:
    return (
        df.select(S.label(F.col(group)).alias("key"), S.number_of(df, metric).alias("m"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.coalesce(S.exact_sum(F.col("m")), F.lit(0.0)).alias("value"), F.count("*").alias("n_rows"))
    )


def top(df: DataFrame, metric: str, group: str, n: int = 10) -> DataFrame:
    """The n largest groups with their share of the total over all groups."""
    groups = by_group(df, metric, group)
    all_ = groups.agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("all_value"))
    best = groups.orderBy(F.desc("value"), "key").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("value"), "key")).cast("long")
    return best.crossJoin(F.broadcast(all_)).select(rank.alias("rank"), "key", F.round("value", 2).alias("value"), S.share(F.col("value"), F.col("all_value"), 4).alias("share_pct"))


def breakdown(df: DataFrame, metric: str, group: str, shown: int = 25) -> DataFrame:
    """The largest groups and how many there are in all."""
    groups = by_group(df, metric, group)
    count = groups.agg(F.count("*").alias("n_groups"))
    return groups.orderBy(F.desc("value"), "key").limit(shown).crossJoin(F.broadcast(count)).select("key", F.round("value", 2).alias("value"), "n_rows", "n_groups")


def trend(df: DataFrame, metric: str, time: str) -> DataFrame:
    """Sums by period in period order, with absolute and per cent change. As many rows as periods, so one ordered
    window holds them."""
    order = Window.orderBy(S.period_key(F.col("key")))
    before = F.lag("value").over(order)
    return by_group(df, metric, time).select(
        F.row_number().over(order).cast("long").alias("nth"),
        F.col("key").alias("period"),
        F.round("value", 2).alias("value"),
        F.round(F.col("value") - before, 2).alias("delta"),
        F.round(100 * (F.col("value") - before) / F.nullif(before, F.lit(0.0)), 2).alias("delta_pct"),
    )


def overall_change(df: DataFrame, metric: str, time: str) -> DataFrame:
    periods = trend(df, metric, time)
    ends = periods.agg(
        F.min_by("period", "nth").alias("first_period"),
        F.max_by("period", "nth").alias("last_period"),
        F.min_by("value", "nth").alias("first_value"),
        F.max_by("value", "nth").alias("last_value"),
    )
    change = F.col("last_value") - F.col("first_value")
    return ends.where("first_period is not null").select("*", F.round(change, 2).alias("change"), F.round(100 * change / F.nullif("first_value", F.lit(0.0)), 2).alias("change_pct"))


def attrition(df: DataFrame, entity: str, time: str, metric: str) -> DataFrame:
    """Entities of earlier periods that are missing from the latest, with what they brought before. Fewer than two
    periods give no rows."""
    rows = df.select(S.label(F.col(entity)).alias("entity"), S.label(F.col(time)).alias("period"), S.number_of(df, metric).alias("m")).where("entity is not null and period is not null")
    latest = rows.agg(F.max_by("period", S.period_key(F.col("period"))).alias("latest_period"), F.count_distinct("period").alias("n")).where("n > 1")
    marked = rows.join(F.broadcast(latest))
    per = marked.groupBy("entity", "latest_period").agg(
        F.max((F.col("period") == F.col("latest_period")).cast("int")).alias("present"), S.exact_sum(F.coalesce("m", F.lit(0.0))).alias("lost_value")
    )
    return per.where("present = 0").select("entity", "latest_period", F.round("lost_value", 2).alias("lost_value"))


def compare(a: DataFrame, b: DataFrame, metric: str, time: str) -> DataFrame:
    """Two tables period by period; a side without a period counts as 0 and is marked as missing."""
    x, y = (by_group(t, metric, time).select(F.col("key").alias("period"), F.col("value").alias(n)) for t, n in ((a, "value_a"), (b, "value_b")))
    both = x.join(y, "period", "full_outer")
    va, vb = F.coalesce("value_a", F.lit(0.0)), F.coalesce("value_b", F.lit(0.0))
    return both.select(
        "period",
        F.round(va, 2).alias("value_a"),
        F.round(vb, 2).alias("value_b"),
        F.round(vb - va, 2).alias("delta"),
        F.round(100 * (vb - va) / F.nullif(va, F.lit(0.0)), 2).alias("delta_pct"),
        F.col("value_a").isNull().alias("missing_a"),
        F.col("value_b").isNull().alias("missing_b"),
    )


def gini(df: DataFrame, metric: str, group: str) -> DataFrame:
    """Concentration over groups: the Gini coefficient and the share of the largest fifth. Ranks come from sorted
    partitions and their totals, so no window holds all groups."""
    groups = by_group(df, metric, group).where("value > 0").select(F.col("value"), F.col("key"))
    placed = ranked(groups, [F.col("value"), F.col("key")])
    stats = placed.agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("rank") * F.col("value")).alias("w"))
    fifth = placed.crossJoin(F.broadcast(stats)).where(F.col("rank") > F.col("n") - F.ceil(F.col("n") / 5)).agg(F.sum("value").alias("head"))
    return stats.crossJoin(fifth).select(
        F.col("n").alias("n_groups"),
        F.round(2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), 6).alias("gini"),
        F.round(100 * F.col("head") / F.col("s"), 4).alias("top_fifth_pct"),
    )


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with a global 1-based ``rank``, by range partitions and prefix sums of their sizes."""
    spread = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    sizes = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return spread.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + inside).drop("__part", "__before")


def outliers(df: DataFrame, metric: str, group: str, z: float = 3.0) -> DataFrame:
    """Groups whose total lies more than ``z`` deviations from the mean, or outside 1.5 interquartile ranges."""
    groups = by_group(df, metric, group).select("key", "value")
    stats = groups.agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.expr("percentile(value, 0.25)").alias("q1"), F.expr("percentile(value, 0.75)").alias("q3")
    )
    scored = groups.crossJoin(F.broadcast(stats)).withColumn("z", (F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0)))
    iqr = 1.5 * (F.col("q3") - F.col("q1"))
    return scored.where((F.abs("z") > z) | (F.col("value") < F.col("q1") - iqr) | (F.col("value") > F.col("q3") + iqr)).select(
        "key", F.round("value", 2).alias("value"), F.round("z", 4).alias("z")
    )


def fastest_growth(df: DataFrame, metric: str, group: str, time: str, n: int = 10) -> DataFrame:
    """Groups by their change between the first and the last period."""
    rows = df.select(S.label(F.col(group)).alias("key"), S.label(F.col(time)).alias("period"), S.number_of(df, metric).alias("m")).dropna(subset=["key", "period"])
    ends = rows.agg(F.min_by("period", S.period_key(F.col("period"))).alias("p0"), F.max_by("period", S.period_key(F.col("period"))).alias("p1"))
    at = lambda p: F.coalesce(S.exact_sum(F.when(F.col("period") == F.col(p), F.col("m"))), F.lit(0.0))
    per = rows.join(F.broadcast(ends)).groupBy("key").agg(at("p0").alias("first_value"), at("p1").alias("last_value"))
    change = F.round(F.col("last_value") - F.col("first_value"), 2)
    return per.select("key", F.round("first_value", 2).alias("first_value"), F.round("last_value", 2).alias("last_value"), change.alias("change")).orderBy(F.desc("change"), "key").limit(n)
