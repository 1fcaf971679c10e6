"""Profiles of tables: column statistics in one scan, then kinds, themes, grain and warnings."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Words in column names, and thresholds.
METRIC = frozenset("rev revenue amount sales cost price qty quantity count total sum value budget spend income profit loss margin arr mrr churn rate score pc act".split())
IDENTIFIER = frozenset("id num number # code key ref sap enterprise site zip postal".split())
TIME = frozenset("year yr quarter qtr month mo week wk date period fiscal fy q1 q2 q3 q4".split())
ENTITY = frozenset(
    "name customer client product geo geography country region market segment channel industry partner vendor rep owner team division vertical brand category".split()
)
CATEGORY = frozenset("type status flag label tier level class group mode kind on-prem saas stream".split())
NUMERIC_FROM, DISTINCT_FROM, LARGE_MEAN = 0.85, 0.95, 1_000_000
_PERIOD_NAME = re.compile(r"\b(20\d\d|19\d\d|q[1-4]|fy\d\d)\b")


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    kind: str
    null_rate: float
    cardinality: int
    numeric_total: float | None
    samples: tuple[str, ...] = ()


@dataclass(frozen=True)
class DataCard:
    name: str
    total_rows: int
    columns: tuple[ColumnProfile, ...]
    time_range: str
    themes: tuple[str, ...]
    grain: str
    warnings: tuple[str, ...] = field(default=())

    def of_kind(self, *kinds: str) -> list[str]:
        return [c.name for c in self.columns if c.kind in kinds]

    def to_dict(self) -> dict:
        return asdict(self)


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: ``name, n_rows, n_nulls, null_rate, cardinality, numeric_ratio, mean, numeric_total, longest,
    least, greatest``. All columns are unpivoted after one scan and aggregated by name; blanks are null."""
    names = df.columns
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), S.label(F.col(f"`{n}`")).alias("value")) for n in names))
    cells = df.select(F.inline(pairs))
    x = S.number(F.col("value"))
    known = F.count("value")
    return cells.groupBy("name").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - known).alias("n_nulls"),
        F.round((F.count("*") - known) / F.count("*"), 3).alias("null_rate"),
        F.count_distinct("value").alias("cardinality"),
        F.coalesce(F.count(x) / F.nullif(known, F.lit(0)), F.lit(0.0)).alias("numeric_ratio"),
        F.avg(x.cast("decimal(28,4)")).cast("double").alias("mean"),
        S.exact_sum(x).alias("numeric_total"),
        F.max(F.length("value")).cast("long").alias("longest"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )


def kind_of(name: str, cardinality: int, n_known: int, n_rows: int, numeric_ratio: float, mean: float | None, longest: int) -> str:
    words = set(re.split(r"[\s_/\-#@]+", name.lower()))
    numeric = numeric_ratio >= NUMERIC_FROM
    if words & TIME or _PERIOD_NAME.search(name.lower()):
        return "time"
    if numeric and words & METRIC:
        return "metric"
    if numeric and words & IDENTIFIER:
        return "id"
    if words & ENTITY:
        return "entity"
    if words & CATEGORY:
        return "categorical"
    if not n_known:
        return "unknown"
    if numeric:
        return "id" if (mean or 0) > LARGE_MEAN and cardinality > 50 else "metric"
    if cardinality <= 20:
        return "categorical"
    if cardinality / max(1, n_rows) >= DISTINCT_FROM:
        return "text" if longest > 40 else "id"
    return "entity"


def themes_of(columns: list[ColumnProfile]) -> list[str]:
    kinds, names = {c.kind for c in columns}, " ".join(c.name.lower() for c in columns)
    metric, time, entity = ("metric" in kinds, "time" in kinds, "entity" in kinds)
    has = lambda *parts: any(p in names for p in parts)
    customers = has("customer", "client")
    rules = [
        ("revenue_analysis", metric and has("rev", "amount", "sales", "cost")),
        ("customer_revenue", metric and customers),
        ("customer_analysis", customers),
        ("time_series", time and metric),
        ("attrition_risk", entity and time and metric),
        ("renewal_tracking", entity and time and metric),
        ("pipeline_analysis", has("deal", "pipeline", "opportunity", "stage")),
        ("geographic_breakdown", has("geo", "country", "region", "market")),
        ("product_breakdown", has("product", "sku", "part", "category")),
    ]
    return [name for name, holds in rules if holds] or ["general_analysis"]


def card(df: DataFrame, name: str, samples: int = 5) -> DataCard:
    """The profile of a table. What reaches the driver is one row per column, and five sample values of each."""
    stats = {r["name"]: r for r in column_stats(df).collect()}
    examples = _samples(df, samples)
    columns = []
    for n in df.columns:
        r = stats.get(n)
        rows = r["n_rows"] if r else 0
        known = rows - r["n_nulls"] if r else 0
        kind = kind_of(n, r["cardinality"], known, rows, r["numeric_ratio"], r["mean"], r["longest"] or 0) if r else "unknown"
        columns.append(
            ColumnProfile(n, kind, r["null_rate"] if r else 0.0, r["cardinality"] if r else 0, round(r["numeric_total"], 4) if r and kind == "metric" and r["numeric_total"] is not None else None, examples.get(n, ()))
        )
    first = {k: next((c for c in columns if c.kind == k), None) for k in ("entity", "time", "metric")}
    times = [stats[c.name] for c in columns if c.kind == "time" and c.name in stats and stats[c.name]["least"] is not None]
    span = f"{times[0]['least']} – {times[0]['greatest']}" if times else "unknown"
    warnings = [f"{c.name}: {c.null_rate:.0%} of values are missing" for c in columns if c.null_rate > 0.5]
    warnings += [f"{c.name}: {c.null_rate:.1%} of entity values are missing" for c in columns if c.kind == "entity" and 0.05 < c.null_rate <= 0.5]
    grain = " × ".join(c.name for c in first.values() if c) or "row"
    return DataCard(name, next((r["n_rows"] for r in stats.values()), 0), tuple(columns), span, tuple(themes_of(columns)), grain, tuple(warnings))


def _samples(df: DataFrame, n: int) -> dict[str, tuple[str, ...]]:
    head = df.select(*(S.label(F.col(f"`{c}`")).alias(c) for c in df.columns)).limit(200).collect()
    return {c: tuple(list(dict.fromkeys(r[i] for r in head if r[i] is not None))[:n]) for i, c in enumerate(df.columns)}
