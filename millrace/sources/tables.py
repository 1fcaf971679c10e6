"""Tables from files: everything is text first and coerced late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx

TABULAR = ("csv", "tsv", "json", "jsonl", "xlsx", "xlsm", "parquet")


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's extension: CSV, TSV (byte order marks are dropped), JSON (a list or one object), JSON
    lines, XLSX (first sheet), Parquet. Another extension raises ``ValueError``."""
    kind = extension(path)
    if kind in ("csv", "tsv"):
        rows = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"', inferSchema=False, encoding="UTF-8")
        rows = rows.toDF(*xlsx.clean_headers([c.lstrip("\ufeff") for c in rows.columns]))
        return rows.where(" or ".join(f"`{c}` is not null" for c in rows.columns)) if rows.columns else rows
    if kind == "jsonl":
        return flat(spark.read.json(path), key_order(spark.read.text(path).select(F.col("value").alias("row"))))
    if kind == "json":
        whole = spark.read.text(path, wholetext=True)
        listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
        return flat(spark.read.json(path, multiLine=True), key_order(whole.select(F.explode(listed).alias("row"))))
    if kind in ("xlsx", "xlsm"):
        return xlsx.table(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no table reader for .{kind}")


def key_order(rows: DataFrame) -> list[str]:
    """Keys of JSON objects in the order in which they first appear: as many rows as columns."""
    each = rows.select(F.monotonically_increasing_id().alias("nth"), F.posexplode(F.json_object_keys("row")).alias("at", "key"))
    return [r["key"] for r in each.groupBy("key").agg(F.min(F.struct("nth", "at")).alias("first")).orderBy("first").collect()]


def flat(df: DataFrame, order: list[str] = ()) -> DataFrame:
    """Nested values as JSON text; columns in the given order, then as in the schema."""
    place = {c: i for i, c in enumerate(order)}
    df = df.select(*(F.col(f"`{c}`") for c in sorted(df.columns, key=lambda c: place.get(c, len(place)))))
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")}
    return df.select(*((F.to_json(c) if c in nested else F.col(f"`{c}`")).alias(c) for c in df.columns))
