"""Tables that cut a job's lineage, in the folder that ``spark.checkpoint.dir`` names.

Every table is written by Spark's Parquet writer to shared storage, so a lost executor costs a reread and not a
recomputation of everything above it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


#: 64-bit keys up to which a table of them is broadcast: 8 MB, some 30 MB when hashed.
BROADCAST_KEYS = 1_000_000

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: dict[str, list[str]] = {}
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one on a single machine, and an error on a
    cluster, whose executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def named(column: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain column names, which functions over Arrow batches need of their input."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def whole_row(df: DataFrame) -> Column:
    return F.struct(*map(named, df.columns))


def prepare(spark: SparkSession) -> None:
    """Before a plan that runs Python: the workers get this package, and Arrow batches of at most 4 MB unless the
    session sets another size. Rows can be long, and each core has several batches and their Python objects."""
    ship(spark)
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, "4m")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def delete_at_end(spark: SparkSession, name: str) -> None:
    """The folder goes when the application's JVM ends, if nothing deletes it before."""
    path, files = _path(spark, name)
    files.deleteOnExit(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh table in shared storage and read back with the same columns. The table belongs to the
    current ``scope``; it goes with that, and at the end of the application at the latest."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    if (scope_ := _scope.get()) is not None:
        _made.setdefault(scope_, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables made inside, by this thread, belong to ``name``, until ``close`` or the next scope of that name deletes them.
    For callers that write a result out and then need no more of what it was made from; jobs that run side by side, or
    whose results are read later, take names of their own."""
    close(spark, name)
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def close(spark: SparkSession, name: str) -> None:
    for made in _made.pop(name, []):
        delete(spark, made)


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``dropped``; broadcast while that has at most ``BROADCAST_KEYS`` rows."""
    return rows.join(F.broadcast(dropped) if small(dropped, BROADCAST_KEYS) else dropped, key, "left_anti")


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; looks at no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: Column, pieces: int = 128) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in ``weight`` how many of ``rows`` have it. A key with
    over 1 / ``pieces`` of all rows is dealt by ``spread`` over several tasks, each with a copy of the table's row.
    Fewer than ``pieces`` keys can be that heavy, so their list is broadcast."""
    total = table.agg(F.sum(weight)).first()[0] or 1
    share = F.ceil(F.col(weight) * pieces / total).cast("long")
    heavy = table.select(*keys, share.alias("pieces")).where("pieces > 1")
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("piece", F.pmod(spread, F.coalesce("pieces", F.lit(1).cast("long")))).drop("pieces")
    return dealt.join(table.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), share - 1))), [*keys, "piece"]).drop("piece")


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
