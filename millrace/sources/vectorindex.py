"""Stored vectors in inverted lists, found by cosine.

Centroids are trained by Spark on a bounded sample; every vector lies in the list of its nearest centroid, as a code of one
byte a component beside the vector itself. A question reads the codes of some lists; a code bounds its vector's cosine
from below and above, so only those that may be among the best are read as vectors and compared exactly. With ``probes``
those lists are the nearest ones. Without, they are all lists that can hold one of the best: a list knows how far its
farthest vector is from the centroid, and what is beyond the reach of the question is never opened. That answer is exact.

A folder holds ``lists`` (one folder a list, ordered by id) and ``centroids (list, centroid, n, reach)``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ship

#: Rows from which centroids are trained, those with the smallest hashes.
SAMPLE = 50_000
#: Lists at most, and the rows up to which one list is enough.
MOST_LISTS, FLAT = 16_384, 4_096
ROUNDS = 8
#: Lists that a question without ``probes`` opens first, to learn what the others must reach.
FIRST = 4
#: How far a cosine may be off by rounding.
SLACK = 1e-9


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the unit vectors of the rows that have one, of the length most of them have. Null or non-finite
    components and zero vectors make none."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    width = int(np.bincount(size[size > 0]).argmax()) if (size > 0).any() else 0
    rows = np.flatnonzero((size == width) & (size > 0))
    x = values[(np.cumsum(size) - size)[rows][:, None] + np.arange(width)]
    top = np.abs(x).max(1, initial=0)
    whole = np.isfinite(top) & (top > 0)
    x = x[whole] / top[whole][:, None]
    return rows[whole], x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error): a byte a component, what it counts, and how far the code is from the vector."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1) + SLACK


def train(sample: DataFrame, lists: int, rounds: int) -> np.ndarray:
    """Centroids of ``vector``, first the rows with the smallest hashes, then means of what is nearest to them. A task
    sends a sum for each centroid."""
    first = sample.orderBy("h", "vector").select("vector").limit(lists).toArrow().column(0).combine_chunks()
    centroids = matrix(first)[1]

    def gather(centroids: np.ndarray):
        def sums(batches):
            total = np.zeros_like(centroids)
            for b in batches:
                x = matrix(b.column(0))[1]
                if len(x) and x.shape[1] == centroids.shape[1]:
                    np.add.at(total, (x @ centroids.T).argmax(1), x)
            used = np.flatnonzero(total.any(1))
            yield pa.record_batch([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["list", "total"])

        return sums

    for _ in range(rounds if len(centroids) > 1 else 0):
        found = sample.select("vector").mapInArrow(gather(centroids), "list long, total array<double>").collect()  # tasks x lists
        total = np.zeros_like(centroids)
        for at, row in found:
            total[at] += row
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 0, total / np.maximum(size, 1e-300), centroids)
    return centroids


def build(rows: DataFrame, id_col: str, vector_col: str, folder: str, lists: int | None = None, rounds: int = ROUNDS, scope_col: str | None = None) -> None:
    """Writes the index of ``rows``, whose ids differ, with a scope to which questions may keep. Vectors that are null or zero, or hold null or non-finite components,
    are left out, as are those of another length than the sample's most frequent one."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[id_col].dataType.simpleString()
    scope = F.coalesce(F.col(scope_col).cast("string"), F.lit("")) if scope_col else F.lit("")
    read = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), scope.alias("scope"))
    if lists is None:
        n = read.count()
        lists = 1 if n <= FLAT else min(MOST_LISTS, math.ceil(math.sqrt(n)))
    usable = read.where("exists(vector, x -> x != 0) and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    sample = usable.select(F.xxhash64("id").alias("h"), "vector").orderBy("h", "vector").limit(SAMPLE).cache()
    centroids = train(sample, lists, rounds)
    sample.unpersist()
    known = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows

    def place(batches):
        for b in batches:
            at, x = matrix(b.column(1))
            if not len(x) or x.shape[1] != known.value.shape[1]:
                continue
            cosines = x @ known.value.T
            of = cosines.argmax(1)
            codes, scale, error = coded(x)
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(at)), pa.array(of.astype(np.int32)), pa.array(np.minimum(1.0, cosines[np.arange(len(of)), of])),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at)),
                ],
                names=["id", "list", "near", "code", "scale", "error", "vector", "scope"],
            )

    placed = usable.mapInArrow(place, f"id {kind}, list int, near double, code binary, scale double, error double, vector array<double>, scope string")
    # a list with many rows is written by several tasks
    ordered = placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    ordered.write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    reach = spark.read.schema("near double, list int").parquet(f"{folder}/lists").groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("reach"))
    rows_ = [(i, c.tolist()) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(rows_, "list int, centroid array<double>").join(reach, "list").withColumn("list", F.col("list").alias("list", metadata={"id": kind}))
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        table = spark.read.parquet(f"{folder}/centroids")
        self.kind = table.schema["list"].metadata["id"]
        found = table.orderBy("list").collect()  # at most MOST_LISTS rows
        self.lists = [r["list"] for r in found]
        self.sizes = np.array([r["n"] for r in found], np.int64)
        self.reach = np.arccos(np.clip([r["reach"] for r in found], -1, 1))
        self.centroids = np.array([r["centroid"] for r in found], np.float64).reshape(len(found), -1 if found else 0)

    def most(self, q: np.ndarray) -> np.ndarray:
        """The largest cosine that a vector of each list can have with ``q``: angles add up at best."""
        away = np.arccos(np.clip(self.centroids @ q, -1, 1))
        return np.cos(np.maximum(0.0, away - self.reach)) + SLACK

    def _rows(self, lists: list[int], columns: list[str], scope: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/lists").where(F.col("list").isin(lists))
        return (rows.where(F.col("scope") == scope) if scope else rows).select("list", *columns)

    def _best(self, q: np.ndarray, lists: list[int], n: int, scope: str) -> DataFrame:
        """``id, score`` of the ``n`` best rows of ``lists``, exactly."""
        wide = float(np.linalg.norm(q))

        def bounded(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(b.num_rows, -1)
                near, off = (codes.astype(np.float32) @ q.astype(np.float32)) * b.column(3).to_numpy(), b.column(4).to_numpy() * wide + 1e-5
                least = np.partition(near - off, -n)[-n] if b.num_rows > n else -np.inf
                at = pa.array(np.flatnonzero(near + off >= least))
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(near - off).take(at), pa.array(near + off).take(at)], names=["list", "id", "low", "high"])

        rows = self._rows(lists, ["id", "code", "scale", "error"], scope)
        hopeful = rows.mapInArrow(bounded, f"list int, id {self.kind}, low double, high double").cache()
        least = hopeful.orderBy(F.desc("low")).limit(n).agg(F.min("low")).first()[0]
        hopeful_ = hopeful.where(F.col("high") >= F.lit(least)).select("list", "id")
        asked = F.lit(q.tolist()).cast("array<double>") if len(q) else F.array()
        cosine = F.greatest(F.lit(0.0), F.coalesce(S.cosine(F.col("vector"), asked), F.lit(0.0)))
        scored = self._rows(lists, ["id", "vector"], scope).join(hopeful_, ["list", "id"]).select("id", cosine.alias("score"))
        return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(n)

    def plan(self, vector: list[float], n: int, probes: int | None = None, scope: str = "") -> list[int]:
        """The lists that a question opens. Without ``probes`` the first few are searched to tell which others can matter."""
        rows, unit = matrix(pa.array([vector], pa.list_(pa.float64())))
        if not len(rows) or not self.lists or unit.shape[1] != self.centroids.shape[1]:
            return []
        q = unit[0]
        order = np.argsort(-(self.centroids @ q), kind="stable")
        if probes is not None:
            return [self.lists[i] for i in order[:probes]]
        if len(order) <= FIRST:
            return self.lists
        first = order[: max(FIRST, int(np.searchsorted(np.cumsum(self.sizes[order]), n)) + 1)]
        found = [r["score"] for r in self._best(q, [self.lists[i] for i in first], n, scope).collect()]
        needed = found[n - 1] if len(found) >= n else 0.0
        most, opened = self.most(q), set(first.tolist())
        return [self.lists[i] for i in order if i in opened or most[i] >= needed - 2 * SLACK]

    def nearest(self, vector: list[float], id_col: str, n: int = 10, probes: int | None = None, scope: str = "") -> DataFrame:
        """``id, score`` as ``search.nearest``: cosine, floored at 0, ties by id. Exact without ``probes``. A vector that is
        null or zero finds nothing."""
        lists = self.plan(vector, n, probes, scope)
        if not lists:
            return self.spark.createDataFrame([], f"`{id_col}` {self.kind}, score double")
        return self._best(matrix(pa.array([vector], pa.list_(pa.float64())))[1][0], lists, n, scope).withColumnRenamed("id", id_col)
