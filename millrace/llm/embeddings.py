"""Near duplicates among embeddings by cross-polytope hashing.

Vectors are rotated by sign flips and fast Hadamard transforms, and hashed to the nearest signed axis; several hashes
make a bucket's name. Each vector also visits the buckets of its next-best axes. What travels to the buckets is a sketch
of a vector's signs, 32 bytes whatever its length; sketches that are close enough leave a bucket as groups of plausible
partners, and only those meet as vectors. All pairs of a group are verified in double precision as blocks of dot
products. A pair that is in several groups is counted in the first one only, so links are counted without being listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import Forest, components
from .minhash import group_key, parts_of, runs
from .storage import named as column
from .storage import prepare, stored


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
    return x.reshape(-1, n)


def ranked_axes(x: np.ndarray, table: int, hash_: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest signed axes of each row after one random rotation, and how far they fall short."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([20240607, table, hash_, width])
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width)) / math.sqrt(width)
    size = np.abs(y)
    best = np.argsort(-size, axis=1, kind="stable")[:, :most]
    at = np.take_along_axis(size, best, 1)
    return 2 * best + (np.take_along_axis(y, best, 1) < 0), at[:, :1] - at


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables, probes) bucket names: the nearest axes, then the combinations of next-best ones that fall least
    short."""
    out = np.empty((len(x), tables, probes), np.int64)
    base = 2 << max(1, (x.shape[1] - 1).bit_length())
    each = min(probes, base // 2)
    for t in range(tables):
        axes, short = zip(*(ranked_axes(x, t, h, each) for h in range(hashes)), strict=True)
        choices = sorted(product(range(each), repeat=hashes), key=lambda c: (sum(c), c))[: 4 * probes]
        cost = np.stack([sum(short[h][:, c] for h, c in enumerate(choice)) for choice in choices], 1)
        codes = np.stack([sum(axes[h][:, c].astype(np.int64) * base**h for h, c in enumerate(choice)) for choice in choices], 1)
        picked = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(codes, picked, 1)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Signs in a sketch.
SIGNS = 256


def sketches(x: np.ndarray) -> np.ndarray:
    """(rows, SIGNS / 64) words of signs after random rotations; short vectors are rotated in 64 dimensions."""
    width = 1 << max(6, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([20240608, width])
    signs = []
    while sum(s.shape[1] for s in signs) < SIGNS:
        y = np.zeros((len(x), width))
        y[:, : x.shape[1]] = x
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        signs.append(y > 0)
    return np.packbits(np.concatenate(signs, 1)[:, :SIGNS], axis=1).view("<u8")


def most_apart(cosine: float, miss: float) -> int:
    """Signs in which a pair at ``cosine`` differs at most, but for a probability of ``miss``."""
    p, tail, k = math.acos(cosine) / math.pi, 0.0, SIGNS
    while k > 0:
        tail += math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
        if tail > miss:
            return k
        k -= 1
    return 0


def plan(rows: int, width: int, cosine: float, probes: int, bucket_rows: int, miss: float) -> tuple[int, int]:
    """(hashes, tables): enough hashes for buckets of about ``bucket_rows``, and enough tables that a pair at the
    threshold is missed with a probability below ``miss``, by its measured chance to meet in one table. Where that chance
    is too small to be measured, buckets are larger; a threshold that even one hash doesn't part is an error."""
    axes = 2 << max(1, (width - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(1, rows * probes / bucket_rows), axes)))
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 4000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = cosine * a + math.sqrt(1 - cosine**2) * b
    for hashes in range(hashes, 0, -1):
        p, q = bucket_codes(a, 1, hashes, probes)[:, 0], bucket_codes(near, 1, hashes, probes)[:, 0]
        meet = (p[:, :, None] == q[:, None, :]).any((1, 2))
        if meet.sum() >= 40:
            return hashes, max(1, math.ceil(math.log(miss) / math.log(1 - min(0.999, 0.97 * meet.mean()))))
    raise ValueError(f"a cosine of {cosine} is too low for hashing vectors of {width} components")


def near_duplicates(
    df: DataFrame,
    cosine: float = 0.9,
    probes: int = 2,
    bucket_rows: int = 1000,
    miss: float = 1e-6,
    block: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per row of ``df``: ``id, n_links, component_id, kept``.

    Rows are linked when their cosine in double precision is at least ``cosine``. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing and are their own component; vectors of different
    lengths are not compared. Equal vectors are linked with each other and compared with others once. ``n_links``
    counts linked other rows, repeated rows included; ``component_id`` is the smallest id reachable, null ids only
    where there is no other; ``kept`` tells whether it is the row's own id. Other columns are left out, an empty
    table gives an empty result. A bucket over ``block`` rows is a group as it is, and groups over ``block`` rows are
    compared in pairs of blocks, so a hot bucket is spread over tasks and no row is left out. A pair at the threshold
    is missed with a probability of ``miss`` by all tables, and of ``miss`` by its sketches.
    """
    prepare(df.sparkSession)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    # vectors travel as they came, bucket names as narrow as they fit
    held = "<f4" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"

    def clean(batches):
        part, rows = TaskContext.get().partitionId(), 0
        for b in batches:
            keys = []
            for values in b.column(1).to_pylist():
                x = np.array([math.nan if c is None else c for c in values or ()], np.float64)
                keys.append(x.astype(held).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            rid = np.arange(rows, rows + len(keys), dtype=np.int64) + (part << 33)
            rows += len(keys)
            yield pa.record_batch([b.column(0), pa.array(rid), pa.array(keys, pa.binary())], names=["id", "rid", "x"])

    rows = stored(df.select(column(id_col).alias("id"), column(vector_col).alias("vector")).mapInArrow(clean, f"id {kind}, rid long, x binary"), "vectors")
    vertices = stored(rows.where("x is not null").groupBy("x").agg(F.min("rid").alias("v"), F.min("id").alias("least_id"), F.count("*").alias("copies")), "vertices")
    total, widest = vertices.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    width = (widest or 16) // np.dtype(held).itemsize
    hashes, tables = plan(total, width, cosine, probes, bucket_rows, miss)

    def by_length(xs: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        for n in {len(x) for x in xs}:
            at = [i for i, x in enumerate(xs) if len(x) == n]
            yield at, unit(np.stack([np.frombuffer(xs[i], held) for i in at]).astype(np.float64))

    def name(batches):
        for b in batches:
            codes: list = [None] * b.num_rows
            signs: list = [None] * b.num_rows
            for at, m in by_length(b.column(1).to_pylist()):
                for i, c, s in zip(at, bucket_codes(m, tables, hashes, probes), sketches(m), strict=True):
                    codes[i], signs[i] = c.ravel(), s.tobytes()
            size = pa.array([len(x) for x in b.column(1).to_pylist()], pa.int32())
            yield pa.record_batch([b.column(0), size, pa.array(signs, pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=["v", "bytes", "signs", "codes"])

    named = stored(vertices.select("v", "x").mapInArrow(name, "v long, bytes int, signs binary, codes array<bigint>"), "codes")
    bucket = F.xxhash64("bytes", F.floor(F.col("pos") / probes), "code")
    visits = named.select("v", "signs", "bytes", F.posexplode("codes").alias("pos", "code")).select("v", "signs", bucket.alias("bucket"))
    sizes = visits.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(visits.join(sizes, "bucket"), "buckets")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    farthest = most_apart(cosine, miss)

    def plausible(batches):
        for table, starts in runs(batches, "bucket"):
            keys, members = [], []
            v, signs = table.column("v").to_numpy(), np.frombuffer(b"".join(table.column("signs").to_pylist()), "<u8").reshape(table.num_rows, -1)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                apart = np.zeros((hi - lo, hi - lo), np.uint16)
                for word in signs[lo:hi].T:
                    apart += np.bitwise_count(word[:, None] ^ word[None, :])
                near = apart <= farthest
                np.fill_diagonal(near, False)
                for part in parts_of(near):
                    part = v[lo:hi][part]
                    keys.append(np.full(len(part), group_key(np.sort(part)), np.int64))
                    members.append(part)
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members))], names=["group", "v"])

    # a bucket that is too large for one task is a group as it is
    small_ones = shared.where(F.col("n") <= block).select("bucket", "v", "signs").repartition(tasks, "bucket").sortWithinPartitions("bucket", "v")
    groups = small_ones.mapInArrow(plausible, "group long, v long").unionByName(shared.where(F.col("n") > block).select(F.col("bucket").alias("group"), "v"))
    groups = stored(groups.distinct(), "groups")
    own_groups = groups.groupBy("v").agg(F.sort_array(F.collect_list("group")).alias("groups"))  # at most tables * probes
    spread = groups.join(groups.groupBy("group").agg(F.count("*").alias("n")), "group").withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = spread.select(
        F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "v", "group",
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )

    def verify(batches):
        for table, starts in runs(batches, "task"):
            v, side, group = (table.column(c).to_numpy() for c in ("v", "side", "group"))
            copies, xs, of = table.column("copies").to_numpy(), table.column("x").to_pylist(), table.column("groups").to_pylist()
            out_v, out_n, out_a, out_b = [], [], [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                m = unit(np.stack([np.frombuffer(x, held) for x in xs[lo:hi]]).astype(np.float64))
                s = side[lo:hi]
                inside = np.flatnonzero(s == 0)
                first, second = (inside, inside) if len(inside) else (np.flatnonzero(s == 1), np.flatnonzero(s == 2))
                count, forest = np.zeros(hi - lo, np.int64), Forest()
                # groups before this one, in which a pair may have been counted
                before = [[g for g in gs if g < group[lo]] for gs in of[lo:hi]]
                width_of = max(map(len, before))
                earlier = np.zeros((hi - lo, width_of), np.int64)
                known = np.zeros((hi - lo, width_of), bool)
                for i, gs in enumerate(before):
                    earlier[i, : len(gs)] = gs
                    known[i, : len(gs)] = True
                for at in range(0, len(first), 1024):
                    i, j = np.nonzero(m[first[at : at + 1024]] @ m[second].T >= cosine)
                    i, j = first[at + i], second[j]
                    if first is second:
                        i, j = i[i < j], j[i < j]
                    for p in range(0, len(i), 20_000):
                        a, b = i[p : p + 20_000], j[p : p + 20_000]
                        counted = np.zeros(len(a), bool)
                        for k in range(width_of):
                            counted |= known[a, k] & ((earlier[a, k, None] == earlier[b]) & known[b]).any(1)
                        a, b = a[~counted], b[~counted]
                        np.add.at(count, a, copies[lo + b])
                        np.add.at(count, b, copies[lo + a])
                        for c, d in zip(a.tolist(), b.tolist(), strict=True):
                            if forest.join(c, d):
                                out_a.append(v[lo + c])
                                out_b.append(v[lo + d])
                linked = np.flatnonzero(count)
                out_v += v[lo:hi][linked].tolist()
                out_n += count[linked].tolist()
            if out_v:
                empty = [None] * len(out_a)
                yield pa.record_batch(
                    [pa.array(out_v + empty, pa.int64()), pa.array(out_n + empty, pa.int64()), pa.array([None] * len(out_v) + out_a, pa.int64()), pa.array([None] * len(out_v) + out_b, pa.int64())],
                    names=["v", "n", "a", "b"],
                )

    laden = meeting.join(vertices.select("v", "x", "copies").join(own_groups, "v"), "v").repartition(tasks, "task").sortWithinPartitions("task", "v")
    found = stored(laden.select("task", "v", "group", "side", "x", "copies", "groups").mapInArrow(verify, "v long, n long, a long, b long"), "verified")
    counts = found.where("v is not null").groupBy("v").agg(F.sum("n").alias("n"))
    roots = components(found.where("a is not null").select("a", "b"))
    placed = vertices.join(counts, "v", "left").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_vector = placed.join(least, "root").select("x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(of_vector, "x", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("x").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
