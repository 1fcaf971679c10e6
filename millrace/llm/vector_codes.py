"""Vectors as short codes: integer parts, each replaced by the number of its nearest codebook entry.

Equal integer parts of a position become one row with a weight, and Lloyd's rounds run over those rows alone. Codes and
errors are then joined back to the vectors. Arithmetic is exact: distances are integers, whatever their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_KEYS, join_weighted, named, prepare, small, stored

#: Integers beyond this magnitude are set to it, and errors beyond a long are the largest long.
FARTHEST = 1 << 62
_LONGEST = (1 << 63) - 1


def narrow(part: np.ndarray) -> list[bytes]:
    """Each row in 2, 4 or 8 bytes an integer, as its largest needs, so equal rows are equal bytes."""
    top = np.where(part.min(1, initial=0) < 0, np.maximum(part.max(1, initial=0), ~part.min(1, initial=0)), part.max(1, initial=0))
    out: list = [None] * len(part)
    for kind, lo, hi in (("<i2", 0, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
        at = np.flatnonzero((top >= lo) & (top < hi))
        for i, row in zip(at.tolist(), part[at].astype(kind), strict=True):
            out[i] = row.tobytes()
    return out


def widen(parts: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(parts), width), np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(parts[i] for i in at.tolist()), f"<i{size // width}").reshape(-1, width) if width else 0
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(index, squared distance) of the nearest entry of each row, the lowest index among equals. Products of doubles
    where all sums stay exact, else 64-bit differences, else Python's integers."""
    codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    width = max(1, x.shape[1])
    reach = [max(abs(a), abs(b)) for a, b in zip(x.max(1, initial=0).tolist(), x.min(1, initial=0).tolist(), strict=True)]
    far = max(abs(int(book.max(initial=0))), abs(int(book.min(initial=0))))
    cost = np.array([0 if width * (r + far) ** 2 < 1 << 53 else 1 if width * (r + far) ** 2 < 1 << 63 else 2 for r in reach], np.int8)
    at = np.flatnonzero(cost == 0)
    if len(at):
        b = book.astype(np.float64)
        own = (b * b).sum(1)
        for i in range(0, len(at), 4096):
            a = x[at[i : i + 4096]].astype(np.float64)
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + own
            codes[at[i : i + 4096]] = c = d.argmin(1)
            errors[at[i : i + 4096]] = d[np.arange(len(c)), c].astype(np.int64).tolist()
    for tier, kind in ((1, np.int64), (2, object)):
        at = np.flatnonzero(cost == tier)
        for i in range(0, len(at), 64):
            d = ((x[at[i : i + 64]].astype(kind)[:, None, :] - book.astype(kind)[None]) ** 2).sum(2)
            codes[at[i : i + 64]] = c = d.argmin(1)
            errors[at[i : i + 64]] = d[np.arange(len(c)), c].tolist()
    return codes, errors.tolist()


def cuts(width: int, parts: int) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


def quantised(df: DataFrame, parts: int, scale: int) -> DataFrame:
    """``id, label, rid, width, parts`` of the rows whose vector is whole."""
    id_kind, label_kind = (df.schema[c].dataType.simpleString() for c in ("id", "label"))

    def quantise(batches):
        task, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            column = b.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole = (size > 0) & (broken[ends] == broken[ends - size])
            out: list = [None] * len(size)
            for width in np.unique(size[whole]).tolist():
                at = np.flatnonzero(whole & (size == width))
                with np.errstate(over="ignore"):
                    x = np.floor(values[(ends - size)[at][:, None] + np.arange(width)] * float(scale))
                x = np.clip(x, -float(FARTHEST), float(FARTHEST)).astype(np.int64)
                edges = cuts(width, parts)
                columns = [narrow(x[:, lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                for i, row in zip(at.tolist(), zip(*columns, strict=True), strict=True):
                    out[i] = row
            rid = np.arange(seen, seen + len(size), dtype=np.int64) + (task << 33)
            seen += len(size)
            keep = pa.array(whole)
            arrays = [b.column(0), b.column(1), pa.array(rid), pa.array(size.astype(np.int32)), pa.array(out, pa.list_(pa.binary()))]
            yield pa.record_batch([a.filter(keep) for a in arrays], names=["id", "label", "rid", "width", "parts"])

    return df.mapInArrow(quantise, f"id {id_kind}, label {label_kind}, rid long, width int, parts array<binary>")


def lloyd(distinct: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assigning the weighted rows and taking floors of means. A task sends one row for
    each component of an entry it used, so what reaches the driver is as large as the codebooks."""

    def gather(books: list[np.ndarray]):
        def sums(batches) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], list] = {}
            for b in batches:
                pos, weight, parts = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).to_pylist()
                for p in np.unique(pos).tolist():
                    at = np.flatnonzero(pos == p)
                    x, w = widen([parts[i] for i in at.tolist()], books[p].shape[1]), weight[at]
                    codes, _ = nearest(x, books[p])
                    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
                    kind = np.int64 if top * int(w.sum()) < 1 << 62 else object
                    total = np.zeros((len(books[p]), x.shape[1] + 1), kind)
                    np.add.at(total, codes, np.concatenate([x.astype(kind), np.ones((len(x), 1), kind)], 1) * w.astype(kind)[:, None])
                    for code in np.unique(codes).tolist():
                        row, old = total[code].tolist(), found.get((p, code))
                        found[p, code] = row if old is None else [m + n for m, n in zip(old, row, strict=True)]
            for (p, code), row in found.items():
                n = len(row)
                yield pa.record_batch(
                    [pa.array([p] * n, pa.int32()), pa.array([code] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([Decimal(v) for v in row], pa.decimal128(38, 0))],
                    names=["pos", "code", "at", "total"],
                )

        return sums

    for _ in range(rounds):
        sums = distinct.select("pos", "part", "weight").mapInArrow(gather(books), "pos int, code int, at int, total decimal(38,0)")
        sums = sums.groupBy("pos", "code", "at").agg(F.sum("total").alias("total")).collect()  # entries x (width + parts)
        found: dict[tuple[int, int], dict[int, int]] = {}
        for pos, code, at, total in sums:
            found.setdefault((pos, code), {})[at] = int(total)
        books = [book.copy() for book in books]
        for (pos, code), row in found.items():
            width = books[pos].shape[1]
            books[pos][code] = [row[i] // row[width] for i in range(width)]
    return books


def compress(
    df: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per kept row: ``id, code, error, label_error, codebooks_sha256``.

    Rows go whose vector is null, empty, or holds null or non-finite components, or has another length than most rows
    (the longest of equally frequent lengths); an empty table gives no rows. Integers are ``floor(scale * x)``, at most
    2^62 in magnitude. Vectors are cut into ``parts``, which are equal where the length allows it. The first codebooks
    are the parts of the ``entries`` smallest ids, nulls last and repeated ids by their parts, fewer where there are
    fewer rows. ``code`` has two hexadecimal digits a part (``entries`` is at most 256). ``error`` sums squared
    distances, and is the largest long beyond it; ``label_error`` sums errors over equal labels, nulls together, and is
    null beyond a long. Repeated ids are rows of their own. Other columns are left out.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has room for 1 to 256 entries")
    prepare(df.sparkSession)
    whole = stored(quantised(df.select(named(id_col).alias("id"), named(label_col).alias("label"), named(vector_col).alias("vector")), parts, scale), "quantised")
    most = whole.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else parts
    rows = whole.where(F.col("width") == width)
    edges = cuts(width, parts)
    widths = [hi - lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    first = rows.orderBy(F.asc_nulls_last("id"), "parts").select("parts").limit(entries).collect()
    books = [widen([bytes(r["parts"][p]) for r in first], w) for p, w in enumerate(widths)]
    distinct = rows.select(F.posexplode("parts").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    distinct = stored(distinct, "distinct_parts")
    books = lloyd(distinct, books, rounds)

    def assign(batches):
        for b in batches:
            pos, xs = b.column(0).to_numpy(), b.column(1).to_pylist()
            codes, errors = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos).tolist():
                at = np.flatnonzero(pos == p)
                codes[at], found = nearest(widen([xs[i] for i in at.tolist()], widths[p]), books[p])
                errors[at] = [min(e, _LONGEST) for e in found]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([f"{c:02x}" for c in codes.tolist()]), pa.array(errors)], names=["pos", "part", "weight", "digits", "gap"])

    coded = stored(distinct.mapInArrow(assign, "pos int, part binary, weight long, digits string, gap long"), "coded_parts")
    pieces = rows.select("rid", "id", "label", F.posexplode("parts").alias("pos", "part"))
    found = join_weighted(pieces, coded, ["pos", "part"], "weight", F.xxhash64("rid"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "digits", "gap")))  # as many as parts
    vectors = found.groupBy("rid").agg(F.first("id").alias("id"), F.first("label").alias("label"), in_order.alias("p"))
    total = F.expr(f"cast(least(aggregate(p, cast(0 as decimal(38,0)), (a, x) -> cast(a + x.gap as decimal(38,0))), {_LONGEST}) as long)")
    vectors = stored(vectors.select("id", "label", F.array_join("p.digits", "").alias("code"), total.alias("error")), "vector_codes")
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    by_label = vectors.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    by_label = F.broadcast(by_label) if small(by_label, BROADCAST_KEYS) else by_label
    return vectors.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
