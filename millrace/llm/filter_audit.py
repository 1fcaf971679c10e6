"""How quality filters act on each other: what each one removes in every order of the filters.

Texts are read once, as Arrow buffers: NumPy byte classes and prefix sums count words, capitals, symbols and code
points, and the sorted and verified word hashes of a document give its distinct words. A document then is a mask of the
filters it fails, and everything the audit reports is a sum over masks.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import buffers
from .storage import named, prepare, stored

FILTERS = "ABCDE"


def failures(data: np.ndarray, bounds: np.ndarray, least_words: int, distinct_percent: int, capital_percent: int, symbols: str) -> np.ndarray:
    """The mask of filters A to D that each text fails."""
    starts, ends, texts = buffers.runs(~buffers.BLANK[data], bounds)
    words = np.bincount(texts, minlength=len(bounds) - 1)
    first = buffers.repeats(data, starts, ends, texts) == np.arange(len(starts))
    distinct = np.bincount(texts[first], minlength=len(bounds) - 1)
    capitals = buffers.per_text((data >= ord("A")) & (data <= ord("Z")), bounds)
    points = buffers.per_text((data & 0xC0) != 0x80, bounds)
    marked = np.zeros(256, bool)
    marked[list(symbols.encode("ascii"))] = True
    fails = (words < least_words, 100 * distinct < distinct_percent * words, 100 * capitals > capital_percent * points, buffers.per_text(marked[data], bounds) > 0)
    return sum(f.astype(np.int8) << i for i, f in enumerate(fails))


def _orders() -> Column:
    """All orders of the filters, step by step: the filter's bit and the bits before it. A constant of 600 rows."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[g] for g in order), "step": i + 1, "bit": 1 << f, "before": sum(1 << g for g in order[:i])})
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(
    df: DataFrame,
    labels: DataFrame,
    least_words: int = 200,
    distinct_percent: int = 50,
    capital_percent: int = 2,
    symbols: str = "#$%&*|",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """One row per part, order of the five filters and step: ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``.

    A document fails A with under ``least_words`` words, B with under ``distinct_percent`` percent distinct words, C
    with over ``capital_percent`` percent capitals A to Z among its code points, D with any of ``symbols``, and E if a
    row with a smaller id has the same text, in whatever part. Null texts are empty, and an empty text fails A only,
    and E where it is a copy. Null parts are the part ''. Rows that share an id are documents of their own, which don't
    make each other copies. A null id is neither smaller than another nor has a smaller one, and no label. ``labels``
    are good or toxic if any row of that id says so. Other columns are left out; an empty table gives no rows. Texts of
    any length are scanned whole, with working memory of some thirty times the longest.
    """
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches):
        for b in batches:
            data, bounds = buffers.text_bytes(b.column(2))
            masks, digests = [np.zeros(0, np.int8)], []
            for lo, hi in buffers.groups(bounds):
                begin = bounds[lo]
                masks.append(failures(data[begin : bounds[hi]], bounds[lo : hi + 1] - begin, least_words, distinct_percent, capital_percent, symbols))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(data[lo:hi]).digest())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.concatenate(masks)), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    read = df.select(named(id_col).alias("id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), named(text_col).alias("text"))
    rows = read.mapInArrow(scan, f"id {kind}, part string, mask tinyint, digest binary").groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")]
    known = labels.groupBy(named(id_col).alias("id")).agg(*flags)
    rows = rows.join(known, "id", "left")
    n, good, toxic = F.col("n"), F.col("n") * F.coalesce("quality", F.lit(0)), F.col("n") * F.coalesce("toxic", F.lit(0))
    # copies become one row for each part; the rows of the smallest id there may be the text's first ones
    texts = stored(
        rows.groupBy("digest", "part", "mask").agg(
            F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"),
            F.sum(F.when(F.col("id").isNull(), n).otherwise(0)).alias("nameless"),
            F.min_by(F.struct("id", n.alias("n"), good.alias("good"), toxic.alias("toxic")), "id").alias("first"),
        ),
        "audited",
    )
    texts = texts.join(texts.groupBy("digest").agg(F.min("first.id").alias("least")), "digest")

    def ahead(c: str) -> Column:
        """What isn't a copy."""
        return F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(0)

    copy = 1 << FILTERS.index("E")
    halves = F.array(
        F.struct(F.col("mask").cast("int").alias("mask"), (ahead("n") + F.col("nameless")).alias("n"), ahead("good").alias("good"), ahead("toxic").alias("toxic")),
        F.struct(
            (F.col("mask") + copy).cast("int").alias("mask"), (F.col("n") - F.col("nameless") - ahead("n")).alias("n"),
            (F.col("good") - ahead("good")).alias("good"), (F.col("toxic") - ahead("toxic")).alias("toxic"),
        ),
    )
    counted = texts.select("part", F.explode(halves).alias("h")).select("part", "h.*").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 each

    def total(what: str, condition: str) -> Column:
        return F.expr(f"aggregate(masks, 0L, (a, m) -> a + if({condition}, {what}, 0L))")

    here = "m.mask & bit != 0 and m.mask & before = 0"
    return parts.select("part", "masks", F.explode(_orders()).alias("o")).select("part", "masks", "o.*").select(
        "part", "filter_order", "step",
        total("m.n", "m.mask & (bit | before) = 0").alias("kept"),
        total("m.n", here).alias("removed"),
        total("m.n", "m.mask & bit != 0 and m.mask & before != 0").alias("redundant"),
        total("m.n", "m.mask = bit").alias("unique_fails"),
        total("m.good", here).alias("good_lost"),
        total("m.toxic", here).alias("toxic_lost"),
        # among the filters that a document fails, each comes first in as many of the 120 orders
        total("m.n * (120 div bit_count(m.mask))", "m.mask & bit != 0").alias("shapley"),
    )
