"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is words and runs of punctuation, and pairs of neighbours; both are hashed into a fixed number of slots, counted
and scaled to unit length. A word next to itself is one pair whatever the word, so that stuttering texts share it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import named, numbered, prepare

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT = np.uint32(0x5BD1E995)


class Units(dict):
    """Slots of the tokens of a white-space separated unit, before the modulus; forgets all at ``limit``."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[unit] = b"".join(blake2b(t.encode(), digest_size=4).digest() for t in _TOKEN.findall(unit))
        return value


_units = Units()


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; the last slot, ``1 << bits``, is the constant."""
    h = np.frombuffer(b"".join(map(_units.__getitem__, text.split())), "<u4")
    pairs = h[:-1] * np.uint32(0x9E3779B1) + h[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
    pairs[h[:-1] == h[1:]] = _REPEAT
    slots, counts = np.unique(np.concatenate([h, pairs]) & np.uint32((1 << bits) - 1), return_counts=True)
    values = counts.astype(np.float64)
    if len(values):
        values /= np.sqrt(values @ values)
    return np.append(slots, np.uint32(1 << bits)), np.append(values, 1.0)


class Ftrl:
    """Follow the regularised leader, per coordinate, with L1 and L2 terms."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (logistic(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def logistic(t: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(t, -40, 40))))


@dataclass(frozen=True)
class Model:
    """Weights that aren't zero, by slot."""

    bits: int
    slots: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << self.bits) + 1)
        out[self.slots] = self.weights
        return out


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20_000,
    max_features: int = 50_000_000,
    bits: int = 20,
    epochs: int = 2,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.5,
    l2: float = 1.0,
) -> Model:
    """A model from at most ``max_rows`` labelled rows, those with the smallest hash of their id, and of these, in the
    same order, as many as have at most ``max_features`` features together (8 bytes each in the training task).

    Of several labels of an id the mean counts, 0.5 and above as 1; null ids and labels are ignored. The sample's
    ids, at most ``max_rows``, are broadcast to the scan of ``documents``; one task then sees its features in the
    order of the hash, so a repeated run gives the same model. Without usable rows all weights are 0.
    """
    prepare(documents.sparkSession)
    kind = documents.schema[id_col].dataType
    sample = (
        labels.where(named(label_col).isNotNull() & named(id_col).isNotNull())
        .groupBy(named(id_col).cast(kind).alias("id"))
        .agg((F.avg(named(label_col)) >= 0.5).cast("double").alias("y"))
        .select("id", "y", F.xxhash64("id").alias("turn"))
        .orderBy("turn", "id")
        .limit(max_rows)
    )

    def extract(batches):
        for b in batches:
            found = [features(t or "", bits) for t in b.column(2).to_pylist()]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([s.astype("<u4").tobytes() for s, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
                names=["turn", "y", "slots", "x"],
            )

    def train(batches):
        rows, held = [], 0
        for b in batches:
            for y, s, x in zip(*(b.column(k).to_pylist() for k in ("y", "slots", "x")), strict=True):
                held += len(s) // 4
                if held <= max_features:
                    rows.append((np.frombuffer(s, "<u4"), np.frombuffer(x, "<f4"), y))
        learner = Ftrl((1 << bits) + 1, alpha, beta, l1, l2)
        for _ in range(epochs):
            for at, x, y in rows:
                learner.update(at, x, y)
        weights = learner.weights(slice(None))
        used = np.flatnonzero(weights)
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(weights[used])], names=["slot", "weight"])

    rows = documents.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(sample), "id").select("turn", "y", "text")
    extracted = rows.mapInArrow(extract, "turn long, y double, slots binary, x binary")
    found = extracted.repartition(1).sortWithinPartitions("turn", "slots").mapInArrow(train, "slot long, weight double").toPandas()
    return Model(bits, found["slot"].to_numpy(np.int64), found["weight"].to_numpy(np.float64))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(id, *keep, score)``: the probability of label 1, from the text alone.

    A null or empty text has the score of the constant term. ``keep`` names further columns to carry along.
    """
    prepare(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *(k for k in keep if k != id_col)]

    def run(batches):
        m = sent.value
        weights = m.dense()
        for b in batches:
            out = []
            for t in b.column(len(columns)).to_pylist():
                at, x = features(t or "", m.bits)
                out.append(logistic(weights[at] @ x))
            yield pa.record_batch([*(b.column(i) for i in range(len(columns))), pa.array(out, pa.float64())], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return numbered(df.select(*map(named, columns), named(text_col))).mapInArrow(run, schema + ", score double")


def accepted(df: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score at least ``threshold``, with all their columns; no score is carried along."""
    prepare(df.sparkSession)
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        m = sent.value
        weights = m.dense()
        for b in batches:
            keep = []
            for t in b.column(at).to_pylist():
                slots, x = features(t or "", m.bits)
                keep.append(logistic(weights[slots] @ x) >= threshold)
            kept = b.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch(kept.columns, names=names)

    names = df.columns
    return numbered(df).mapInArrow(run, df.schema)
