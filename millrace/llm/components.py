"""Connected components of a link table: local forests first, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_KEYS, stored


class Forest:
    """Union-find over arbitrary keys; the smaller root stays."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Vertices that a task's forest holds before it is passed on and begun anew.
FOREST_VERTICES = 1_000_000


def _contract(batches):
    forest = Forest()

    def out():
        pairs = [(x, forest.find(x)) for x in list(forest.up)]
        for at in range(0, len(pairs), 100_000):
            some = np.array(pairs[at : at + 100_000], np.int64)
            yield pa.record_batch([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["a", "b"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        if len(forest.up) > FOREST_VERTICES:
            yield from out()
            forest = Forest()
    yield from out()


def components(links: DataFrame, contract: bool = True, rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of ``links (a long, b long)``: the smallest vertex that it reaches.

    ``contract`` reduces each partition to a forest first; callers whose links come as forests leave it out, and so
    keep a second Python worker out of their stage. Self links are ignored, repeated links and either direction are fine; vertices without links are not listed.
    Each round is a stored table of at most as many rows as vertices and links. No vertex's links need to be in
    one task: minima are aggregated, and the join on a hub is one that Spark can split.
    """
    edges = links.select("a", "b").where("a != b")
    edges = stored(edges.mapInArrow(_contract, "a long, b long") if contract else edges, "links")
    # a table of minima is broadcast while it is small; beyond that it is stored, so that the join reads two plain
    # exchanges and Spark can split a hub's partition
    near = lambda df: F.broadcast(df) if 2 * n <= BROADCAST_KEYS else stored(df, "minima")
    n, seen = edges.count(), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(near(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # every vertex now points down only; its smallest neighbour takes the others and itself
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        others = large.join(near(down), "a")
        small = others.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first())
        n = state[0]
        if state == seen and state[0] == state[2]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
