"""Near duplicates by a chosen-path set similarity join.

Every distinct shingle set has minwise tokens. A tree sends sets to child nodes by the value of a chosen minwise
token, and splits a node again by the next chosen one while it is large. Inside a small node the minwise tokens of all
members are compared. No token is chosen twice, so the trees are independent, and there are so many that a pair at the
threshold t is missed with a probability ``(1 - t^d)^trees`` of at most ``MISS``.

Plausible partners are confirmed on full sets in two passes. The first lets each member of a node meet one
representative, which gives classes; a node that is still large at the last depth d is dealt in chunks that share some
of its members. The second compares only plausible partners of different classes, so members of a class are never
listed in pairs, however many they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import Forest, components
from .storage import named, prepare, small, stored, whole_row, without

#: Rows of ``(group, vertex)`` up to which they are broadcast to the tables' scan (16 bytes a row).
BROADCAST_ROWS = 1_000_000

#: Probability that no tree joins a pair at the threshold.
MISS = 1e-7

#: Shingles of a block of texts that one task confirms against another; a longer text is a block of its own.
BLOCK_SHINGLES = 1 << 21


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds ``limit``."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = blake2b(word, digest_size=8).digest()
        return value


_words = WordHashes()


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: words are split at ASCII white space after A-Z is
    lower-cased; a shorter text is one shingle, a text without words none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, tokens)), "<u8")
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        x = x ^ (x >> np.uint64(29))
    return np.unique(x * np.uint64(0xBF58476D1CE4E5B9))


def minwise(shingle_set: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each function, as 32-bit integers."""
    least = None
    for at in range(0, len(shingle_set), 4096):
        h = (shingle_set[at : at + 4096, None] * multipliers + addends).min(0)
        least = h if least is None else np.minimum(least, h)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def functions(count: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def trees_for(percent: int, depth: int, miss: float = MISS) -> int:
    """Least number of independent trees of that depth that all part a pair at the threshold with a probability of at
    most ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** depth)))) if percent < 100 else 1


def runs(batches, key: str) -> Iterator[tuple[dict[str, list], np.ndarray]]:
    """Rows of a partition sorted by ``key`` in blocks that hold whole runs: columns, and the starts of the runs."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) and keys[0] <= keys[-1] else 0
        if last:
            yield _block(table.slice(0, last), keys[:last])
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield _block(rest, rest.column(key).to_numpy())


def _block(table: pa.Table, keys: np.ndarray):
    return table, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def parts_of(adjacent: np.ndarray) -> list[np.ndarray]:
    """Connected parts with at least two members of a boolean adjacency matrix."""
    open_, found = np.ones(len(adjacent), bool), []
    for i in range(len(adjacent)):
        if open_[i]:
            open_[i] = False
            part, front = [i], [i]
            while front:
                new = np.flatnonzero(adjacent[front].any(0) & open_)
                open_[new] = False
                front = new.tolist()
                part += front
            if len(part) > 1:
                found.append(np.array(sorted(part)))
    return found


def group_key(members: np.ndarray) -> int:
    return int.from_bytes(blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def agreements(sig: np.ndarray) -> np.ndarray:
    """In how many columns each row agrees with each other; 0 with itself."""
    agree = np.zeros((len(sig), len(sig)), np.uint8)
    for c in np.ascontiguousarray(sig.T):
        agree += c[:, None] == c[None, :]
    np.fill_diagonal(agree, 0)
    return agree


def hubs_of(agree: np.ndarray, bars: Iterable[int]) -> list[tuple[int, np.ndarray]]:
    """(hub, members): each row that agrees enough with another is a member once or a hub, under the highest bar that
    it reaches. It joins a hub if it can, else becomes one for those that are left."""
    out, alone, hub = [], np.ones(len(agree), bool), np.zeros(len(agree), bool)
    for bar in bars:
        near = agree >= bar
        for i in np.flatnonzero(near.any(1) & alone).tolist():
            if not alone[i]:
                continue
            alone[i] = False
            if (known := np.flatnonzero(near[i] & hub)).size:
                out.append((int(known[0]), np.array([i])))
            elif (mine := np.flatnonzero(near[i] & alone)).size:
                hub[i], alone[mine] = True, False
                out.append((i, mine))
            else:
                out.append((int(agree[i].argmax()), np.array([i])))
    return out


def signatures(table: pa.Table) -> np.ndarray:
    sig = table.column("sig").combine_chunks()
    return (pa.concat_arrays(sig.chunks) if isinstance(sig, pa.ChunkedArray) else sig).flatten().to_numpy().reshape(table.num_rows, -1)


def star_pairs(agree_at: int, tokens: int):
    """Task: for each member of a node with plausible partners one pair ``(hub, v)``, so that hubs are few; and the
    nodes whose plausible pairs are more than those."""
    bars = (agree_at + 2 * (tokens - agree_at) // 3, agree_at + (tokens - agree_at) // 3, agree_at)

    def run(batches):
        for table, starts in runs(batches, "node"):
            v, sig, node = table.column("v").to_numpy(), signatures(table), table.column("node").to_numpy()
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[(sig[two] == sig[two + 1]).sum(1) >= agree_at]
            hubs, members, marked = [v[two]], [v[two + 1]], []
            for lo, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                agree, given = agreements(sig[lo : lo + n]), 0
                for hub, mine in hubs_of(agree, bars):
                    hubs.append(np.full(len(mine), v[lo + hub]))
                    members.append(v[lo + mine])
                    given += len(mine)
                if given < int((agree >= agree_at).sum()) // 2:
                    marked.append(node[lo])
            a, b = np.concatenate(hubs), np.concatenate(members)
            if len(a) or marked:
                yield pa.record_batch(
                    [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(marked), pa.int64())]) for x in (a, b)] + [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(marked, pa.int64())])],
                    names=["hub", "v", "node"],
                )

    return run


def rest_groups(agree_at: int, block: int):
    """Task: plausible partners of different classes, in groups; a group of over ``block`` members or
    ``BLOCK_SHINGLES`` shingles becomes all pairs of its blocks."""

    def run(batches):
        keys, members = [], []

        def add(vs: np.ndarray, lengths: np.ndarray) -> None:
            order = np.argsort(vs)
            vs, lengths = vs[order], lengths[order]
            blocks, held = [[]], 0
            for x, n in zip(vs.tolist(), lengths.tolist(), strict=True):
                if blocks[-1] and (held + n > BLOCK_SHINGLES or len(blocks[-1]) == block):
                    blocks.append([])
                    held = 0
                blocks[-1].append(x)
                held += n
            for p in ([vs] if len(blocks) == 1 else (np.array(blocks[i] + blocks[j]) for j in range(len(blocks)) for i in range(j))):
                keys.append(np.full(len(p), group_key(p), np.int64))
                members.append(p)

        for table, starts in runs(batches, "node"):
            v, sig = table.column("v").to_numpy(), signatures(table)
            root, length = table.column("root").to_numpy(), table.column("n_shingles").to_numpy()
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = root[lo:hi]
                if (own == own[0]).all():
                    continue
                near = (agreements(sig[lo:hi]) >= agree_at) & (own[:, None] != own[None, :])
                for part in parts_of(near):
                    add(v[lo:hi][part], length[lo:hi][part])
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(members))], names=["group", "v"])
                keys, members = [], []

    return run


def star_links(words: int, percent: int):
    """Task: the pairs of a group's hub, its first row, with the others that reach 100 * intersection >= percent *
    union. Holds the sets of a hub and of one other row."""

    def run(batches):
        hub, of_hub = 0, None
        for batch in batches:
            a, b = [], []
            for v, member, text in zip(*(batch.column(k).to_pylist() for k in ("v", "member")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = shingles(text, words)
                if not member:
                    hub, of_hub = v, own
                    continue
                i = len(np.intersect1d(of_hub, own, assume_unique=True))
                if 100 * i >= percent * (len(of_hub) + len(own) - i):
                    a.append(hub)
                    b.append(v)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def group_links(words: int, percent: int):
    """Task: a spanning forest of each group's pairs with 100 * intersection >= percent * union."""

    def run(batches):
        for table, starts in runs(batches, "group"):
            a, b = [], []
            v, texts = table.column("v").to_pylist(), table.column("text").cast(pa.binary())
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets, forest = [shingles(t, words) for t in texts.slice(lo, hi - lo).to_pylist()], Forest()
                n = np.array([len(s) for s in sets], np.float64)
                both = intersections(sets).astype(np.float64)
                linked = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)
                for i, j in np.argwhere(linked).tolist():
                    if forest.join(i, j):
                        a.append(v[lo + i])
                        b.append(v[lo + j])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, exact, by dense products over the elements that at least two sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    row, col = owner[shared], number[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        dense = np.zeros((len(sets), columns), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``df``: ``id, n_shingles, component_id, kept``.

    Rows are linked when 100 * |A & B| >= percent * |A | B| for their sets of ``words``-word shingles; every link is
    confirmed on full sets. A text of fewer words is one shingle; without words or null, it is linked with nothing
    and stays. ``component_id`` is the smallest id reachable (null ids count only if there is no other); of a
    component the row with that id is ``kept``, of rows that repeat it the first. Other columns are left out; an empty
    table gives an empty result. ``options`` are those of ``resolve``.
    """
    docs, of_set = resolve(df.select(named(id_col), named(text_col)), id_col, text_col, **options)
    own = F.col("row")[id_col]
    lone = F.col("set_key").isNull()
    return (
        docs.join(of_set, "set_key", "left")
        .select(own.alias(id_col), "n_shingles", F.when(lone, own).otherwise(F.col("least.id")).alias("component_id"), (lone | (F.col("rid") == F.col("least.rid"))).alias("kept"))
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps, with all their columns."""
    docs, of_set = resolve(df, id_col, text_col, **options)
    dropped = stored(docs.select("rid", "set_key").join(of_set, "set_key").where(F.col("rid") != F.col("least.rid")).select("rid"), "dropped")
    return without(docs.select("rid", "row"), dropped, "rid").select("row.*")


def resolve(
    df: DataFrame,
    id_col: str,
    text_col: str,
    words: int = 5,
    percent: int = 80,
    trees: int | None = None,
    tokens: int = 32,
    agree_at: int = 14,
    node_limit: int = 512,
    depth: int = 2,
    block: int = 512,
) -> tuple[DataFrame, DataFrame]:
    """(rows as ``rid, row, n_shingles, set_key``, the least row ``(missing, id, rid)`` of the component of each set).

    A pair at the threshold t whose nodes are split to depth d is missed with probability (1 - t^d)^trees; ``trees`` is
    by default the least number for ``MISS`` at the last depth, 16 for 80 percent and two levels. With ``agree_at`` of
    ``tokens`` another 1e-6 is missed at 80 percent. Every level of every tree has a token of its own. Nodes over
    ``node_limit`` members at the last depth are dealt in chunks in the first pass, and in the second in all pairs of
    blocks that hold different classes; groups over ``block`` members or ``BLOCK_SHINGLES`` shingles are confirmed in
    pairs of blocks. So no member is left out, and no task grows with a node or group.
    """
    prepare(df.sparkSession)
    trees = trees_for(percent, depth) if trees is None else trees
    multipliers, addends = functions(max(tokens, trees * depth))

    def read(batches):
        part, rows = TaskContext.get().partitionId(), 0
        for b in batches:
            n, keys, sigs = [], [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(raw or b"", words)
                n.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(minwise(s, multipliers, addends) if len(s) else None)
            rid = pa.array(np.arange(rows, rows + len(n), dtype=np.int64) + (part << 33))
            rows += len(n)
            yield pa.record_batch(
                [b.column(0), rid, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["row", "rid", "n_shingles", "set_key", "sig"],
            )

    schema = T.StructType([T.StructField("row", df.schema), *T._parse_datatype_string("rid long, n_shingles long, set_key binary, sig array<int>")])
    docs = stored(df.select(whole_row(df).alias("row"), named(text_col).alias("__text")).mapInArrow(read, schema), "shingled")
    # equal sets are one vertex, named by its first row
    own = F.col("row")[id_col]
    least = F.min(F.struct(own.isNull().alias("missing"), own.alias("id"), F.col("rid")))
    vertices = docs.where("set_key is not null").groupBy("set_key")
    vertices = vertices.agg(F.min("rid").alias("v"), least.alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    vertices = stored(vertices, "vertices")
    texts = docs.select(F.col("rid").alias("v"), F.col("row")[text_col].alias("text"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def together(wanted: DataFrame, order: list[str]) -> DataFrame:
        return texts.join(F.broadcast(wanted) if small(wanted, BROADCAST_ROWS) else wanted, "v").repartition(tasks, "group").sortWithinPartitions(*order)

    compared = vertices.select("v", "n_shingles", F.slice("sig", 1, tokens).alias("sig"))
    fit, large = tree_nodes(vertices, trees, node_limit, depth)
    first = fit if large is None else fit.unionByName(chunks(large, node_limit))
    first = first.join(compared, "v").select("node", "v", "sig").repartition(tasks, "node").sortWithinPartitions("node", "v")
    found = stored(first.mapInArrow(star_pairs(agree_at, tokens), "hub long, v long, node long").distinct(), "stars_found")
    pairs = found.where("hub is not null").select("hub", "v")
    dealt = pairs.join(pairs.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("long").alias("groups")), "hub")
    dealt = dealt.select("hub", "v", F.xxhash64("hub", F.pmod(F.xxhash64("v"), "groups")).alias("group"))
    stars = dealt.select("group", "v", F.lit(True).alias("member")).unionByName(dealt.select("group", F.col("hub").alias("v"), F.lit(False).alias("member")).distinct())
    links = together(stored(stars, "stars_dealt"), ["group", "member"]).select("v", "member", "text").mapInArrow(star_links(words, percent), "a long, b long")
    roots = stored(components(links, contract=False), "classes")

    marked = found.where("node is not null").select("node")
    again = fit.join(marked, "node")
    if large is not None:
        again = again.unionByName(class_blocks(large.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), max(1, node_limit // 2)))
    again = again.join(compared, "v").join(roots, "v", "left").select("node", "v", F.coalesce("root", "v").alias("root"), "n_shingles", "sig")
    again = again.repartition(tasks, "node").sortWithinPartitions("node", "v")
    groups = stored(again.mapInArrow(rest_groups(agree_at, block), "group long, v long").distinct(), "groups")
    more = stored(together(groups, ["group", "v"]).select("group", "v", "text").mapInArrow(group_links(words, percent), "a long, b long"), "more_links")
    placed = vertices.select("set_key", "v", "least").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    if not more.isEmpty():
        of = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"root_{c}"))
        between = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
        joined = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))).select(F.col("v").alias("root"), F.col("root").alias("final"))
        placed = placed.join(joined, "root", "left").withColumn("root", F.coalesce("final", "root"))
    of_root = placed.groupBy("root").agg(F.min("least").alias("least"))
    return docs.drop("sig"), placed.select("set_key", "root").join(of_root, "root").select("set_key", "least")


def tree_nodes(vertices: DataFrame, trees: int, node_limit: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """(``(node, v)`` of nodes up to ``node_limit``, ``(node, v, n)`` of those that are larger at the last depth). Level
    l of a tree chooses token ``(l - 1) * trees + tree``."""
    sig = vertices.select("v", "sig")
    rows = sig.select("v", F.posexplode(F.slice("sig", 1, trees)).alias("tree", "token")).select("v", "tree", F.xxhash64("tree", "token").alias("node"))
    ready = None
    for level in range(1, depth + 1):
        # stored, so that the join reads two plain exchanges and Spark can split a hot node
        sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        shared = stored(rows.join(sizes, "node"), "nodes")
        fit = shared.where(F.col("n") <= node_limit).select("node", "v")
        ready = fit if ready is None else ready.unionByName(fit)
        large = shared.where(F.col("n") > node_limit)
        if large.isEmpty():
            return ready, None
        chosen = F.col("tree") + level * trees
        if level < depth:
            rows = large.join(sig, "v").select("v", "tree", F.xxhash64("node", F.element_at("sig", (chosen + 1).cast("int"))).alias("node"))
    return ready, large.select("node", "v", "n")


def chunks(large: DataFrame, node_limit: int) -> DataFrame:
    """``(node, v)``: large nodes in chunks by hash; a sixteenth of ``node_limit`` of a node's members is in all of its
    chunks."""
    shared = max(1, node_limit // 16)
    parts = F.ceil(F.col("n") / max(1, node_limit - shared)).cast("long")
    everywhere = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / shared).cast("long")) == 0
    mine = F.pmod(F.xxhash64("v", F.lit(1)), "parts")
    dealt = large.withColumn("parts", parts).withColumn("chunk", F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(mine))))
    return dealt.select(F.xxhash64("node", "chunk").alias("node"), "v")


def class_blocks(members: DataFrame, half: int) -> DataFrame:
    """``(node, v)`` from ``(node, v, root)``: all pairs of blocks of up to about ``half`` members that can hold different
    classes. Classes of that size or more have blocks of their own, which don't meet each other; smaller ones share."""
    members = members.select("node", "v", "root")
    # stored, so that Spark can split a hot class in the join
    sizes = members.groupBy("node", "root").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("n") >= half, F.col("root")).otherwise(-1))
    sizes = stored(sizes, "classes_here")
    kinds = sizes.groupBy("node", "kind").agg(F.ceil(F.sum("n") / half).cast("long").alias("blocks"))
    own = members.join(sizes.select("node", "root", "kind"), ["node", "root"]).join(kinds, ["node", "kind"])
    own = own.select("node", "kind", "v", F.xxhash64("kind", F.pmod(F.xxhash64("v"), "blocks")).alias("mine"))
    others = kinds.select("node", F.col("kind").alias("other_kind"), F.col("blocks").alias("other_blocks"))
    meets = own.join(others, "node").where("kind != other_kind or kind = -1")
    meets = meets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1))).withColumn("other", F.xxhash64("other_kind", "other"))
    return meets.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "v")
