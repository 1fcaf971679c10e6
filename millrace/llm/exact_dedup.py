"""Exact deduplication: Patricia tries own the distinct texts.

Every task that reads documents inserts the normalised texts into a compressed radix trie, so of equal texts in one
task only one travels. The distinct texts then go, by length and content hash, to owner tasks, whose tries compare
full byte strings; a terminal node holds the smallest identifier and the number of rows. A hot text reaches its owner
at most once from each reading task. Rows learn their owner by a join on the terminal they met first, which no group
can make uneven.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import named, prepare, stored, whole_row, without

#: Characters that normalisation deletes.
SPACE = b" \t\n\x0b\x0c\r"


#: Owner tasks at most: what the driver of one shuffle can well keep. Beyond, a task owns more text and spills.
MOST_TASKS = 20_000


class Node:
    __slots__ = ("children", "high", "low", "source", "value")

    def __init__(self, source: bytes, low: int, high: int):
        self.source, self.low, self.high, self.children, self.value = source, low, high, None, None


def shared(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], at most ``most``: doubling, then halving."""
    done, step = 0, 64
    while step and done < most:
        n = min(step, most - done)
        if a[i + done : i + done + n] == b[j + done : j + done + n]:
            done += n
            step *= 2
        elif n == 1:
            break
        else:
            most = done + n
            step = n // 2
    return done


class Patricia:
    """A compressed radix trie over byte strings. Edges are slices of the strings that were inserted."""

    def __init__(self):
        self.root, self.bytes = Node(b"", 0, 0), 0

    def terminal(self, key: bytes) -> Node:
        """The terminal node of ``key``, with value None if it is new."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            children = node.children
            child = children.get(key[at]) if children else None
            if child is None:
                if children is None:
                    node.children = children = {}
                children[key[at]] = leaf = Node(key, at, n)
                self.bytes += n + 400
                return leaf
            length = child.high - child.low
            same = shared(child.source, child.low, key, at, min(length, n - at))
            if same < length:
                upper = Node(child.source, child.low, child.low + same)
                child.low += same
                upper.children = {child.source[child.low]: child}
                node.children[key[at]] = child = upper
            at += same
            node = child
        return node

    def largest(self) -> bytes | None:
        """The prefix of the largest subtree, by terminals, below the first node with several children; None if no
        node has."""
        node = self.root
        while node.children and len(node.children) == 1:
            node = next(iter(node.children.values()))
        if not node.children:
            return None
        low = max(node.children, key=lambda b: sum(1 for _ in walk(node.children[b])))
        return node.source[: node.high] + bytes([low])

    def take(self, prefix: bytes | int) -> Iterator[tuple[bytes, object]]:
        """Removes the subtree of a child's prefix, as ``largest`` gives it, or of a first byte, and yields its strings
        and values."""
        node, prefix = self.root, bytes([prefix]) if isinstance(prefix, int) else prefix
        while node.high < len(prefix) - 1:
            node = node.children[prefix[node.high]]
        for node in walk(node.children.pop(prefix[-1])):
            self.bytes -= node.high + 400
            yield node.source[: node.high], node.value

    def drain(self) -> Iterator[tuple[bytes, object]]:
        for node in walk(self.root):
            yield node.source[: node.high], node.value


def walk(node: Node) -> Iterator[Node]:
    """Terminal nodes of a subtree. A node's string is its source up to its end: all edges above share that prefix."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node.value is not None:
            yield node
        if node.children:
            stack.extend(node.children.values())


def better(a: tuple, b: tuple) -> tuple:
    """Of two rows (code points, id, row number) the one that stays: more code points, then the smaller id (null
    last), then the earlier row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return min(a, b, key=rank)


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``df``: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after white space is deleted; null counts as empty, and empty texts are equal.
    Of equal texts the row with the most code points stays, then the smallest id (null ids last), then the earlier
    of rows with the same id, so exactly one row of a group is kept, also among repeated rows. Other columns are left
    out. An empty table gives an empty result. ``limits`` are those of ``resolve``.
    """
    met, owners = resolve(df.select(named(id_col), named(text_col)), id_col, text_col, False, **limits)
    rows = met.where(F.col("rid").isNotNull()).select("id", "rid", "rep", "text_sha256")
    return rows.join(owners, "rep").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, by the rules of ``mark``."""
    met, owners = resolve(df, id_col, text_col, True, **limits)
    rows = met.where(F.col("rid").isNotNull())
    dropped = stored(rows.select("rid", "rep").join(owners, "rep").where("rid != keep_rid").select("rid"), "dropped")
    return without(rows.select("rid", "row"), dropped, "rid").select("row.*")


def resolve(df: DataFrame, id_col: str, text_col: str, carry: bool, trie_bytes: int = 192 << 20, task_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """(what reading tasks met, owners). The first holds a row for each row of ``df`` (``id, rid, rep, text_sha256``,
    and with ``carry`` the ``row`` itself) and one for each distinct text of a task, whose ``rid`` is null; the second
    maps ``rep`` to ``keep_id, keep_rid, group_size``.

    A trie over ``trie_bytes`` gives up its largest subtree: a reading task passes it on early, an owner task sets it
    aside in a temporary file of its own and comes back to it, where it may be parted again by its longer prefixes, so
    a lost executor only repeats the task. Owner tasks get about ``task_bytes`` of text each, and more only where
    there would be over ``MOST_TASKS`` of them.
    """
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = T._parse_datatype_string(f"id {kind}, rid long, rep long, text_sha256 string, text binary, size long, rows long, owner_chars long, owner_id {kind}, owner_rid long")
    if carry:
        schema = T.StructType([*schema, T.StructField("row", df.schema)])

    def read(batches):
        part, rows, trie = TaskContext.get().partitionId(), 0, Patricia()
        id_type = row_type = None

        def out(docs=(), texts=(), row=None):
            """docs: (id, rid, rep, sha) and their rows; texts: (text, (rep, count, owner))."""
            docs, texts = list(docs), list(texts)
            d, t = [None] * len(docs), [None] * len(texts)
            column = pa.array
            return pa.record_batch(
                [
                    column([x[0] for x in docs] + t, id_type),
                    column([x[1] for x in docs] + t, pa.int64()),
                    column([x[2] for x in docs] + [v[0] for _, v in texts], pa.int64()),
                    column([x[3] for x in docs] + t, pa.string()),
                    column(d + [k for k, _ in texts], pa.binary()),
                    column(d + [len(k) for k, _ in texts], pa.int64()),
                    column(d + [v[1] for _, v in texts], pa.int64()),
                    column(d + [v[2][0] for _, v in texts], pa.int64()),
                    column(d + [v[2][1] for _, v in texts], id_type),
                    column(d + [v[2][2] for _, v in texts], pa.int64()),
                    *([row if row is not None else pa.nulls(len(texts), row_type)] if carry else []),
                ],
                names=[f.name for f in schema],
            )

        def portions(entries, most=8 << 20):
            held, size = [], 0
            for e in entries:
                held.append(e)
                size += len(e[0])
                if size >= most:
                    yield out(texts=held)
                    held, size = [], 0
            if held:
                yield out(texts=held)

        for b in batches:
            id_type, row_type, docs = b.column(0).type, b.column(2).type if carry else None, []
            chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
            for i, raw, n in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), chars, strict=True):
                key = (raw or b"").translate(None, SPACE)
                rid = part << 33 | rows
                rows += 1
                node = trie.terminal(key)
                if node.value is None:
                    node.value = [rid, 1, (n, i, rid)]
                else:
                    node.value[1] += 1
                    node.value[2] = better(node.value[2], (n, i, rid))
                docs.append((i, rid, node.value[0], hashlib.sha256(key).hexdigest()))
                while trie.bytes > trie_bytes and (prefix := trie.largest()) is not None:
                    yield from portions(trie.take(prefix))
            yield out(docs=docs, row=b.column(2) if carry else None)
        if rows:
            yield from portions(trie.drain())

    def own(batches):
        id_type = None

        def insert(trie, key, reps, count, owner):
            node = trie.terminal(key)
            if node.value is None:
                node.value = [list(reps), count, owner]
            else:
                node.value[0] += reps
                node.value[1] += count
                node.value[2] = better(node.value[2], owner)

        def out(entries):
            flat = [(rep, v[2][1], v[2][2], v[1]) for _, v in entries for rep in v[0]]
            for at in range(0, len(flat), 50_000):
                rows = flat[at : at + 50_000]
                yield pa.record_batch(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                    names=["rep", "keep_id", "keep_rid", "group_size"],
                )

        def received():
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("owner_id").type
                for rep, key, count, chars, i, rid in zip(*(b.column(k).to_pylist() for k in ("rep", "text", "rows", "owner_chars", "owner_id", "owner_rid")), strict=True):
                    yield key, [rep], count, (chars, i, rid)

        def again(file):
            file.seek(0)
            with file:
                while True:
                    try:
                        yield pickle.load(file)
                    except EOFError:
                        return

        waiting = [received()]
        while waiting:
            trie, aside = Patricia(), {}
            lengths: list[int] = []
            for key, *entry in waiting.pop():
                # of several prefixes the longest: it was set aside first
                if file := next((aside[p] for n in lengths if (p := key[:n]) in aside), None):
                    pickle.dump((key, *entry), file)
                    continue
                insert(trie, key, *entry)
                while trie.bytes > trie_bytes and (prefix := trie.largest()) is not None:
                    file = aside[prefix] = tempfile.TemporaryFile()  # noqa: SIM115  of this task alone; gone when it ends
                    lengths = sorted({*map(len, aside)}, reverse=True)
                    for k, v in trie.take(prefix):
                        pickle.dump((k, *v), file)
            yield from out(trie.drain())
            waiting += map(again, aside.values())

    met = stored(
        df.select(named(id_col), named(text_col), *([whole_row(df)] if carry else [])).toDF(*["id", "text", "row"][: 2 + carry]).mapInArrow(read, schema),
        "exact",
    )
    texts = met.where(F.col("rid").isNull())
    spark = df.sparkSession
    total = texts.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-total // task_bytes)))
    owners = (
        texts.repartition(tasks, "size", F.xxhash64("text"))
        .select("rep", "text", "rows", "owner_chars", "owner_id", "owner_rid")
        .mapInArrow(own, f"rep long, keep_id {kind}, keep_rid long, group_size long")
    )
    return met, owners
