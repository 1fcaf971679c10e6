"""Bounded-space online packing of token sequences into fixed windows.

Every task keeps at most ``open_windows`` windows. A document's pieces go to the open window that they fill best; if
none has room, the fullest open window is emitted and a new one opened. The windows still open at a task's end are
merged with those of neighbouring tasks.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BOUNDARY, PRETOKEN, Codec, byte_alphabet, strings, vocabulary
from .storage import named, stored

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids by tiktoken, about twice as fast as other ways to the same ids, with the vocabulary of a tokenizers file.

    tiktoken merges in the order of ids, so a file whose merges have another order goes to ``Codec``, as does a
    stretch of over ``longest`` characters without a boundary, on which tiktoken's regex can overflow its stack.
    """

    def __init__(self, source: str, longest: int = 200_000):
        self.source, self.longest, self.exact = source, longest, None
        spec = json.loads(source)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ids = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        joined = lambda m: m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)
        merged = [spec["model"]["vocab"][joined(m)] for m in spec["model"]["merges"]]
        in_order = all(a < b for a, b in zip(merged, merged[1:], strict=False)) and max(ids[bytes([b])] for b in range(256)) < min(merged, default=1 << 32)
        self.fast = tiktoken.Encoding("merges", pat_str=PRETOKEN, mergeable_ranks=ids, special_tokens=self.special) if in_order else None

    def _exactly(self, text: str) -> bytes:
        self.exact = self.exact or Codec(self.source)
        return b"".join(self.exact.encode_batch([text]))

    def _one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.fast.encode(text, allowed_special="all"), "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.fast and len(text) <= self.longest:
            return self._one(text)
        out, units, held = [], [], 0
        for unit in [*BOUNDARY.split(text), None]:
            if unit is None or held + len(unit) > self.longest:
                block = "".join(units)
                out.append(self._one(block) if self.fast and len(block) <= self.longest else self._exactly(block))
                units, held = [], 0
            if unit is not None:
                units.append(unit)
                held += len(unit)
        return b"".join(out)


class OpenWindows:
    """At most ``limit`` windows of ``size`` tokens; ``add`` yields the windows that leave."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free: list[tuple[int, int]] = []  # (room, number), sorted
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def room(self) -> int:
        """Room of the fullest window if another would have to leave, else none."""
        return self.free[0][0] if len(self.free) >= self.limit else 0

    def best(self, length: int) -> int | None:
        k = bisect.bisect_left(self.free, (length, -1))
        return k if k < len(self.free) else None

    def put(self, k: int, piece: tuple, length: int) -> Iterator[list[tuple]]:
        room, number = self.free.pop(k)
        self.held[number].append(piece)
        if room > length:
            bisect.insort(self.free, (room - length, number))
        else:
            yield self.held.pop(number)

    def emit_fullest(self) -> list[tuple]:
        return self.held.pop(self.free.pop(0)[1])

    def open(self) -> int:
        number, self.opened = self.opened, self.opened + 1
        self.held[number] = []
        bisect.insort(self.free, (self.size, number))
        return self.free.index((self.size, number))

    def add(self, piece: tuple, length: int) -> Iterator[list[tuple]]:
        k = self.best(length)
        if k is None:
            if len(self.free) >= self.limit:
                yield self.emit_fullest()
            k = self.open()
        yield from self.put(k, piece, length)


def cut(length: int, window: int, gap: int, windows: OpenWindows) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows first; then, if the rest fits no open window and the
    fullest would leave with a gap over ``gap``, a piece that closes that gap."""
    at = 0
    while length - at >= window:
        yield at, window
        at += window
    rest = length - at
    if rest and windows.best(rest) is None and gap < windows.room() < rest:
        yield at, (head := windows.room())
        at, rest = at + head, rest - head
    if rest:
        yield at, rest


def pack_ids(
    batches: Iterable[tuple[list, Iterable[bytes]]], window: int, open_windows: int, gap: int
) -> Iterator[tuple[list[tuple], bool]]:
    """Windows as (pieces, still open): pieces are (id, start, length, crc, document's tokens)."""
    state = OpenWindows(window, open_windows)
    for ids, encoded in batches:
        for doc, raw in zip(ids, encoded, strict=True):
            total = len(raw) // 4
            for start, length in cut(total, window, gap, state):
                piece = (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total)
                if length == window:
                    yield [piece], False
                else:
                    for w in state.add(piece, length):
                        yield w, False
    for w in state.held.values():
        yield w, True


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def pack(
    df: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    open_windows: int = 64,
    gap: int = 32,
    end_id: int = 1,
    merge_tasks: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document and its place in a sequence of at most ``window`` tokens.

    A document is its ids followed by ``end_id``; a null or empty text is that id alone, so every row has a piece.
    Rows with equal or null ids are packed as rows of their own. Other columns are left out. ``gap`` is the most
    padding with which a window is emitted while documents still arrive; a document is cut only where it is longer
    than a window or closes a larger gap. The windows that ``merge_tasks`` tasks leave open are merged whole, best
    fit first; only what is then left can hold more padding. An empty table gives an empty result.

    ``sequence_id`` is a task's number and 24 bits for its windows (16 million, some 34 billion tokens, in one input
    partition); windows that were merged have bit 52 set, so up to 2^28 tasks have numbers of their own.
    """
    source = vocabulary(df.sparkSession, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "open"]

    def run(batches):
        c = encoder(source.value)
        part, number, rows = TaskContext.get().partitionId(), 0, []
        types = [None, *[pa.int64()] * 7, pa.bool_()]

        def encoded():
            for b in batches:
                types[0] = b.column(0).type
                yield b.column(0).to_pylist(), (c.encode(t) + end for t in strings(b.column(1)))

        for pieces, still_open in pack_ids(encoded(), window, open_windows, gap):
            offset = 0
            for doc, start, length, crc, total in pieces:
                rows.append((doc, start, length, crc, total, part << 24 | number, offset, part, still_open))
                offset += length
            number += 1
            if len(rows) >= 20_000:
                yield _arrow(rows, names, types)
                rows = []
        if rows:
            yield _arrow(rows, names, types)

    placed = stored(
        df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, {PIECE}, part long, open boolean"),
        "packed",
    )
    closed = placed.where(~F.col("open")).select(*names[:7])
    merged = merge_windows(placed.where("open"), window, merge_tasks, kind)
    return closed.unionByName(merged).select(F.col("id").alias(id_col), *names[1:7])


def merge_windows(left: DataFrame, window: int, tasks: int, kind: str) -> DataFrame:
    """Merges whole windows that stayed open, best fit decreasing, among each ``tasks`` neighbouring tasks."""

    def run(key, pdf):
        base = 1 << 52 | int(key[0]) << 24
        groups = [g for _, g in pdf.sort_values(["sequence_id", "offset"], kind="stable").groupby("sequence_id", sort=True)]
        sizes = [int(g["length"].sum()) for g in groups]
        free: list[tuple[int, int]] = []
        filled: list[list[int]] = []
        for i in sorted(range(len(groups)), key=lambda i: (-sizes[i], i)):
            k = bisect.bisect_left(free, (sizes[i], -1))
            if k == len(free):
                filled.append([i])
                bisect.insort(free, (window - sizes[i], len(filled) - 1))
            else:
                room, w = free.pop(k)
                filled[w].append(i)
                bisect.insort(free, (room - sizes[i], w))
        out = pdf.iloc[:0].copy()
        parts = []
        for w, members in enumerate(filled):
            at = 0
            for i in members:
                g = groups[i].copy()
                g["offset"] += at
                g["sequence_id"] = base | w
                at += sizes[i]
                parts.append(g)
        return (pd.concat(parts) if parts else out)[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    grouped = left.withColumn("near", (F.col("part") / tasks).cast("long")).groupBy("near")
    return grouped.applyInPandas(run, f"id {kind}, {PIECE}")


_encoders: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    if (key := hash(source)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source)
    return _encoders[key]
