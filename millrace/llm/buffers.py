"""Arrow text columns as NumPy bytes: classes, runs, hashes and exact repeats of all texts of a batch at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed or compared at once; working memory is some 40 times as much.
BLOCK = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the bounds of each; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def groups(bounds: np.ndarray, size: int = 4 * BLOCK):
    """Runs (first, last) of texts of about ``size`` bytes together, longer texts by themselves."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, last
        first = last


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each text are in ``mask``, from prefix sums."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, texts) of the maximal runs of bytes in ``inside``; none goes beyond its text."""
    full = bounds[1:] > bounds[:-1]
    begins, lasts = bounds[:-1][full], bounds[1:][full] - 1
    fresh, final = inside.copy(), inside.copy()
    fresh[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    fresh[begins], final[lasts] = inside[begins], inside[lasts]
    starts = np.flatnonzero(fresh)
    return starts, np.flatnonzero(final) + 1, np.searchsorted(bounds, starts, "right") - 1


def _blocks(lengths: np.ndarray):
    """Consecutive items of at most ``BLOCK`` bytes together, longer ones alone."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
        yield first, last
        first = last


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each span, by differences of prefix sums of a polynomial; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    for lo, hi in _blocks(np.diff(starts, prepend=starts[:1], append=ends[-1:])[1:]):
        begin, end = starts[lo], ends[hi - 1]
        if end - begin > 4 * BLOCK:  # one span that is very long, or has a very long gap behind it
            for i in range(lo, hi):
                out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
            continue
        powers = np.full(end - begin + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum((data[begin:end].astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        powers[1:] = _INVERSE
        powers[0] = 1
        np.cumprod(powers, out=powers)
        out[lo:hi] = (sums[ends[lo:hi] - begin] - sums[starts[lo:hi] - begin]) * powers[starts[lo:hi] - begin]
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)) ^ (out >> np.uint64(32))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` hold the same bytes."""
    same = np.ones(len(a), bool)
    for lo, hi in _blocks(lengths):
        if hi - lo == 1:
            same[lo] = np.array_equal(data[a[lo] : a[lo] + lengths[lo]], data[b[lo] : b[lo] + lengths[lo]])
            continue
        n = lengths[lo:hi]
        at = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(at, n)
        differ = data[np.repeat(a[lo:hi], n) + step] != data[np.repeat(b[lo:hi], n) + step]
        same[lo:hi] = np.add.reduceat(differ, at, dtype=np.int64) == 0 if len(at) else True
    return same


def repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, hashed: np.ndarray | None = None) -> np.ndarray:
    """The number of each span's content: equal spans of a text, and only those, share it; it is the index of one of
    them. Spans aren't empty. Hashes are sorted within their text, and neighbours with equal hashes are compared byte
    by byte; should two contents share a hash, that text's spans are numbered by their bytes."""
    number = np.arange(len(starts))
    if not len(starts):
        return number
    hashed = hashes(data, starts, ends) if hashed is None else hashed
    order = np.lexsort((hashed, texts))
    a, b = order[:-1], order[1:]
    alike = (hashed[a] == hashed[b]) & (texts[a] == texts[b])
    a, b = a[alike], b[alike]
    length = ends - starts
    true = length[a] == length[b]
    true[true] = same_bytes(data, starts[a[true]], starts[b[true]], length[a[true]])
    head = np.ones(len(order), bool)
    head[1:][alike] = False
    number[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    for text in np.unique(texts[a[~true]]):
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(texts == text).tolist():
            number[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), i)
    return number
