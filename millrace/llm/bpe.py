"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut into pre-tokens. Greedy longest match proposes tokens for every distinct pre-token; numpy tests all
adjacent token pairs at once for compatibility; only pre-tokens with an incompatible pair are merged rank by rank.

A pair (a, b) is compatible when no merge across its boundary would have happened before the merges that built a and
b. Along the right edge of a's merge tree stand the parts that ever touched the boundary, each from its creation until
the merge that swallowed it, and likewise along b's left edge. The boundary breaks if parts x and y that face each
other have a merge of a lower rank than the one that swallows x, and no higher than the one that swallows y (of two
equal merges the left one happens first). A token sequence whose adjacent pairs are all compatible is what exact
merging gives.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .storage import named, prepare

# Unicode White_Space, and the pre-token pattern of byte-level BPE vocabularies with contractions.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Places before a space that follows no white space: pre-tokens never cross them.
BOUNDARY = regex.compile(rf"(?<=[^{WHITE}])(?= )")

#: White space before a space.
DOUBLE = tuple(f"{c} " for c in WHITE)

NEVER = np.int64(1 << 40)
NEVER_RANK = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: Latin-1's visible characters stand for themselves, others follow U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cyclic garbage collector, which would walk millions of strings that hold no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def supported(spec: dict) -> None:
    """Raises ValueError for a tokenizers file whose settings this codec doesn't follow, rather than encode otherwise
    than the library."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    told = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "a normalizer": bool(spec.get("normalizer")),
        "a pre-tokenizer other than ByteLevel with its pattern and no prefix space": cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True),
        "a decoder other than ByteLevel": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "dropout": bool(model.get("dropout")),
        "prefixes or suffixes of subwords": bool(model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
        "whole words before merges": bool(model.get("ignore_merges")),
        "added tokens that strip, want whole words or hold white space": any(
            t.get("single_word") or t.get("lstrip") or t.get("rstrip") or set(t["content"]) & set(WHITE) for t in spec.get("added_tokens") or []
        ),
    }
    if found := [k for k, v in told.items() if v]:
        raise ValueError(f"this vocabulary file has {', '.join(found)}, which isn't supported")


class GenerationCache:
    """A mapping bounded to two generations of ``limit`` entries; what is used again moves to the young one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        keys = keys.difference(self.young)
        old = self.old
        if old:
            found = {k: old[k] for k in keys if k in old}
            self.young.update(found)
            keys = keys.difference(found)
        return keys

    def make_room(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


class Codec:
    """Encodes and decodes with the vocabulary and merges of a ``tokenizers`` JSON file of byte-level BPE."""

    def __init__(self, source: str, cache_words: int = 300_000):
        spec = json.loads(source)
        supported(spec)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = raw = to_bytes(token)
                self.ids[raw] = i
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        parts = np.full((size, 2), -1, np.int64)
        born = np.full(size, -1, np.int64)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.ranks[a, b] = rank, whole
            if born[whole] < 0:
                born[whole], parts[whole] = rank, (a, b)
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        self.right_edge = self._edge(parts[:, 1], born)
        self.left_edge = self._edge(parts[:, 0], born)
        # greedy proposals of tokens that merging can't make alone are never right
        self.reachable = {raw for raw, i in self.ids.items() if len(raw) == 1 or born[i] >= 0}
        #: The longest of them by their first two bytes.
        self.longest: dict[bytes, int] = {}
        for raw in self.reachable:
            self.longest[raw[:2]] = max(len(raw), self.longest.get(raw[:2], 1))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {t[0] for t in self.special}
        self.pretoken = regex.compile(PRETOKEN)
        self.words = GenerationCache(cache_words)
        self.units = GenerationCache(cache_words)
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def _edge(child: np.ndarray, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts along one edge of each token's merge tree, outermost first, and the rank that swallows each."""
        part, until = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while (part[-1] >= 0).any():
            inside = part[-1] >= 0
            part.append(np.where(inside, child[part[-1]], -1))
            until.append(np.where(inside, born[part[-2]], -1))
        return np.stack(part[:-1], 1), np.stack(until[:-1], 1)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays as it is under exact merging."""
        (xs, x_until), (ys, y_until) = self.right_edge, self.left_edge
        good = np.ones(len(left), bool)
        for i in range(xs.shape[1]):
            x = xs[left, i]
            if not (x >= 0).any():
                break
            for j in range(ys.shape[1]):
                y = ys[right, j]
                at = np.flatnonzero((x >= 0) & (y >= 0) & good)
                if not len(at):
                    break
                key = x[at] << 32 | y[at]
                k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[k] == key, self.pair_ranks[k], NEVER)
                good[at[(rank < x_until[left[at], i]) & (rank <= y_until[right[at], j])]] = False
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        known, ids, longest, out, at, n = self.reachable, self.ids, self.longest, [], 0, len(word)
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while (piece := word[at:end]) not in known:
                end -= 1
            out.append(ids[piece])
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost first among equals; a heap keeps long words near linear."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n <= 32:
            return self._merge_short(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks = self.ranks
        heap = [(ranks[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := (ids[i], ids[k])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in ranks:
                heapq.heappush(heap, (ranks[p][0], h, p))
        return [t for t in ids if t >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same by the least of a few ranks, which costs less than a heap."""
        ranks, none = self.ranks, (NEVER_RANK, -1)
        open_ = [ranks.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while open_ and (least := min(open_)) is not none:
            i = open_.index(least)
            ids[i : i + 2] = (least[1],)
            del open_[i]
            if i:
                open_[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
            if i < len(open_):
                open_[i] = ranks.get((ids[i], ids[i + 1]), none)
        return ids

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of pre-tokens."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.pack_words(words)]

    def pack_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pre-tokens, as little-endian unsigned 32-bit integers: proposed for all, verified for all at once, merged exactly where that fails."""
        proposed = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for ts in proposed for t in ts), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        left, right, owner = flat[:-1][inside], flat[1:][inside], owner[1:][inside]
        keys, back = np.unique(left << 32 | right, return_inverse=True)
        good = self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]
        packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.unique(owner[~good]).tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out

    def _encode_unit(self, unit: str) -> list[bytes | int]:
        """Pre-tokens of a unit, and ids of special tokens in it."""
        bare = unit[1:]
        if bare.isalpha() and bare.isascii() and unit[0] == " ":
            return [unit.encode()]
        segments = self.split_special.split(unit) if self.split_special and any(m in unit for m in self.marks) else [unit]
        out: list = []
        for s in segments:
            if s in self.special:
                out.append(self.special[s])
            else:
                out += [w.encode() for w in self.pretoken.findall(s)]
        return out

    def _learn(self, units: set[str]) -> None:
        """Puts the ids of new units into the cache, as little-endian unsigned 32-bit integers."""
        cut = {u: self._encode_unit(u) for u in units}
        new = sorted(self.words.missing({w for parts in cut.values() for w in parts if isinstance(w, bytes)}))
        known = self.words.young
        known.update(zip(new, self.pack_words(new), strict=True))
        pack = lambda w: known[w] if isinstance(w, bytes) else w.to_bytes(4, "little")
        self.units.young.update((u, b"".join(map(pack, parts))) for u, parts in cut.items())

    def _cut(self, text: str) -> list[str]:
        """Units that encode independently: text is cut before each space that follows no white space."""
        if any(c in text for c in DOUBLE):
            return BOUNDARY.split(text)
        first, *rest = text.split(" ")
        return [first, *(" " + r for r in rest)]

    def encode_batch(self, texts: Iterable[str], chunk_chars: int = 2_000_000) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(self._cut(text))
            held += len(text)
            if held >= chunk_chars:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, cut: list[list[str]]) -> list[bytes]:
        with uncollected():
            self.units.make_room()
            self.words.make_room()
            if new := self.units.missing(set().union(*cut)):
                self._learn(new)
            get = self.units.young.__getitem__
            return [b"".join(map(get, units)) for units in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; a text's own bytes if they came from ``encode_batch``."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_codecs: dict[bytes, Codec] = {}


def codec(source: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = hashlib.sha256(source.encode()).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source)
    return _codecs[key]


def vocabulary(spark, path: str):
    """The vocabulary file, read on the driver and broadcast: a few MB, whatever the corpus."""
    prepare(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, ids binary, n_tokens long)``: ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; null and repeated ids of rows pass through; other columns are left
    out. Equals the ``tokenizers`` library with ``add_special_tokens=False``, special tokens in the text included.
    """
    source = vocabulary(df.sparkSession, tokenizer_path)

    def run(batches):
        c = codec(source.value)
        for b in batches:
            out = list(c.encode_batch(strings(b.column(1))))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())], names=[id_col, "ids", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long")


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows ``(id, text)``; null ids give an empty text, invalid UTF-8 becomes U+FFFD."""
    source = vocabulary(df.sparkSession, tokenizer_path)

    def run(batches):
        c = codec(source.value)
        for b in batches:
            out = [c.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(named(id_col).alias("id"), named(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digest(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the token count, the SHA-256 of its ids and the SHA-256 of the text decoded from those ids.

    Fused into one pass so that ids never leave the worker; a null text counts as empty.
    """
    source = vocabulary(df.sparkSession, tokenizer_path)

    def run(batches):
        c = codec(source.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in c.encode_batch(strings(b.column(1))):
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids))
                text_sha.append(sha(c.decode(np.frombuffer(ids, "<u4")).decode("utf-8", "replace").encode()))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
