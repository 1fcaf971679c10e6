"""Quality rules: counts of words, symbols and repeats, and the perplexity of a modified Kneser-Ney model.

The model has the characters of each language in n-grams of five. Spark counts them over all documents and computes
discounts, back-off weights and probabilities as joins and windows; n-grams of a single document are left to the back-off,
so that no document vouches for itself. For scoring, the model lies in sorted arrays of hashes, and a document's
perplexity must lie between the fences of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buffers
from .storage import BROADCAST_KEYS, join_weighted, named, prepare, small, stored

#: Characters of an n-gram.
ORDER = 5
#: Stands before a text.
PAD = "\x00"
#: Entries up to which a model is broadcast: 16 bytes each. Beyond it n-grams are joined.
MODEL_ENTRIES = 4_000_000
#: Fences lie so many interquartile ranges below and above the quartiles, a range being at least so many nats. Rare words
#: and names raise the perplexity of good texts, while nothing but repetition lowers it, so the upper fence is farther.
BELOW, ABOVE, LEAST_RANGE = 3.0, 6.0, 0.05
#: Steps of the histogram from which quartiles are read, in nats.
STEP = 0.001

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# -- counts of a text


def rule_counts(data: np.ndarray, bounds: np.ndarray, symbols: str) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text."""
    texts_n = len(bounds) - 1
    inside = ~buffers.BLANK[data]
    starts, ends, texts = buffers.runs(inside, bounds)
    marked = np.zeros(256, bool)
    marked[list(symbols.encode("ascii"))] = True
    lines, line_ends, line_texts = buffers.runs(data != ord("\n"), bounds)
    worded = np.searchsorted(starts, lines) < np.searchsorted(starts, line_ends)
    lines, line_ends, line_texts = lines[worded], line_ends[worded], line_texts[worded]
    again = buffers.repeats(data, lines, line_ends, line_texts)
    # windows of three words by the numbers of their words, exactly
    covered = np.zeros(len(starts) + 2, bool)
    if len(starts) > 2:
        word = buffers.repeats(data, starts, ends, texts).astype(np.int64)
        pair = pd.factorize((word[:-1] << 32) | word[1:])[0]
        of = pd.factorize((pair[:-1] << 32) | word[2:])[0]
        within = texts[:-2] == texts[2:]
        # word numbers differ between texts, so no window of one text equals one of another
        at = np.flatnonzero(within & (np.bincount(of)[of] > 1))
        for k in range(3):
            covered[at + k] = True
    # the first line with a content has the smallest start, whichever of them names the content
    return {
        "n_words": np.bincount(texts, minlength=texts_n),
        "word_chars": buffers.per_text(inside & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": buffers.per_text(marked[data], bounds),
        "n_dup_lines": np.bincount(line_texts, minlength=texts_n) - np.bincount(line_texts[again == np.arange(len(lines))], minlength=texts_n),
        "n_repeat_words": np.bincount(texts[covered[: len(starts)]], minlength=texts_n),
    }


# -- characters and their n-grams

#: Characters that are hashed at once; longer texts are blocks of their own.
BLOCK = 1 << 20


def normal(text: str) -> str:
    """What the model reads of a text: lower case, digits as 0, runs of white space as one blank."""
    text = text.lower().replace(PAD, " ")
    for digit in "123456789":
        text = text.replace(digit, "0")
    return " ".join(text.split())


@dataclass
class Grams:
    """The distinct n-grams of some texts of one language: characters, where each n-gram first ends, which n-gram each
    character of the texts ends, and the text of each character."""

    lang: str
    rows: np.ndarray
    joined: str
    codes: np.ndarray
    ends: np.ndarray
    gram: np.ndarray
    text: np.ndarray
    lengths: np.ndarray


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, where each number first is)."""
    number, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[number[::-1]] = np.arange(len(values) - 1, -1, -1)
    return number, first


def grams_of(langs: list[str], texts: list[str]) -> Iterator[Grams]:
    """All texts by language, in blocks. Texts without characters aren't in any."""
    lead = PAD * (ORDER - 1)
    waiting: dict[str, list[tuple[int, str]]] = {}
    sizes: dict[str, int] = {}

    def block(lang: str) -> Grams:
        rows, parts = zip(*waiting.pop(lang), strict=True)
        sizes.pop(lang)
        joined = lead + lead.join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.flatnonzero(codes)
        hashed = windows_hash(codes, language_seed(lang))[ends - ORDER + 1]
        gram, first = distinct(hashed)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return Grams(lang, np.array(rows), joined, codes, ends[first], gram, np.repeat(np.arange(len(parts)), lengths), lengths)

    for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        if text := normal(text):
            if sizes.get(lang, 0) + len(text) > BLOCK and lang in waiting:
                yield block(lang)
            waiting.setdefault(lang, []).append((i, text))
            sizes[lang] = sizes.get(lang, 0) + len(text)
    for lang in list(waiting):
        yield block(lang)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def language_seed(lang: str) -> np.uint64:
    h = 0xCBF29CE484222325
    for b in lang.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return np.uint64(h)


def spans_hash(codes: np.ndarray, ends: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    """The hash of the ``length`` characters up to and with each end."""
    h = np.full(len(ends), (int(seed) + length) % (1 << 64), np.uint64)
    for k in range(length):
        h += (codes[ends - k] + np.uint64(1)) * _FACTORS[k]
    return mixed(h)


def windows_hash(codes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """``spans_hash`` of ``ORDER`` characters for every end there is."""
    n = len(codes) - ORDER + 1
    h = np.full(n, (int(seed) + ORDER) % (1 << 64), np.uint64)
    for k in range(ORDER):
        h += (codes[ORDER - 1 - k : ORDER - 1 - k + n] + np.uint64(1)) * _FACTORS[k]
    return mixed(h)


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") if b else "" for b in column.cast(pa.large_binary()).to_pylist()]


# -- the model, by Spark


def counted(docs: DataFrame) -> DataFrame:
    """``lang, gram, n, docs``: all n-grams of ``lang, text``, how often and in how many documents they are."""

    def count(batches):
        for b in batches:
            for g in grams_of(b.column(0).to_pylist(), _texts(b.column(1))):
                n = np.bincount(g.gram, minlength=len(g.ends))
                holders = np.bincount(pd.unique(g.gram * len(g.rows) + g.text) // len(g.rows), minlength=len(g.ends))
                grams = pa.array([g.joined[e - ORDER + 1 : e + 1] for e in g.ends.tolist()])
                lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([g.lang])).cast(pa.string())
                yield pa.record_batch([lang, grams, pa.array(n), pa.array(holders)], names=["lang", "gram", "n", "docs"])

    return docs.mapInArrow(count, "lang string, gram string, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3`` from the counts of counts; the usual 0.5, 1 and 1.5 where those are too few."""
    n1, n2, n3, n4 = (F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4))
    y = "n1 / (n1 + 2 * n2)"

    def discount(k: int) -> Column:
        value = F.expr(f"try_divide(({k + 1}) * ({y}) * n{k + 1}, n{k})")
        value = k - value
        return F.when((value > 0) & (value < k), value).otherwise(k / 2).alias(f"d{k}")

    return level.groupBy("lang").agg(n1, n2, n3, n4).withColumn("n1", F.when(F.col("n1") > 0, F.col("n1"))).select("lang", discount(1), discount(2), discount(3))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_KEYS) else df


def train(docs: DataFrame) -> DataFrame:
    """The stored model of ``lang, text``: ``lang, gram, p, back`` for n-grams of 1 to ``ORDER`` characters. ``p`` is
    what is left of an n-gram's probability after its discount, ``back`` what its continuations leave to the shorter
    ones; unigrams back off to all characters of the language alike, which '' carries."""
    level = stored(counted(docs), "grams")
    entries = []
    for k in range(ORDER, 0, -1):
        discounted = level.join(_bounded(_discounts(level)), "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.substring("gram", 1, k - 1)
        # a context has no more continuations than the language has characters
        whole = F.sum("n").over(Window.partitionBy("lang", "context")).alias("whole")
        kept = discounted.withColumn("context", context).select("*", discount.alias("discount"), whole)
        kept = (kept.where("docs > 1") if k > 1 else kept).withColumn("p", (F.col("n") - F.col("discount")) / F.col("whole"))
        # integers are summed and discounts counted, so that the order of rows doesn't matter
        taken = [F.count(F.when(c, 1)) * F.max(f"d{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
        left_over = (F.max("whole") - F.sum("n") + taken[0] + taken[1] + taken[2]) / F.max("whole")
        backs = kept.groupBy("lang", F.col("context").alias("gram")).agg(F.lit(0.0).alias("p"), left_over.alias("back"))
        if k == 1:  # the floor of the back-off: an equal share for each character, and one more for all others
            backs = level.groupBy("lang").agg(F.count("*").alias("v")).join(backs, "lang").select("lang", "gram", (1 / (F.col("v") + 1)).alias("p"), "back")
        entries += [kept.select("lang", "gram", "p", F.lit(None).cast("double").alias("back")), backs]
        if k > 1:
            shorter = level.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram"))
            level = stored(shorter.agg(F.count("*").alias("n"), F.sum("docs").alias("docs")), f"grams_of_{k - 1}")
    model = entries[0]
    for e in entries[1:]:
        model = model.unionByName(e)
    return stored(model.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.coalesce(F.max("back"), F.lit(1.0)).alias("back")), "model")


@dataclass
class HashArrays:
    """The model as arrays sorted by the hash of language and n-gram."""

    keys: np.ndarray
    p: np.ndarray
    back: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p, back) of each hash, 0 and 1 of those that aren't there. Sorted hashes are found in neighbouring memory."""
        order = np.argsort(wanted)
        at = np.empty(len(wanted), np.int64)
        at[order] = np.searchsorted(self.keys, wanted[order])
        at = np.minimum(at, len(self.keys) - 1)
        there = self.keys[at] == wanted
        return np.where(there, self.p[at], 0.0), np.where(there, self.back[at], 1.0)

    def p_after(self, codes: np.ndarray, ends: np.ndarray, seed: np.uint64, k: int = ORDER) -> np.ndarray:
        """The probability of each end's character after the ``k - 1`` before it. Every order looks up its distinct
        n-grams and contexts only."""
        if k == 0:
            base = self.find(np.array([empty_hash(seed)]))[0]
            return np.full(len(ends), base[0] if base[0] > 0 else 1e-6)  # else a language that the model doesn't know
        hashed = spans_hash(codes, ends, k, seed)
        number, first = distinct(hashed)
        ends = ends[first]
        context, context_first = distinct(spans_hash(codes, ends - 1, k - 1, seed))
        back = self.find(spans_hash(codes, ends[context_first] - 1, k - 1, seed))[1][context]
        return (self.find(hashed[first])[0] + back * self.p_after(codes, ends, seed, k - 1))[number]


def empty_hash(seed: np.uint64) -> np.uint64:
    return spans_hash(np.zeros(1, np.uint64), np.zeros(1, np.int64), 0, seed)[0]


def hash_arrays(model: DataFrame) -> HashArrays:
    """A model of at most ``MODEL_ENTRIES`` rows, hashed in tasks, sorted, and brought to the driver for broadcasting."""

    def hash_(batches):
        for b in batches:
            grams = [x or "" for x in b.column(1).to_pylist()]
            langs = b.column(0).to_pandas()
            number, names = pd.factorize(langs)
            keys, size = np.zeros(len(grams), np.uint64), np.fromiter(map(len, grams), np.int64, len(grams))
            for lang, k in sorted(set(zip(number.tolist(), size.tolist(), strict=True))):
                at = np.flatnonzero((size == k) & (number == lang))
                codes = np.frombuffer("".join(grams[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                keys[at] = spans_hash(codes, np.arange(1, len(at) + 1) * k - 1, k, language_seed(names[lang]))
            yield pa.record_batch([pa.array(keys.view(np.int64)), b.column(2).cast(pa.float32()), b.column(3).cast(pa.float32())], names=["key", "p", "back"])

    found = model.select("lang", "gram", "p", "back").mapInArrow(hash_, "key long, p float, back float").toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return HashArrays(keys[order], found.column("p").to_numpy()[order], found.column("back").to_numpy()[order])


# -- scoring


def _resolved(grams: DataFrame, model: DataFrame) -> DataFrame:
    """``lang, gram, log_p`` of distinct n-grams, order by order: each needs its own entry, that of its context, and the
    probability of the shorter n-gram, which no more others need than the language has characters."""
    levels = [grams.select("lang", "gram")]
    for k in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].select("lang", F.substring("gram", 2, k).alias("gram")).distinct())
    floor = model.where("gram = ''").select("lang", F.col("p").alias("value"), F.col("back").alias("back0"))
    floor = _bounded(floor)
    value = None
    for k in range(1, ORDER + 1):
        level, entries = levels[ORDER - k], model.where(F.char_length("gram") == k).select("lang", "gram", "p")
        level = level.join(entries, ["lang", "gram"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        if k == 1:
            level = level.join(floor, "lang", "left").select("lang", "gram", (F.col("p") + F.coalesce("back0", F.lit(1.0)) * F.coalesce("value", F.lit(1e-6))).alias("value"))
        else:
            backs = model.where(F.char_length("gram") == k - 1).select("lang", F.col("gram").alias("context"), "back")
            level = level.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("suffix", F.substring("gram", 2, k - 1))
            level = level.join(backs, ["lang", "context"], "left").join(value.select("lang", F.col("gram").alias("suffix"), F.col("value").alias("shorter")), ["lang", "suffix"])
            level = level.select("lang", "gram", (F.col("p") + F.coalesce("back", F.lit(1.0)) * F.col("shorter")).alias("value"))
        value = level
    return value.select("lang", "gram", F.log(F.greatest("value", F.lit(1e-30))).alias("log_p"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(df: DataFrame, model: DataFrame, symbols: str, most_entries: int = MODEL_ENTRIES) -> DataFrame:
    """``id, lang``, the counts and ``log_perplexity`` of ``id, lang, text``; null for texts without characters."""
    spark = df.sparkSession
    broadcast = spark.sparkContext.broadcast(hash_arrays(model)) if small(model, most_entries) else None
    kind = df.schema["id"].dataType.simpleString()
    if broadcast is None:
        df = _numbered(df)

    def measure(batches):
        for b in batches:
            data, bounds = buffers.text_bytes(b.column(2))
            found = {c: [np.zeros(0, np.int64)] for c in COUNTS}
            for lo, hi in buffers.groups(bounds):
                begin = bounds[lo]
                for c, v in rule_counts(data[begin : bounds[hi]], bounds[lo : hi + 1] - begin, symbols).items():
                    found[c].append(v.astype(np.int64))
            columns = [pa.array(np.concatenate(found[c])) for c in COUNTS]
            if broadcast is not None:
                value = np.full(b.num_rows, np.nan)
                for g in grams_of(b.column(1).to_pylist(), _texts(b.column(2))):
                    p = broadcast.value.p_after(g.codes, g.ends, language_seed(g.lang))
                    value[g.rows] = -np.bincount(g.text, np.log(np.maximum(p, 1e-30))[g.gram]) / g.lengths
                last = pa.array(value, from_pandas=True)
            else:
                last = b.column(3)
            yield pa.record_batch([b.column(0), b.column(1), *columns, last], names=["id", "lang", *COUNTS, "last"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    if broadcast is not None:
        return df.select("id", "lang", "text").mapInArrow(measure, f"id {kind}, lang string, {counts}, last double").withColumnRenamed("last", "log_perplexity")

    def occurrences(batches):
        for b in batches:
            rids = b.column(0).to_numpy()
            for g in grams_of(b.column(1).to_pylist(), _texts(b.column(2))):
                pairs, first = distinct(g.gram * len(g.rows) + g.text)
                n, ends, text = np.bincount(pairs), g.ends[g.gram[first]].tolist(), g.text[first]
                grams = pa.array([g.joined[e - ORDER + 1 : e + 1] for e in ends])
                yield pa.record_batch([pa.array(rids[g.rows[text]]), pa.array([g.lang] * len(n)), grams, pa.array(n)], names=["rid", "lang", "gram", "n"])

    wanted = stored(df.select("rid", "lang", "text").mapInArrow(occurrences, "rid long, lang string, gram string, n long"), "wanted")
    values = stored(_resolved(wanted.groupBy("lang", "gram").agg(F.count("*").alias("rows")), model), "values")
    weighted = values.join(wanted.groupBy("lang", "gram").agg(F.count("*").alias("rows")), ["lang", "gram"])
    scores = join_weighted(wanted, weighted, ["lang", "gram"], "rows", F.xxhash64("rid"))
    scores = scores.groupBy("rid").agg((-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("log_perplexity"))
    basic = df.select("id", "lang", "text", "rid").mapInArrow(measure, f"id {kind}, lang string, {counts}, last long").withColumnRenamed("last", "rid")
    return basic.join(scores, "rid", "left").drop("rid")


def _numbered(df: DataFrame) -> DataFrame:
    """With a stored number for each row."""
    kind = df.schema["id"].dataType.simpleString()

    def number(batches):
        task, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.arange(seen, seen + b.num_rows) + (task << 33))], names=["id", "lang", "text", "rid"])
            seen += b.num_rows

    return stored(df.select("id", "lang", "text").mapInArrow(number, f"id {kind}, lang string, text string, rid long"), "numbered")


def fences(scores: DataFrame, below: float = BELOW, above: float = ABOVE, least_range: float = LEAST_RANGE) -> DataFrame:
    """``lang, lowest, highest`` of log-perplexity, from quartiles over all rows of ``lang, log_perplexity``. They are read
    from a histogram, so they don't depend on partitioning."""
    bins = scores.where("log_perplexity is not null").groupBy("lang", F.floor(F.col("log_perplexity") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")  # log-perplexities are below 70, so a language has at most 70 / STEP bins
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    q1, q3 = (F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin"))) * STEP for k in (1, 3))
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(least_range))
    quartiles = ranked.groupBy("lang").agg(q1.alias("q1"), q3.alias("q3"))
    return quartiles.select("lang", (F.col("q1") - reach * below).alias("lowest"), (F.col("q3") + reach * above).alias("highest"))


def judged(
    df: DataFrame,
    least_words: int = 50,
    repeat_percent: int = 50,
    symbols: str = "#*$%&|<>",
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_entries: int = MODEL_ENTRIES,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    log_perplexity, kept``.

    Words are runs without ASCII white space, as they are written. Lines count as duplicates if they hold a word and
    equal an earlier line of the text; a word is repeated if a window of three words around it occurs twice or more.
    ``base_failed`` texts have under ``least_words`` words or over ``repeat_percent`` percent repeated ones. Of the others
    those are kept whose perplexity per character is between the fences of their language, which are drawn from them
    alone; the model counts all rows. Null texts are empty, have no perplexity and fail; null languages are ''. Repeated
    rows are documents of their own. Other columns are left out; an empty table gives no rows. Texts of any length are
    read whole, with working memory of some fifty times the longest. A model of over ``most_entries`` n-grams isn't
    broadcast: the documents' n-grams are joined with it.
    """
    prepare(df.sparkSession)
    read = df.select(named(id_col).alias("id"), F.coalesce(named(lang_col).cast("string"), F.lit("")).alias("lang"), named(text_col).cast("string").alias("text"))
    model = train(read.select("lang", "text"))
    rows = stored(measured(read, model, symbols, most_entries).withColumn("log_perplexity", F.round("log_perplexity", 6)), "measured")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lowest"), F.col("highest")), F.lit(False))
    found = rows.join(_bounded(fences(rows.where("not base_failed"))), "lang", "left")
    return found.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "log_perplexity", (~F.col("base_failed") & inside).alias("kept"))
