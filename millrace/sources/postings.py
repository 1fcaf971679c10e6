"""Stored postings in blocks, from which BM25 answers one question or many.

Tasks cut the rows that they read into ranges of about a thousand, and a block holds the postings of one term in one
range, with its largest frequency and its shortest row. That gives what the range can score at most for a question, so
ranges which can't reach the question's best rows are never read. A folder holds ``blocks``, sorted by term within each
file, so that a question for few terms opens few row groups; ``stats (scope, term, idf)``; and ``corpus (scope, n, avgdl,
floor)``. The scope is a row's domain; the empty scope stands for all rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..session import ship

#: Rows in a range, at most.
RANGE_ROWS = 1024
#: Ranges of a scope that a task makes at a time, so that it can put like rows together.
POOL = 4
#: A term in more than this share of these rows doesn't make them alike.
COMMON = 0.2
#: Postings that a task holds before it ends its ranges.
HELD = 8_000_000
#: Files among which the blocks of a term are dealt, at most.
SPREAD = 32
#: Ranges of a question that are scored first, to learn what the others must reach.
FIRST = 3
#: Weighted terms of questions that are sent to all tasks; more are joined.
ASKED_ROWS = 1_000_000
#: Scores are compared as sums of doubles in any order.
SLACK = 1e-6


def blocked(rows: DataFrame, id_col: str, text: Column, scope: Column) -> DataFrame:
    """``term, scope, range, n, length, max_tf, min_dl, ids, tfs, dls``: the blocks of all terms, made where the rows are.
    Each row also has the term '' with frequency 0, which counts rows. Reading ``rows`` again has to give each partition
    its rows in the same order, as scans do."""
    ship(rows.sparkSession)
    kind, range_rows, pool, most = rows.schema[id_col].dataType.simpleString(), RANGE_ROWS, POOL, HELD

    def block(batches):
        word, task, ended = re.compile("[a-z0-9]+"), TaskContext.get().partitionId() << 32, 0
        open_, held = {}, 0

        def end(scope):
            nonlocal ended, held
            ids, dls, found = open_.pop(scope)
            flat = np.concatenate([np.frombuffer(x, np.int32) for x in found.values()]).astype(np.int64).reshape(-1, 2)
            held -= len(flat)
            at, tf = flat[:, 0], flat[:, 1]
            df = np.fromiter((len(x) // 2 for x in found.values()), np.int64, len(found))
            term = np.repeat(np.arange(len(df)), df)
            # a row comes beside those with which it shares the most frequent of its terms that aren't common
            by_row = np.lexsort((term, np.where(df <= COMMON * len(ids), df, 0)[term], at))
            marks = term[by_row[np.append(at[by_row][1:] != at[by_row][:-1], True)]]
            part = np.empty(len(ids), np.int64)
            part[np.argsort(marks, kind="stable")] = np.arange(len(ids)) // range_rows
            order = np.lexsort((at, part[at], term))
            at, tf, term = at[order], tf[order], term[order]
            starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[at][1:] != part[at][:-1])))
            dl = np.array(dls, np.int64)[at]
            lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), values)
            columns = {
                "term": pa.array(found, pa.string()).take(pa.array(term[starts])), "scope": pa.array([scope] * len(starts), pa.string()),
                "range": pa.array(task + ended + part[at[starts]]), "n": pa.array(np.diff(np.append(starts, len(at)))), "length": pa.array(np.add.reduceat(dl, starts)),
                "max_tf": pa.array(np.maximum.reduceat(tf, starts)), "min_dl": pa.array(np.minimum.reduceat(dl, starts)),
                "ids": lists(pa.array(ids, id_type).take(pa.array(at))), "tfs": lists(pa.array(tf, pa.int32())), "dls": lists(pa.array(dl, pa.int32())),
            }
            ended += -(-len(ids) // range_rows)
            return pa.record_batch(columns)

        for b in batches:
            id_type = b.column(0).type
            for i, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s not in open_:
                    open_[s] = [], [], defaultdict(lambda: array("i"))
                ids, dls, found = open_[s]
                tf = Counter(word.findall(t or ""))
                k = len(ids)
                ids.append(i)
                dls.append(tf.total())
                tf[""] = 0
                for term, n in tf.items():
                    found[term].extend((k, n))
                held += len(tf)
                if len(ids) >= pool * range_rows:
                    yield end(s)
                elif held >= most:
                    for other in list(open_):
                        yield end(other)
        for s in list(open_):
            yield end(s)

    read = rows.select(F.col(id_col).alias("id"), F.coalesce(scope, F.lit("")).alias("scope"), F.lower(text).alias("text"))
    return read.mapInArrow(block, f"term string, scope string, range long, n long, length long, max_tf long, min_dl long, ids array<{kind}>, tfs array<int>, dls array<int>")


def build(rows: DataFrame, id_col: str, text: Column, folder: str, scope: Column | None = None) -> None:
    """Writes the postings of ``rows``, whose ids differ. Rows without tokens count in the number of rows and in their
    mean length. Only blocks are shuffled, once."""
    spark = rows.sparkSession
    blocks = blocked(rows, id_col, text, F.lit("") if scope is None else scope)
    # a common term has many ranges, so it lies in many files
    ordered = blocks.repartition("term", F.pmod("range", F.lit(SPREAD))).sortWithinPartitions("term", "range", "scope")
    ordered.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{folder}/blocks")
    heads = spark.read.parquet(f"{folder}/blocks").select("term", "scope", "n", "length")
    every = lambda df: df.unionByName(df.where("scope != ''").withColumn("scope", F.lit("")))
    sizes = every(heads.where("term = ''").groupBy("scope").agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
    sizes = sizes.groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    df = every(heads.where("term != ''").groupBy("scope", "term").agg(F.sum("n").alias("df"))).groupBy("scope", "term").agg(F.sum("df").alias("df"))
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    stats = df.join(sizes, "scope").select("scope", "term", idf.alias("idf"))
    stats.repartitionByRange("term", "scope").sortWithinPartitions("term", "scope").write.mode("overwrite").parquet(f"{folder}/stats")
    floor = spark.read.parquet(f"{folder}/stats").groupBy("scope").agg((F.avg("idf") * search.EPSILON).alias("floor"))
    sizes.join(floor, "scope", "left").coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus")


def _part(w: Column | str, tf: Column | str, dl: Column | str) -> Column:
    k, b = search.K1, search.B
    w, tf, dl = (F.col(c) if isinstance(c, str) else c for c in (w, tf, dl))
    return w * tf * (k + 1) / (tf + k * (1 - b + b * dl / F.col("avgdl")))


def weights(spark: SparkSession, folder: str, asked: DataFrame, scope: str = "") -> DataFrame:
    """``question_id, term, w, avgdl`` of ``asked (question_id, term, qf)``, for terms that the rows of ``scope`` have."""
    corpus = spark.read.parquet(f"{folder}/corpus").where(F.col("scope") == scope)  # one row
    known = spark.read.parquet(f"{folder}/stats").where(F.col("scope") == scope).join(F.broadcast(corpus), "scope")
    return asked.join(known, "term").select("question_id", "term", "avgdl", (F.col("qf") * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("w"))


def _blocks(spark: SparkSession, folder: str, scope: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/blocks")
    return rows.where(F.col("scope") == scope) if scope else rows


def _best(n: int):
    """A function that scores the rows of a range for the questions that ask for it: those that may be among a question's
    ``n`` best, by scores rounded to six places."""
    k, b = search.K1, search.B

    def score(blocks: pa.Table, kept: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(blocks) and len(kept):
            flat = lambda c: blocks.column(c).combine_chunks().flatten()
            sizes = lambda c: pc.list_value_length(blocks.column(c)).to_numpy()
            ids = flat("ids").dictionary_encode()
            at, tf, dl = ids.indices.to_numpy(), flat("tfs").to_numpy(), flat("dls").to_numpy()
            part = tf * (k + 1) / (tf + k * (1 - b + b * dl / blocks.column("avgdl")[0].as_py()))
            ends = np.cumsum(sizes("ids"))
            starts = ends - sizes("ids")
            asked = flat("asked")
            mine = pc.is_in(asked.field("question_id"), value_set=kept.column("question_id").combine_chunks())
            block = np.repeat(np.arange(len(blocks)), sizes("asked"))[mine.to_numpy(zero_copy_only=False)]
            asked = asked.filter(mine)
            questions, w = asked.field("question_id").dictionary_encode(), asked.field("w").to_numpy()
            order = np.argsort(questions.indices.to_numpy(), kind="stable")
            bounds = np.append(0, np.cumsum(np.bincount(questions.indices.to_numpy(), minlength=len(questions.dictionary))))
            for q in range(len(questions.dictionary)):
                raw = np.zeros(len(ids.dictionary))
                for j in order[bounds[q] : bounds[q + 1]]:
                    here = slice(starts[block[j]], ends[block[j]])
                    raw[at[here]] += w[j] * part[here]
                best = np.flatnonzero(raw > 0)
                if len(best) > n:
                    best = best[raw[best] >= np.partition(raw[best], -n)[-n] - 2 * SLACK]
                found[0].append(np.full(len(best), q))
                found[1].append(best)
                found[2].append(raw[best])
        if not found[0]:
            return pa.table({"question_id": kept.column("question_id")[:0], "id": blocks.column("ids").combine_chunks().flatten()[:0], "raw": pa.array([], pa.float64())})
        q, best, raw = map(np.concatenate, found)
        return pa.table({"question_id": questions.dictionary.take(pa.array(q)), "id": ids.dictionary.take(pa.array(best)), "raw": raw})

    return score


def _scored(blocks: DataFrame, w: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """``question_id, id, raw`` of the rows that may be among the ``n`` best of a question in a range, for the ranges that
    ``kept (question_id, scope, range)`` names. The blocks of a range meet in one task, however many questions they serve."""
    ship(blocks.sparkSession)
    askers = w.groupBy("term").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("question_id", "w")).alias("asked"))
    asked = blocks.select("term", "scope", "range", "ids", "tfs", "dls").join(_sent(askers, w), "term").select("scope", "range", "ids", "tfs", "dls", "avgdl", "asked")
    kind = {c.name: c.dataType.simpleString() for c in (*kept.schema, *blocks.schema)}
    schema = f"question_id {kind['question_id']}, id {kind['ids'].removeprefix('array<').removesuffix('>')}, raw double"
    mine = kept.select("question_id", F.col("scope").alias("in_scope"), F.col("range").alias("in_range"))
    return asked.groupBy("scope", "range").cogroup(mine.groupBy("in_scope", "in_range")).applyInArrow(_best(n), schema)


def _sent(rows: DataFrame, w: DataFrame) -> DataFrame:
    """``rows``, sent to all tasks if the weights are few; ``w`` is cached."""
    return F.broadcast(rows) if w.limit(ASKED_ROWS + 1).count() <= ASKED_ROWS else rows


def reachable(spark: SparkSession, folder: str, asked: DataFrame, n: int, scope: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``question_id, scope, range`` of the ranges that may hold one of a question's ``n`` best rows; ``question_id, scope,
    range, most, pairs`` of all ranges, with what they could score; and ``weights``."""
    w = weights(spark, folder, asked, scope).cache()
    blocks = _blocks(spark, folder, scope)
    most = _part(F.greatest("w", F.lit(0.0)), "max_tf", "min_dl")
    heads = blocks.select("term", "scope", "range", "n", "max_tf", "min_dl").join(_sent(w, w), "term")
    bounds = heads.groupBy("question_id", "scope", "range").agg(F.sum(most).alias("most"), F.sum("n").alias("pairs")).cache()
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("most"), "scope", "range"))
    first = bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("question_id", "scope", "range")
    few = first.join(w.select("question_id", "term"), "question_id").select("term", "scope", "range").distinct()
    some = blocks.join(_sent(few, w), ["term", "scope", "range"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("raw")))
    needed = _scored(some, w, first, n).withColumn("rank", rank).where(F.col("rank") == n).select("question_id", F.col("raw").alias("needed"))
    kept = bounds.join(needed, "question_id", "left").where((F.col("most") > 0) & (F.col("most") >= F.coalesce("needed", F.lit(0.0)) - SLACK))
    return kept.select("question_id", "scope", "range"), bounds, w


def terms_of(questions: DataFrame) -> DataFrame:
    """``question_id, term, qf`` of ``questions (question_id, question)``."""
    return questions.select("question_id", F.explode(T.search_tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qf"))


def bm25_each(spark: SparkSession, folder: str, questions: DataFrame, id_col: str, n: int = 10, scope: str = "") -> DataFrame:
    """``question_id, id, raw``: the ``n`` best rows of each of ``questions (question_id, question)``, by scores rounded to
    six places and then by id, as ``search.bm25_each`` finds them. Only ranges are scored that can hold one of them."""
    kept, _, w = reachable(spark, folder, terms_of(questions), n, scope)
    scored = _scored(_blocks(spark, folder, scope), w, kept, n)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("raw", 6)), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= n).select("question_id", F.col("id").alias(id_col), "raw")


def skipped(spark: SparkSession, folder: str, questions: DataFrame, n: int = 10, scope: str = "") -> DataFrame:
    """``question_id, pairs, scored``: postings of the question's terms, and how many of them lie in ranges that may hold
    one of its ``n`` best rows."""
    kept, bounds, _ = reachable(spark, folder, terms_of(questions), n, scope)
    mine = kept.withColumn("mine", F.lit(True))
    both = bounds.join(mine, ["question_id", "scope", "range"], "left")
    return both.groupBy("question_id").agg(F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("mine"), F.col("pairs")).otherwise(0)).alias("scored"))


def bm25(spark: SparkSession, folder: str, question: str, id_col: str, id_type: str, n: int = 10, scope: str = "") -> DataFrame:
    """``(id, score)`` as ``search.bm25`` over the rows of ``scope``, reading only the blocks of the question's terms."""
    asked = Counter(re.findall("[a-z0-9]+", question.lower()))
    if not asked:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, score double")
    mine = F.col("term").isin(*asked)
    corpus = F.broadcast(spark.read.parquet(f"{folder}/corpus").where(F.col("scope") == scope))
    stats = spark.read.parquet(f"{folder}/stats").where(mine & (F.col("scope") == scope)).join(corpus, "scope")
    qf = F.create_map(*(F.lit(x) for pair in asked.items() for x in pair))
    w = stats.select("term", "avgdl", (qf[F.col("term")] * F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))).alias("w"))
    hits = _blocks(spark, folder, scope).where(mine).select("term", "ids", "tfs", "dls").join(F.broadcast(w), "term").select("w", "avgdl", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    scored = hits.groupBy(F.col("p.ids").alias(id_col)).agg(F.sum(_part("w", "p.tfs", "p.dls")).alias("raw")).where("raw > 0")
    return search.head_shares(scored, id_col, n)
