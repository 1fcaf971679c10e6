"""Retrieval over documents: chunks, terms, BM25, cosine, rank fusion, keyword fallback, digest ranking, pins.

Tables: documents ``(doc_id, domain, name, text)``, chunks ``(chunk_id, doc_id, domain, name, chunk_index, chunk_total,
text)``, terms ``(chunk_id, term, tf, dl)``. Build chunks and terms once and store them; a query reads only the rows
of its terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60


def chunk(docs: DataFrame, size: int = 3500, overlap: int = 200, cap: int | None = None) -> DataFrame:
    """All chunks of each document, or with ``cap`` at most so many of its head, centre and tail."""
    pieces = docs.select("*", T.chunks(F.col("text"), size, overlap).alias("__pieces"))
    each = pieces.select(*(c for c in docs.columns if c != "text"), F.size("__pieces").alias("chunk_total"), F.posexplode("__pieces").alias("chunk_index", "text"))
    if cap:
        each = each.where(T.within_cap(F.col("chunk_index"), F.col("chunk_total"), cap))
    return each.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("::chunk_"), F.col("chunk_index").cast("string")))


def terms(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, term, tf, dl)`` with dl the tokens of the row."""
    tokens = rows.select(F.col(id_col), T.search_tokens(text).alias("tokens"))
    each = tokens.select(id_col, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(spark, query: str) -> DataFrame:
    """Query tokens with their number of occurrences: a handful of rows."""
    text = spark.range(1).select(F.explode(T.search_tokens(F.lit(query))).alias("term"))
    return text.groupBy("term").agg(F.count("*").alias("qf"))


def bm25(postings: DataFrame, sizes: DataFrame, query: str, id_col: str, n: int = 10) -> DataFrame:
    """``(id, score)``: BM25 with a floor for negative idf, divided by the best score; the n best with score above 0.

    ``sizes`` has (id, dl) of every row, also of those without tokens, since they count in N and the mean length.
    """
    spark = postings.sparkSession
    corpus = sizes.agg(F.count("*").alias("N"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    stats = term_stats(postings).crossJoin(F.broadcast(corpus)).withColumn("idf", F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = stats.agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = F.broadcast(query_terms(spark, query))
    weights = stats.join(asked, "term").crossJoin(F.broadcast(floor)).select("term", "qf", "avgdl", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    hits = postings.join(F.broadcast(weights), "term")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(id_col).agg(F.sum(part).alias("raw")).where("raw > 0")
    best = scored.agg(F.max("raw").alias("best"))
    return scored.crossJoin(F.broadcast(best)).select(id_col, (F.col("raw") / F.col("best")).alias("score")).orderBy(F.desc(F.round("score", 9)), id_col).limit(n)


def bm25_texts(docs: DataFrame, query: str, id_col: str, text: Column, n: int = 10) -> DataFrame:
    """``bm25`` without stored postings: document frequencies from each text's distinct tokens, and frequencies of the
    query's terms counted inside the text, so that only (term, count) pairs are shuffled."""
    asked: dict[str, int] = {}
    for t in re.findall("[a-z0-9]+", query.lower()):
        asked[t] = asked.get(t, 0) + 1
    tokens = docs.select(id_col, T.search_tokens(text).alias("tokens"))
    hits = tokens.select(id_col, F.size("tokens").cast("double").alias("dl"), F.filter("tokens", lambda x: x.isin(*asked) if asked else F.lit(False)).alias("hits"))
    frequencies = [_occurrences(t).alias(f"tf{i}") for i, t in enumerate(asked)]
    per = hits.select(id_col, "dl", *frequencies)
    corpus = per.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"))
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = df.crossJoin(F.broadcast(corpus)).select("term", idf.alias("idf"), "avgdl")
    mine = lambda i, t: F.max(F.when(F.col("term") == t, F.col("idf"))).alias(f"idf{i}")
    stats = weighed.agg((F.avg("idf") * EPSILON).alias("floor"), F.max("avgdl").alias("avgdl"), *(mine(i, t) for i, t in enumerate(asked)))
    part = F.lit(0.0)
    for i, qf in enumerate(asked.values()):
        w = F.when(F.col(f"idf{i}") < 0, F.col("floor")).otherwise(F.coalesce(f"idf{i}", F.lit(0.0)))
        tf = F.col(f"tf{i}")
        part = part + qf * w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = per.crossJoin(F.broadcast(stats)).select(id_col, part.alias("raw")).where("raw > 0")
    return head_shares(scored, id_col, n)


def head_shares(scored: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n best rows of ``(id, raw)`` with their share of the best score. The best row is in the answer, so a window
    over these few rows knows its score."""
    head = scored.orderBy(F.desc("raw"), id_col).limit(n + 1)
    share = F.col("raw") / F.max("raw").over(Window.partitionBy())
    return head.select(id_col, share.alias("score")).orderBy(F.desc(F.round("score", 9)), id_col).limit(n)


def bm25_each(docs: DataFrame, questions: DataFrame, id_col: str, text: Column, n: int = 10) -> DataFrame:
    """``(question_id, id, raw)``: for each of ``questions (question_id, question)`` the n best rows by ``bm25``, before
    its division by the best score. Makes a row for each question and text that share a term."""
    tokens = docs.select(id_col, T.search_tokens(text).alias("tokens"))
    corpus = tokens.agg(F.count("*").alias("N"), F.avg(F.size("tokens").cast("double")).alias("avgdl"))
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    stats = df.crossJoin(F.broadcast(corpus)).withColumn("idf", F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = stats.agg((F.avg("idf") * EPSILON).alias("floor"))
    asked = questions.select("question_id", F.explode(T.search_tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qf"))
    weights = asked.join(stats, "term").crossJoin(F.broadcast(floor)).select("question_id", "term", "qf", "avgdl", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = terms(docs, id_col, text).join(weights, "term").groupBy("question_id", id_col).agg(F.sum(part).alias("raw")).where("raw > 0")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("raw", 6)), id_col))
    return scored.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def _occurrences(term: str) -> Column:
    return F.size(F.filter("hits", lambda x: x == term)).cast("double")


def nearest(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str, n: int = 10) -> DataFrame:
    """``(id, score)``: exact cosine against the one row of ``query``, floored at 0."""
    q = F.broadcast(query.select(F.col(vector_col).alias("__q")).limit(1))
    scored = vectors.crossJoin(q).select(id_col, F.greatest(F.lit(0.0), F.coalesce(S.cosine(F.col(vector_col), F.col("__q")), F.lit(0.0))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), id_col).limit(n)


def placed(hits: DataFrame, id_col: str) -> DataFrame:
    """Ranks of a short hit list."""
    return hits.select(id_col, F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), id_col)).alias("rank"))


def fuse(first: DataFrame, second: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two short hit lists, normalised so that first in both is 1."""
    both = placed(first, id_col).unionByName(placed(second, id_col))
    total = both.groupBy(id_col).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("s"))
    return total.select(id_col, F.least(F.lit(1.0), F.col("s") * (RRF + 1) / 2).alias("score")).orderBy(F.desc(F.round("score", 9)), id_col).limit(n)


def weigh(hits: DataFrame, weights: DataFrame, id_col: str) -> DataFrame:
    """Scores of a short hit list times feedback weights (1 where there is none), kept in 0 to 1. ``weights`` has one
    row per id."""
    mine = weights.join(F.broadcast(hits.select(id_col)), id_col, "left_semi")  # as many rows as hits at most
    return hits.join(F.broadcast(mine), id_col, "left").select(id_col, S.clamp(F.col("score") * F.coalesce("weight", F.lit(1.0)), 0.0, 1.0).alias("score"))


def best_chunk(hits: DataFrame, file_col: str) -> DataFrame:
    """One row per file with its best score."""
    return hits.groupBy(file_col).agg(F.max("score").alias("score"))


def keyword_fallback(docs: DataFrame, query: str, id_col: str, text: Column, n: int = 10) -> DataFrame:
    """The share of the query's words that a text contains, above 0."""
    words = sorted({w for w in query.lower().split() if w})
    low = F.lower(text)
    score = sum((F.contains(low, F.lit(w)).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    return docs.select(id_col, score.alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(n)


def rank_digests(docs: DataFrame, query: str, id_col: str, name: Column, keywords: Column, body: Column, n: int = 3, least: float = 2.0, relative: float = 0.5) -> DataFrame:
    """Digests by idf times hits in name (3), keywords (2) and body (up to 3 occurrences); those of at least ``least``
    and ``relative`` times the best."""
    asked = docs.sparkSession.range(1).select(F.array_distinct(T.topic_tokens(F.lit(query)))).first()[0]

    def wanted(c: Column) -> Column:
        """Only the query's tokens leave a document."""
        return F.filter(T.topic_tokens(c), lambda t: t.isin(*asked) if asked else F.lit(False))

    bags = docs.select(id_col, wanted(name).alias("n"), wanted(keywords).alias("k"), wanted(body).alias("b"))

    def tagged(bag: str) -> Column:
        return F.transform(bag, lambda t: F.struct(t.alias("term"), F.lit(bag).alias("where")))

    each = bags.select(id_col, F.explode(F.concat(*map(tagged, ("n", "k", "b")))).alias("x"))
    hit = lambda w: F.count_if(F.col("x.where") == w)
    mine = each.groupBy(id_col, F.col("x.term").alias("term")).agg(hit("n").alias("in_name"), hit("k").alias("in_keywords"), hit("b").alias("in_body"))
    total = docs.agg(F.count("*").alias("N"))
    idf = mine.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", F.log(1 + F.col("N") / F.col("df")).alias("idf"))
    weight = 3 * (F.col("in_name") > 0).cast("int") + 2 * (F.col("in_keywords") > 0).cast("int") + F.least("in_body", F.lit(3))
    scored = mine.join(F.broadcast(idf), "term").groupBy(id_col).agg(F.sum(F.col("idf") * weight).alias("score"))
    best = scored.agg(F.max("score").alias("best"))
    return scored.crossJoin(F.broadcast(best)).where((F.col("score") >= least) & (F.col("score") >= relative * F.col("best"))).select(id_col, "score").orderBy(F.desc(F.round("score", 9)), id_col).limit(n)


def pin(hits: DataFrame, pinned: DataFrame, boosted: Column, id_col: str) -> DataFrame:
    """Pinned rows first with score 1, then hits for which ``boosted`` holds, then the rest, each by score."""
    pins = pinned.select(id_col, F.lit(1.0).alias("score"), F.lit(0).alias("tier"))
    rest = hits.join(pinned.select(id_col), id_col, "left_anti").select(id_col, "score", F.when(boosted, 1).otherwise(2).alias("tier"))
    order = Window.orderBy("tier", F.desc(F.round("score", 9)), id_col)
    return pins.unionByName(rest).select(F.row_number().over(order).cast("long").alias("place"), id_col, "score", "tier")


def best_per_domain(hits: DataFrame, domain_col: str, id_col: str, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(domain_col).orderBy(F.desc(F.round("score", 9)), id_col))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
