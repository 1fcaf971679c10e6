"""Which domains a question goes to, and how their answers are merged."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..session import ship


def keyword_hits(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(question_id, domain, hits)``. A question's runs of words, as long as the longest keyword has, meet
    ``keywords (domain, keyword)`` in a join on their text; what meets is tested as ``mentions`` does."""
    parts = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    known = keywords.withColumn("__words", parts(F.col("keyword"))).withColumn("__first", F.get("__words", F.lit(0)))
    # a keyword of other characters only, or one that a question may go on from, has no first word of its own
    words = F.array_distinct(F.flatten(F.transform(parts(F.col("question")), lambda w: F.array(w, F.regexp_replace(w, "s$", ""), F.regexp_replace(w, "es$", "")))))
    asked = questions.select("question_id", "question", F.explode(words).alias("__first"))
    met = asked.join(known.where("__first is not null"), "__first").select("question_id", "question", "domain", "keyword").distinct()
    odd = questions.select("question_id", "question").join(known.where("__first is null").select("domain", "keyword"))
    pairs = met.unionByName(odd).where(S.mentions(F.col("question"), F.col("keyword")))
    return pairs.groupBy("question_id", "domain").agg(F.count_distinct("keyword").alias("hits"))


def owned_keywords(keywords: DataFrame) -> DataFrame:
    """Keywords of one domain only."""
    return keywords.groupBy("keyword").agg(F.count_distinct("domain").alias("n"), F.min("domain").alias("domain")).where("n = 1").select("domain", "keyword")


def dominance(hits: DataFrame) -> DataFrame:
    """``(question_id, domain, hits, runner_up, confident)``: the leader is confident with at least two hits and three
    times the runner-up's."""
    order = Window.partitionBy("question_id").orderBy(F.desc("hits"), "domain")
    led = hits.withColumn("r", F.row_number().over(order)).withColumn("runner_up", F.coalesce(F.lead("hits").over(order), F.lit(0).cast("long"))).where("r = 1")
    return led.select("question_id", "domain", "hits", "runner_up", ((F.col("hits") >= 2) & (F.col("hits") >= 3 * F.col("runner_up"))).alias("confident"))


def fan_out(scores: DataFrame, relative: float = 0.75, most: int = 2) -> DataFrame:
    """The best domains of each question that reach ``relative`` times its best score."""
    per = Window.partitionBy("question_id")
    ranked = scores.withColumn("best", F.max("score").over(per)).withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "domain")).cast("long"))
    return ranked.where((F.col("score") > 0) & (F.col("score") >= relative * F.col("best")) & (F.col("rank") <= most)).select("question_id", "domain", "score", "rank")


def statements(answers: DataFrame) -> DataFrame:
    """``(domain, subject, value)``: numbers in answers, with the two words before them in lower case."""
    found = F.regexp_extract_all(F.lower(F.col("answer")), F.lit(r"((?:[a-z]+\s+){2}(?:is|was|are|were|of|:)?\s*\$?[0-9][0-9,.]*)"), F.lit(1))
    each = answers.select("domain", F.explode(found).alias("s"))
    subject = F.regexp_extract("s", r"^([a-z]+\s+[a-z]+)", 1)
    value = F.regexp_replace(F.regexp_extract("s", r"([0-9][0-9,.]*)$", 1), r"[,.]+$|,", "")
    return each.select("domain", F.regexp_replace(subject, r"\s+", " ").alias("subject"), value.alias("value")).where("subject != '' and value != ''")


def conflicts(answers: DataFrame) -> DataFrame:
    """Subjects to which at least two domains give different values."""
    per = statements(answers).distinct().groupBy("subject").agg(F.count_distinct("domain").alias("n_domains"), F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"))
    return per.where("n_domains > 1 and n_values > 1")


def complementary(answers: DataFrame, new_words: int = 3) -> DataFrame:
    """Per domain the first sentence with at least ``new_words`` words of four letters that no other domain's answer
    contains. Words leave an answer once, without its text; each answer then meets the words that are its own."""
    ship(answers.sparkSession)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("answer")), F.lit(r"([a-z]{4,})"), F.lit(1)))
    lone = F.min("domain").alias("owner"), F.max("domain").alias("other"), F.bool_or(F.col("domain").isNull()).alias("anon")
    owned = answers.select("domain", F.explode(words).alias("word")).groupBy("word").agg(*lone).where("owner = other")
    # a word that only one domain has is also new in answers of no domain
    holders = F.when(F.col("anon"), F.array("owner", F.lit(None).cast(answers.schema["domain"].dataType))).otherwise(F.array("owner"))
    own = owned.select("word", F.explode(holders).alias("holder")).groupBy("holder").agg(F.collect_list("word").alias("own"))
    parts = T.sentences(F.col("answer"))
    mine = answers.join(own, F.col("domain").eqNullSafe(F.col("holder"))).select("domain", parts.alias("sentences"), "own")
    kind = answers.schema["domain"].dataType.simpleString()
    each = mine.select("domain", "sentences", F.transform("sentences", lambda s: F.lower(s)).alias("low"), "own")
    found = each.mapInArrow(_new_words, f"domain {kind}, nth int, sentence string, n_new long")
    new = found.groupBy("domain", "nth", "sentence").agg(F.sum("n_new").alias("n_new")).where(F.col("n_new") >= new_words)
    return new.groupBy("domain").agg(F.min_by(F.struct("sentence", "n_new"), "nth").alias("s")).select("domain", "s.sentence", "s.n_new")


def _new_words(batches):
    """``domain, nth, sentence, n_new`` of the sentences that have some of their answer's own words."""
    word = re.compile("[a-z]{4,}")
    for b in batches:
        at, nths, told, counts = [], [], [], []
        for i, (sentences, low, own) in enumerate(zip(*(b.column(c).to_pylist() for c in ("sentences", "low", "own")), strict=True)):
            own = set(own)
            for nth, text in enumerate(low or ()):
                if n := len(own.intersection(word.findall(text))):
                    at.append(i)
                    nths.append(nth)
                    told.append(sentences[nth])
                    counts.append(n)
        domains = b.column("domain").take(pa.array(at, pa.int64()))
        yield pa.record_batch([domains, pa.array(nths, pa.int32()), pa.array(told, pa.string()), pa.array(counts, pa.int64())], names=["domain", "nth", "sentence", "n_new"])


def grounding(claims: DataFrame, corpus_tokens: DataFrame) -> DataFrame:
    """``(claim_id, n_claims, n_grounded, score)``: the share of a text's tokens, stemmed, that the corpus has."""
    tokens = claims.select("claim_id", F.explode(F.array_distinct(F.transform(T.gate_tokens(F.col("text")), T.stem))).alias("token"))
    known = tokens.join(corpus_tokens.select("token").distinct().withColumn("there", F.lit(1)), "token", "left")
    return known.groupBy("claim_id").agg(F.count("*").alias("n_claims"), F.count("there").alias("n_grounded")).withColumn("score", F.round(F.col("n_grounded") / F.col("n_claims"), 2))


def recall(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """``(question_id, n_facts, n_found, recall)``: facts contained in the text retrieved for their question."""
    joined = facts.join(texts, "question_id", "left")
    found = F.coalesce(F.contains(F.lower(F.col("text")), F.lower(F.col("fact"))), F.lit(False))
    per = joined.groupBy("question_id", "fact").agg(F.max(found).alias("found"))
    return per.groupBy("question_id").agg(F.count("*").alias("n_facts"), F.count_if("found").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_facts"), 4))


def matching(column: Column, words: list[str]) -> Column:
    return F.coalesce(*(F.when(S.mentions(column, F.lit(w)), F.lit(w)) for w in words))
