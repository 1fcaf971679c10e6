"""Extractive summaries of files and domains: titles, terms, topics, drift and staleness of descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T

# Folder names that say nothing about a topic.
GENERIC = ("archive", "backup", "data", "docs", "documents", "files", "misc", "new", "old", "other", "temp", "tmp")


def numeric_sentence(c: Column) -> Column:
    return c.rlike(r"\b\d[\d,%.]*\b")


def placeholder(summary: Column, name: Column) -> Column:
    """A summary that is only a type or only the file's name."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return summary.isNull() | F.lower(F.trim(summary)).rlike(r"^(a |an )?(document|file|spreadsheet|presentation|image|pdf|text)( file)?\.?$|^$") | (plain(summary) == plain(stem)) | (plain(summary) == plain(name))


def first_title(text: Column, longest: int = 100) -> Column:
    """The first line of at least two words that isn't a table row or a marker."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^#+\s*", "")))
    fit = F.filter(lines, lambda x: (F.size(F.split(x, r"\s+")) >= 2) & (F.length(x) <= longest) & ~F.contains(x, F.lit("|")) & ~x.rlike(r"^(<!--|---|\[|Slide \d+)"))
    return F.get(fit, F.lit(0))


def name_tokens(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")
    return F.filter(T.topic_tokens(F.translate(stem, "_-", "  ")), lambda t: ~t.rlike("[0-9]"))


def file_terms(docs: DataFrame, key: str, path: Column, text: Column, n: int = 6, boost: int = 3) -> DataFrame:
    """The commonest terms of each file; a term that is also in its name counts ``boost`` more."""
    each = docs.select(key, name_tokens(path).alias("names"), F.explode(T.topic_tokens(text)).alias("token"))
    counts = each.groupBy(key, "token").agg((F.count("*") + F.when(F.array_contains(F.first("names"), F.col("token")), boost).otherwise(0)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def file_summaries(docs: DataFrame, key: str, path: Column, text: Column, longest: int = 400) -> DataFrame:
    """``key, summary``: title and terms, else the name."""
    titled = docs.select(key, path.alias("__path"), first_title(text).alias("title"))
    terms = file_terms(docs, key, path, text).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]), ", ").alias("terms"))
    both = titled.join(terms, key, "left")
    said = F.concat_ws(". ", F.col("title"), F.concat(F.lit("Terms: "), F.col("terms")))
    return both.select(key, F.substring(F.when(said != "", said).otherwise(F.substring_index("__path", "/", -1)), 1, longest).alias("summary"))


def domain_keywords(tokens: DataFrame, domain: str, file: str, n: int = 12) -> DataFrame:
    """Terms of a domain by the number of files that have them."""
    per = tokens.select(domain, file, "token").distinct().groupBy(domain, "token").agg(F.count("*").alias("n_files"))
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("n_files"), "token"))
    return per.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def topic_folders(files: DataFrame, domain: str, folder: Column, n: int = 4) -> DataFrame:
    """The folders with most files in each domain, generic names left out."""
    named = files.select(domain, folder.alias("folder")).where(~F.lower("folder").isin(*GENERIC) & (F.col("folder") != ""))
    counts = named.groupBy(domain, "folder").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(F.desc("n"), "folder"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def sampled_evidence(files: DataFrame, domain: str, key: str, most: int = 20) -> DataFrame:
    """Every k-th file of a domain so that at most ``most`` remain, in the order of ``key``."""
    w = Window.partitionBy(domain)
    placed = files.withColumn("__i", F.row_number().over(w.orderBy(key)) - 1).withColumn("__n", F.count("*").over(w))
    return placed.where(F.col("__i") % F.ceil(F.col("__n") / most) == 0).drop("__i", "__n")


def drift(files: DataFrame, events: DataFrame) -> DataFrame:
    """``domain, n_newer``: files changed after the domain's last index event."""
    last = events.groupBy("domain").agg(F.max("ts").alias("last"))
    return files.join(F.broadcast(last), "domain", "left").groupBy("domain").agg(F.count_if(F.col("last").isNull() | (F.col("mtime") > F.col("last"))).alias("n_newer"))


def marked_block(text: Column, start: str, end: str) -> Column:
    """Text between two markers, null without them."""
    found = F.regexp_extract(text, rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)
    return F.nullif(F.trim(found), F.lit(""))


def replace_block(text: Column, start: str, end: str, block: Column) -> Column:
    """``text`` with the marked block replaced, or appended where there is none."""
    whole = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    at = F.locate(start, text)
    till = F.locate(end, text)
    before, after = text.substr(F.lit(1), at - 1), text.substr(till + len(end), F.length(text))
    return F.when((at > 0) & (till > at), F.concat(before, whole, after)).otherwise(F.concat(text, F.lit("\n\n"), whole))


def grounded_or(candidate: Column, score: Column, fallback: Column, least: float = 0.6) -> Column:
    return F.when((score >= least) & candidate.isNotNull(), candidate).otherwise(fallback)


def not_digested(files: DataFrame, supported: list[str]) -> DataFrame:
    return files.where(~F.col("ext").isin(*supported)).groupBy("domain", "ext").agg(F.count("*").alias("n"))


def answer_budget(n_domains: int, top_n: int, max_chars: int, limit: int = 24_000) -> int:
    """The largest number of files per domain whose texts fit in 80 % of ``limit``."""
    return max(1, min(top_n, int(0.8 * limit) // max(1, n_domains * max_chars)))


def summary_of_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("n_sources"), F.max("score").alias("best")).withColumn("confidence", S.confidence(F.col("n_sources"), F.col("best")))
