"""Log analytics: audit and feedback summaries, repeats, sessions. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# audit (session_id, question, domain, ts, latency_ms, blocked)


def audit_summary(audit: DataFrame, since: Column) -> DataFrame:
    rows = audit.where(F.col("ts") >= since)
    return rows.agg(
        F.count("*").alias("n_turns"),
        F.count_if("blocked").alias("n_blocked"),
        F.round(100 * F.count_if("blocked") / F.nullif(F.count("*"), F.lit(0)), 2).alias("blocked_pct"),
        F.round(F.avg(F.col("latency_ms").cast("decimal(28,4)")).cast("double"), 2).alias("mean_latency_ms"),
        F.count_distinct("session_id").alias("n_sessions"),
    )


def top_questions(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.groupBy("question").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(n)


def domain_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"))


def coalesce_repeats(events: DataFrame, key: str, order: list[str], what: list[str]) -> DataFrame:
    """Runs of equal ``what`` within a key become one row with their count and last time."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.lag(F.struct(*what)).over(w).eqNullSafe(F.struct(*what))
    islands = events.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island", *what).agg(F.count("*").alias("n"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))


# feedback (answer_hash, rating, ts, file)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """``rating, n, share_pct`` for 1 to 5, ratings outside clamped."""
    rated = feedback.select(S.clamp(F.col("rating"), 1, 5).cast("long").alias("rating"))
    scale = feedback.sparkSession.range(1, 6).withColumnRenamed("id", "rating")
    counts = rated.groupBy("rating").agg(F.count("*").alias("n"))
    total = rated.agg(F.count("*").alias("n_all"))
    filled = scale.join(F.broadcast(counts), "rating", "left").crossJoin(F.broadcast(total))
    return filled.select("rating", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.nullif("n_all", F.lit(0)), 2).alias("share_pct"))


def feedback_weights(feedback: DataFrame, file_col: str, cutoff: Column, window: Column) -> DataFrame:
    """``(file, weight, n)``: 1 + half the decayed sentiment over the root of the count, within 0.5 and 1.5."""
    signal = S.sentiment(F.col("rating")) * S.decay(F.col("ts"), cutoff, window)
    sums = feedback.where(F.col("ts") >= cutoff).groupBy(file_col).agg(F.sum(signal.cast("decimal(28,12)")).cast("double").alias("s"), F.count("*").alias("n"))
    return sums.select(file_col, F.round(S.clamp(1 + 0.5 * F.col("s") / F.sqrt("n"), 0.5, 1.5), 6).alias("weight"), "n")


def lowest_rated(feedback: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    return feedback.orderBy("rating", F.desc("ts"), id_col).limit(n)


# messages (session_id, turn, role, text)


def sessions(messages: DataFrame, session: str, turn: str) -> DataFrame:
    return messages.groupBy(session).agg(F.floor(F.count("*") / 2).cast("long").alias("turns"), F.max(turn).alias("last_turn"), F.sum(F.length("text")).alias("n_chars"))


def last_turns(messages: DataFrame, session: str, turn: str, turns: int = 20) -> DataFrame:
    """The newest two messages a turn of each session."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))
    return messages.withColumn("__r", rank).where(F.col("__r") <= 2 * turns).drop("__r")


def session_windows(events: DataFrame, user: str, at: str, gap_seconds: int = 7200) -> DataFrame:
    """Sessions by inactivity: ``user, session, started, ended, n``."""
    w = Window.partitionBy(user).orderBy(at)
    idle = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(w)
    marked = events.withColumn("__new", F.when(idle < gap_seconds, 0).otherwise(1)).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(user, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))
