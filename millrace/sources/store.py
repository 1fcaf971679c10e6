"""Tables of a knowledge store: chunks, domain metadata, audit, feedback, messages.

Each is a log of commits over Parquet segments, so a change writes what changed, a job that dies half-way changes
nothing, and writers beside each other lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import logs
from .commitlog import CommitLog

SCHEMAS = {
    "chunks": "domain string, path string, name string, doc_id string, chunk_id string, chunk_index int, chunk_total int, source string, text string, hash string",
    "domain_meta": "domain string, meta string, indexed_at double",
    "audit": "event string, ts double, session_id string, question string, domains array<string>, files_cited array<string>, answer_hash string, blocked boolean, latency_ms double",
    "feedback": "ts double, session_id string, question string, rating int, comment string, answer_hash string",
    "messages": "session_id string, turn long, role string, text string, ts double",
}

#: By what rows of a table replace each other.
KEYS = {"chunks": "path", "domain_meta": "domain", "messages": "session_id"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self, table: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/{table}", SCHEMAS[table], KEYS.get(table))

    def versions(self, table: str) -> list[int]:
        """Numbers of the table's commits."""
        return self.log(table).numbers()

    def read(self, table: str) -> DataFrame:
        """The newest rows, or an empty table."""
        return self.log(table).read()

    def replace(self, table: str, rows: DataFrame, keep: int = 2) -> None:
        log = self.log(table)
        log.overwrite(rows)
        log.vacuum(keep)

    def append(self, table: str, rows: DataFrame) -> None:
        self.log(table).append(rows)

    def drop(self, table: str) -> None:
        path, fs = self._fs(f"{self.root}/{table}")
        fs.delete(path, True)

    # ---- documents

    def upsert(self, chunks: DataFrame) -> None:
        """Chunks of files replace those of the same path."""
        self.log("chunks").upsert(chunks)

    def remove(self, paths: DataFrame) -> None:
        self.log("chunks").delete(paths)

    def files(self) -> DataFrame:
        """One row per indexed file, its hash that of the first chunk."""
        return self.read("chunks").groupBy("domain", "path").agg(F.min_by("hash", "chunk_index").alias("hash"), F.count("*").alias("n_chunks"))

    def domains(self) -> DataFrame:
        return self.files().groupBy("domain").agg(F.count("*").alias("n_files"), F.sum("n_chunks").alias("n_chunks"))

    def set_meta(self, domain: str, meta: dict, now: float) -> None:
        """Replaces a domain's metadata; values keep their types through JSON."""
        import json

        fresh = self.spark.createDataFrame([(domain, json.dumps(meta, sort_keys=True), now)], SCHEMAS["domain_meta"])
        self.log("domain_meta").upsert(fresh)

    def replace_meta(self, metas: dict[str, dict], now: float) -> None:
        """Metadata of all domains in one new version."""
        import json

        rows = [(d, json.dumps(m, sort_keys=True), now) for d, m in metas.items()]
        self.replace("domain_meta", self.spark.createDataFrame(rows, SCHEMAS["domain_meta"]))

    def meta(self, domain: str) -> dict:
        import json

        row = self.read("domain_meta").where(F.col("domain") == domain).first()
        return json.loads(row["meta"]) | {"indexed_at": row["indexed_at"]} if row else {}

    # ---- logs

    def log_turn(self, ts: float, session: str, question: str, answer: str, domains=(), files=(), blocked=False, latency_ms=0.0) -> None:
        row = self.spark.createDataFrame(
            [("turn", ts, session, question, answer, list(domains), list(files), blocked, float(latency_ms))],
            "event string, ts double, session_id string, question string, answer string, domains array<string>, files_cited array<string>, blocked boolean, latency_ms double",
        )
        self.append("audit", row.withColumn("question", F.substring("question", 1, 500)).withColumn("answer_hash", S.answer_hash(F.col("answer"))))

    def rate(self, ts: float, session: str, question: str, answer: str, rating: int, comment: str = "") -> None:
        """A rating from 1 to 5; others are refused."""
        if not 1 <= int(rating) <= 5:
            raise ValueError("a rating is 1 to 5")
        row = self.spark.createDataFrame([(ts, session, question, int(rating), comment[:1000], answer)], "ts double, session_id string, question string, rating int, comment string, answer string")
        self.append("feedback", row.withColumn("answer_hash", S.answer_hash(F.col("answer"))))

    def read_audit(self, session: str | None = None, most: int = 500) -> DataFrame:
        """The newest turns, newest first."""
        rows = self.read("audit")
        rows = rows.where(F.col("session_id") == session) if session else rows
        return rows.orderBy(F.desc("ts"), "session_id", "question").limit(most)

    def audit_summary(self, now: float, days: float) -> DataFrame:
        rows = self.read("audit").withColumn("domain", F.get("domains", F.lit(0)))
        return logs.audit_summary(rows, F.lit(now - 86400 * days))

    def file_weights(self, now: float, days: float = 90) -> DataFrame:
        """Feedback by cited file: ratings join the newest turn with their answer."""
        cited = self.read("audit").groupBy("answer_hash").agg(F.max_by("files_cited", "ts").alias("files"))
        rated = self.read("feedback").join(cited, "answer_hash").select("rating", "ts", F.explode("files").alias("file"))
        return logs.feedback_weights(rated, "file", F.lit(now - 86400 * days), F.lit(86400.0 * days))

    # ---- conversations

    def remember(self, session: str, question: str, answer: str, now: float, max_turns: int = 20) -> None:
        """Adds a turn and keeps the session's newest ones. Only this session's messages are written."""

        def turn(messages: DataFrame) -> DataFrame:
            old = messages.where(F.col("session_id") == session)
            last = old.agg(F.max("turn")).first()[0]
            start = 0 if last is None else last + 1
            fresh = self.spark.createDataFrame([(session, start, "user", question, now), (session, start + 1, "assistant", answer, now)], SCHEMAS["messages"])
            return logs.last_turns(old.unionByName(fresh), "session_id", "turn", max_turns)

        self.log("messages").update(turn)

    def history(self, session: str, now: float, hours: float = 2.0) -> list[dict]:
        """A session's messages, oldest first; none after ``hours`` of inactivity. At most the kept turns."""
        rows = [r.asDict() for r in self.read("messages").where(F.col("session_id") == session).orderBy("turn").collect()]
        return rows if rows and now - max(r["ts"] for r in rows) <= 3600 * hours else []

    def sessions(self, now: float, hours: float = 2.0) -> DataFrame:
        last = self.read("messages").groupBy("session_id").agg(F.floor(F.count("*") / 2).cast("long").alias("turns"), F.max("ts").alias("last_active"))
        return last.withColumn("expired", F.col("last_active") < now - 3600 * hours)

    def forget(self, session: str) -> None:
        self.log("messages").delete(self.spark.createDataFrame([(session,)], "session_id string"))

    def rotate(self, table: str, before: float) -> DataFrame:
        """Sets log rows older than ``before`` aside and returns all that were. One commit takes them out and keeps them,
        and rows that are appended meanwhile stay where they are."""
        return self.log(table).rotate(F.col("ts") < before)
