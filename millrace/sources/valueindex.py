"""Which table a question is about: an inverted index from names, column words and values to files and columns.

The index is a log of commits by path, so a file that changes writes its own entries and nobody else's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from .commitlog import BROADCAST_ROWS, CommitLog

SCHEMA = "path string, col string, kind string, term string, n long"
#: What a term counts by where it stands: in the file's name, in a column's, in a value.
NAME, COLUMN, VALUE = 3, 2, 1
#: Digits of a number up to which it can name something, as a year does.
DIGITS = 4


def _words(spark: SparkSession, path: str, kind: str, texts: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(texts, "col string, text string")
    return rows.select(F.lit(path).alias("path"), "col", F.lit(kind).alias("kind"), F.explode(F.array_distinct(T.topic_tokens(F.col("text")))).alias("term"), F.lit(1).cast("long").alias("n"))


def entries(df: DataFrame, path: str) -> DataFrame:
    """``path, col, kind, term, n`` of a table: terms of its name and columns, and those of its text values with the number
    of rows that have them. Numbers over ``DIGITS`` digits are figures and not names."""
    spark = df.sparkSession
    spelled = lambda s: s.replace("_", " ").replace("-", " ")
    out = _words(spark, path, "name", [("", spelled(path.rpartition(".")[0] or path))]).unionByName(_words(spark, path, "column", [(c, spelled(c)) for c in df.columns]))
    texts = [f.name for f in df.schema if isinstance(f.dataType, T_.StringType)]
    if texts:
        each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.array_distinct(T.topic_tokens(F.col(f"`{c}`"))).alias("terms")) for c in texts))).alias("x"))
        terms = each.select("x.col", F.explode("x.terms").alias("term")).where(f"term rlike '[a-z]' or length(term) <= {DIGITS}")
        found = terms.groupBy("col", "term").agg(F.count("*").alias("n"))
        out = out.unionByName(found.select(F.lit(path).alias("path"), "col", F.lit("value").alias("kind"), "term", "n"))
    return out


class ValueIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.log = CommitLog(spark, root, SCHEMA, "path", order=("term", "path"))

    def refresh(self, tables: dict[str, DataFrame]) -> None:
        """The entries of these tables replace those of the same paths."""
        rows = None
        for path, df in tables.items():
            rows = entries(df, path) if rows is None else rows.unionByName(entries(df, path))
        if rows is not None:
            self.log.upsert(rows)

    def remove(self, paths: DataFrame) -> None:
        self.log.delete(paths)

    def route_each(self, questions: DataFrame, n: int = 3, within: Column | None = None) -> DataFrame:
        """``question_id, rank, path, score, columns`` of ``questions (question_id, question)``: the ``n`` tables whose
        names, columns and values share rare terms with the question, and the columns that hold its values."""
        rows = self.log.read()
        rows = rows.where(within) if within is not None else rows
        asked = questions.select("question_id", F.explode(F.array_distinct(T.topic_tokens(F.col("question")))).alias("term"))
        few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        if asked.limit(1000).count() < 1000:  # few terms are looked up where they lie
            rows_of = rows.where(F.col("term").isin([r["term"] for r in asked.select("term").distinct().collect()]))
        else:
            rows_of = rows
        weight = F.when(F.col("kind") == "name", NAME).when(F.col("kind") == "column", COLUMN).otherwise(VALUE)
        per_path = rows_of.groupBy("term", "path").agg(F.max(weight).alias("weight"), F.sort_array(F.collect_set(F.when(F.col("kind") == "value", F.col("col")))).alias("columns"))
        total = rows.agg(F.count_distinct("path").alias("tables"))  # one row
        idf = per_path.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total), how="cross").select("term", F.log(1 + F.col("tables") / F.col("df")).alias("idf"))
        hits = per_path.join(idf, "term").join(F.broadcast(asked) if few else asked, "term")
        scored = hits.groupBy("question_id", "path").agg(F.sum(F.col("idf") * F.col("weight")).alias("score"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "path"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("question_id", "rank", "path", "score", "columns")

    def route(self, question: str, n: int = 3, within: Column | None = None) -> list[str]:
        rows = self.spark.createDataFrame([(0, question)], "question_id int, question string")
        return [r["path"] for r in self.route_each(rows, n, within).orderBy("rank").collect()]
