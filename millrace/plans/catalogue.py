"""Queries over the driver's tables, with their SQL equivalents for DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import analyst, digest, folders, gates, index, logs, profile, routing, search, summaries
from ..sources import postings
from ..streaming import events
from . import api, planner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# ---- the sales table -------------------------------------------------------------------------------------------------

SALES = """sales AS (
  SELECT c_name AS customer_name, c_mktsegment AS segment, r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS order_year,
         'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS order_quarter, o_totalprice AS revenue, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SUM = "CAST(sum(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE)"


def sales(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation, region = (read(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 and 5 rows at any scale
    clients = customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey)
    at = F.col("o_orderdate")
    return orders.join(clients, orders.o_custkey == clients.c_custkey).select(
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.year(at).alias("order_year"),
        F.concat(F.lit("Q"), F.quarter(at).cast("string"), F.lit(" "), F.year(at).cast("string")).alias("order_quarter"),
        F.col("o_totalprice").alias("revenue"),
        F.col("o_orderstatus").alias("status"),
    )


@query(f"WITH {SALES} SELECT coalesce({SUM}, 0) AS total, count(*) AS n_rows FROM sales")
def analyst_total(spark, d):
    return analyst.total(sales(spark, d), "revenue")


@query(f"WITH {SALES} SELECT coalesce({SUM}, 0) AS total, count(*) AS n_rows FROM sales WHERE order_year = 1997")
def analyst_total_year(spark, d):
    return analyst.total(analyst.restrict(sales(spark, d), "order_year", analyst.Period((1997,))), "revenue")


@query(f"WITH {SALES} SELECT coalesce({SUM}, 0) AS total, count(*) AS n_rows FROM sales WHERE order_quarter = 'Q2 1996'")
def analyst_quarter_label_filter(spark, d):
    return analyst.total(analyst.restrict(sales(spark, d), "order_quarter", analyst.Period((1996,), (2,))), "revenue")


@query(f"WITH {SALES} SELECT coalesce({SUM}, 0) AS total, count(*) AS n_rows FROM sales WHERE lower(region) = 'asia'")
def analyst_entity_filter(spark, d):
    return analyst.total(analyst.restrict(sales(spark, d), entity_col="region", entity="Asia"), "revenue")


@query(
    f"""WITH {SALES}, g AS (SELECT customer_name AS key, {SUM} AS value FROM sales GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS rank, CAST(sum(CAST(value AS DECIMAL(28,4))) OVER () AS DOUBLE) AS s FROM g)
    SELECT rank, key, round(value, 2) AS value, round(100 * value / s, 4) AS share_pct FROM r WHERE rank <= 10"""
)
def analyst_top_customers(spark, d):
    return analyst.top(sales(spark, d), "revenue", "customer_name", 10)


@query(
    f"""WITH {SALES}, g AS (SELECT segment AS key, {SUM} AS value, count(*) AS n_rows FROM sales GROUP BY 1)
    SELECT key, round(value, 2) AS value, n_rows, count(*) OVER () AS n_groups FROM g ORDER BY value DESC, key LIMIT 25"""
)
def analyst_breakdown_segment(spark, d):
    return analyst.breakdown(sales(spark, d), "revenue", "segment")


def _trend_sql(column: str, order: str) -> str:
    return f"""WITH {SALES}, g AS (SELECT CAST({column} AS VARCHAR) AS period, {SUM} AS value FROM sales GROUP BY 1),
    w AS (SELECT *, row_number() OVER o AS nth, lag(value) OVER o AS b FROM g WINDOW o AS (ORDER BY {order}))
    SELECT nth, period, round(value, 2) AS value, round(value - b, 2) AS delta, round(100 * (value - b) / nullif(b, 0), 2) AS delta_pct FROM w"""


@query(_trend_sql("order_year", "period"))
def analyst_trend_year(spark, d):
    return analyst.trend(sales(spark, d), "revenue", "order_year")


@query(_trend_sql("order_quarter", "period[4:], period"))
def analyst_trend_quarter(spark, d):
    return analyst.trend(sales(spark, d), "revenue", "order_quarter")


@query(
    f"""WITH {SALES}, g AS (SELECT CAST(order_year AS VARCHAR) AS period, round({SUM}, 2) AS value FROM sales GROUP BY 1),
    e AS (SELECT min(period) AS first_period, max(period) AS last_period, arg_min(value, period) AS first_value, arg_max(value, period) AS last_value FROM g)
    SELECT *, round(last_value - first_value, 2) AS change, round(100 * (last_value - first_value) / nullif(first_value, 0), 2) AS change_pct FROM e"""
)
def analyst_overall_change(spark, d):
    return analyst.overall_change(sales(spark, d), "revenue", "order_year")


@query(
    f"""WITH {SALES}, l AS (SELECT max(order_year) AS y FROM sales)
    SELECT customer_name AS entity, CAST(l.y AS VARCHAR) AS latest_period, round({SUM}, 2) AS lost_value FROM sales, l
    GROUP BY customer_name, l.y HAVING max(order_year) < l.y"""
)
def analyst_attrition(spark, d):
    return analyst.attrition(sales(spark, d), "customer_name", "order_year", "revenue")


@query(
    f"""WITH {SALES}, a AS (SELECT CAST(order_year AS VARCHAR) AS period, {SUM} AS v FROM sales WHERE status = 'F' GROUP BY 1),
    b AS (SELECT CAST(order_year AS VARCHAR) AS period, {SUM} AS v FROM sales WHERE status = 'O' GROUP BY 1)
    SELECT coalesce(a.period, b.period) AS period, round(coalesce(a.v, 0), 2) AS value_a, round(coalesce(b.v, 0), 2) AS value_b,
      round(coalesce(b.v, 0) - coalesce(a.v, 0), 2) AS delta, round(100 * (coalesce(b.v, 0) - coalesce(a.v, 0)) / nullif(coalesce(a.v, 0), 0), 2) AS delta_pct,
      a.v IS NULL AS missing_a, b.v IS NULL AS missing_b FROM a FULL JOIN b ON a.period = b.period"""
)
def analyst_compare_status(spark, d):
    t = sales(spark, d)
    return analyst.compare(t.where("status = 'F'"), t.where("status = 'O'"), "revenue", "order_year")


@query(
    f"""WITH {SALES}, g AS (SELECT customer_name AS key, {SUM} AS value FROM sales GROUP BY 1),
    r AS (SELECT value, row_number() OVER (ORDER BY value, key) AS r, count(*) OVER () AS n FROM g WHERE value > 0)
    SELECT count(*) AS n_groups, round(2 * sum(r * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*), 6) AS gini,
      round(100 * sum(CASE WHEN r > n - ceil(n / 5) THEN value END) / sum(value), 4) AS top_fifth_pct FROM r"""
)
def ext_gini(spark, d):
    return analyst.gini(sales(spark, d), "revenue", "customer_name")


@query(
    f"""WITH {SALES}, g AS (SELECT customer_name AS key, {SUM} AS value FROM sales GROUP BY 1),
    s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM g)
    SELECT key, round(value, 2) AS value, round((value - m) / nullif(sd, 0), 4) AS z FROM g, s
    WHERE abs((value - m) / nullif(sd, 0)) > 3 OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
)
def ext_outliers(spark, d):
    return analyst.outliers(sales(spark, d), "revenue", "customer_name")


@query(
    f"""WITH {SALES}, e AS (SELECT min(order_year) AS a, max(order_year) AS b FROM sales),
    g AS (SELECT customer_name AS key, coalesce(CAST(sum(CASE WHEN order_year = a THEN CAST(revenue AS DECIMAL(28,4)) END) AS DOUBLE), 0) AS f,
      coalesce(CAST(sum(CASE WHEN order_year = b THEN CAST(revenue AS DECIMAL(28,4)) END) AS DOUBLE), 0) AS l FROM sales, e GROUP BY 1)
    SELECT key, round(f, 2) AS first_value, round(l, 2) AS last_value, round(l - f, 2) AS change FROM g ORDER BY change DESC, key LIMIT 10"""
)
def ext_fastest_growth(spark, d):
    return analyst.fastest_growth(sales(spark, d), "revenue", "customer_name", "order_year")


@query(f"WITH {SALES} SELECT region AS key, count(DISTINCT customer_name) AS n_customers, count(DISTINCT order_quarter) AS n_quarters FROM sales GROUP BY 1")
def ext_distinct_counts(spark, d):
    return sales(spark, d).groupBy(F.col("region").alias("key")).agg(F.count_distinct("customer_name").alias("n_customers"), F.count_distinct("order_quarter").alias("n_quarters"))


# ---- profiles and digests --------------------------------------------------------------------------------------------

_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, nullif(trim(CAST({c} AS VARCHAR)), '') AS v FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
)


@query(
    f"""SELECT name, count(*) AS n_rows, count(*) - count(v) AS n_nulls, round((count(*) - count(v)) / count(*), 3) AS null_rate, count(DISTINCT v) AS cardinality,
    round(count(TRY_CAST(v AS DOUBLE)) / nullif(count(v), 0), 4) AS numeric_ratio,
    CAST(sum(CAST(TRY_CAST(v AS DOUBLE) AS DECIMAL(28,4))) AS DOUBLE) AS numeric_total, max(length(v)) AS longest, min(v) AS least, max(v) AS greatest
    FROM ({_CELLS}) GROUP BY name"""
)
def profile_columns(spark, d):
    stats = profile.column_stats(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    return stats.drop("mean").withColumn("numeric_ratio", F.round("numeric_ratio", 4))


@query(f"WITH {SALES} SELECT min(CAST(order_year AS VARCHAR)) AS least, max(CAST(order_year AS VARCHAR)) AS greatest, count(DISTINCT order_year) AS n_periods FROM sales")
def profile_time_range(spark, d):
    y = S.label(F.col("order_year"))
    return sales(spark, d).agg(F.min(y).alias("least"), F.max(y).alias("greatest"), F.count_distinct("order_year").alias("n_periods"))


@query(
    """WITH c AS (SELECT 'text' AS name, nullif(trim(CASE WHEN lang = 'de' THEN '' ELSE source END), '') AS v FROM documents
      UNION ALL SELECT 'mostly_missing', CASE WHEN lang = 'en' THEN NULL ELSE lang END FROM documents)
    SELECT name, round((count(*) - count(v)) / count(*), 3) AS null_rate, (count(*) - count(v)) / count(*) > 0.5 AS warn_missing FROM c GROUP BY name"""
)
def profile_warnings(spark, d):
    docs = read(spark, d, "documents")
    stats = profile.column_stats(docs.select(F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("text"), F.when(F.col("lang") != "en", F.col("lang")).alias("mostly_missing")))
    return stats.select("name", "null_rate", (F.col("n_nulls") / F.col("n_rows") > 0.5).alias("warn_missing"))


@query(
    f"""WITH {SALES}, g AS (
      SELECT 'region' AS dimension, region AS key, {SUM} AS value, count(*) AS n_rows FROM sales GROUP BY region
      UNION ALL SELECT 'segment', segment, {SUM}, count(*) FROM sales GROUP BY segment
      UNION ALL SELECT 'order_year', CAST(order_year AS VARCHAR), {SUM}, count(*) FROM sales GROUP BY order_year
      UNION ALL SELECT 'TOTAL', NULL, {SUM}, count(*) FROM sales)
    SELECT dimension, key, round(value, 2) AS value, n_rows FROM g"""
)
def digest_grouping_sets(spark, d):
    return digest.totals_by_dimension(sales(spark, d), "revenue", ["region", "segment", "order_year"])


@query(
    """WITH c AS (SELECT 'l_quantity' AS metric, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
    SELECT metric, round(CAST(sum(CAST(x AS DECIMAL(28,4))) AS DOUBLE), 2) AS total, count(x) AS n_values, max(abs(x)) AS max_abs FROM c GROUP BY 1"""
)
def digest_totals_counts_maxabs(spark, d):
    return digest.metric_summary(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    """WITH g AS (SELECT l_returnflag || l_linestatus AS key, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,4))) AS DOUBLE) AS e,
      CAST(sum(CAST(CASE WHEN l_returnflag <> 'R' OR l_linenumber > 3 THEN l_extendedprice ELSE 0 END AS DECIMAL(28,4))) AS DOUBLE) AS r FROM lineitem GROUP BY 1)
    SELECT key, round(e, 2) AS expired, round(r, 2) AS renewed, round(100 * r / nullif(e, 0), 4) AS rate_pct FROM g"""
)
def digest_renewal_rate(spark, d):
    renewed = F.when((F.col("l_returnflag") != "R") | (F.col("l_linenumber") > 3), F.col("l_extendedprice")).otherwise(0.0)
    lines = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("status"), F.col("l_extendedprice").alias("expired_value"), renewed.alias("renewed_value"))
    return digest.renewal_rate(lines, "expired_value", "renewed_value", "status")


@query(
    """SELECT 'p' AS a, 'q' AS b, count(*) FILTER (l_extendedprice IS DISTINCT FROM l_extendedprice * 1) = 0 AS twins FROM lineitem
    UNION ALL SELECT 'p', 'r', count(*) FILTER (l_extendedprice IS DISTINCT FROM l_quantity) = 0 FROM lineitem
    UNION ALL SELECT 'q', 'r', count(*) FILTER (l_extendedprice IS DISTINCT FROM l_quantity) = 0 FROM lineitem"""
)
def digest_twin_metrics(spark, d):
    lines = read(spark, d, "lineitem").selectExpr("l_extendedprice as p", "l_extendedprice * 1 as q", "l_quantity as r")
    return digest.twins(lines, ["p", "q", "r"])


@query(
    """WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
    c AS (SELECT count(DISTINCT code) AS c, count(DISTINCT name) AS n, count(DISTINCT region) AS r, count(DISTINCT (code, name)) AS cn,
      count(DISTINCT (code, region)) AS cr, count(DISTINCT (name, region)) AS nr FROM t)
    SELECT 'code' AS a, 'name' AS b, cn = c AND cn = n AS same_partition FROM c UNION ALL SELECT 'code', 'region', cr = c AND cr = r FROM c
    UNION ALL SELECT 'name', 'region', nr = n AND nr = r FROM c"""
)
def digest_fd_breakdowns(spark, d):
    t = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return digest.same_partition(t.selectExpr("n_nationkey as code", "n_name as name", "r_name as region"), ["code", "name", "region"])


@query(
    """WITH v AS (SELECT DISTINCT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders UNION SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders)
    SELECT "column", count(*) AS n_values, string_agg(value, '|' ORDER BY value) AS listing FROM v GROUP BY 1"""
)
def digest_distinct_values(spark, d):
    return digest.distinct_values(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    """WITH v AS (SELECT lower(trim(p_type)) AS keyword, min(p_partkey) AS position FROM part WHERE length(trim(p_type)) >= 3 GROUP BY 1)
    SELECT row_number() OVER (ORDER BY position, keyword) AS nth, keyword FROM v ORDER BY position, keyword LIMIT 25"""
)
def digest_keywords(spark, d):
    return digest.keywords(read(spark, d, "part").selectExpr("p_type as value", "p_partkey as position"))


@query(
    """SELECT metric, round(total, 2) AS total, n_values, max_abs FROM (
      SELECT 'revenue ($M)' AS metric, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) AS total, count(*) AS n_values, max(abs(o_totalprice)) AS max_abs FROM orders)
    WHERE max_abs >= 100000"""
)
def digest_unit_check(spark, d):
    t = read(spark, d, "orders").select(F.col("o_totalprice").alias("revenue ($M)"))
    return digest.implausible_units(t, ["revenue ($M)"])


# ---- documents -------------------------------------------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id, lang AS domain, source AS name, lang || '/' || source || '/' || doc_id AS path, text FROM documents)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return read(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("source").alias("name"), path.alias("path"), "text")


_CHUNKS = """c AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 3500 THEN 1 ELSE 1 + CAST(ceil((length(text) - 3500) / 3300.0) AS INTEGER) END AS chunk_total FROM documents),
    e AS (SELECT doc_id, chunk_total, unnest(range(0, chunk_total)) AS i, text FROM c)"""


@query(f"WITH {_CHUNKS} SELECT doc_id || '::chunk_' || i AS chunk_id, CAST(length(substring(text, CAST(i * 3300 + 1 AS BIGINT), 3500)) AS BIGINT) AS n_chars, md5(substring(text, CAST(i * 3300 + 1 AS BIGINT), 3500)) AS digest FROM e")
def doc_chunks(spark, d):
    pieces = search.chunk(docs(spark, d), cap=None)
    return pieces.select("chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    """WITH c AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 350 THEN 1 ELSE 1 + CAST(ceil((length(text) - 350) / 330.0) AS INTEGER) END AS t FROM documents),
    e AS (SELECT doc_id, t, unnest(range(0, t)) AS i FROM c)
    SELECT doc_id, count(*) AS n_kept, sum(i)::BIGINT AS sum_kept FROM e
    WHERE t <= 10 OR i < 3 OR i >= t - 3 OR (i >= (t - 4) // 2 AND i < (t - 4) // 2 + 4) GROUP BY 1"""
)
def doc_chunk_cap(spark, d):
    pieces = search.chunk(docs(spark, d), size=350, overlap=20, cap=10)
    return pieces.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum("chunk_index").alias("sum_kept"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents")
def doc_tokens(spark, d):
    t = T.search_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1"""
)
def doc_term_stats(spark, d):
    return search.term_stats(search.terms(read(spark, d, "documents"), "doc_id", F.col("text")))


@query(
    """WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
    g AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM g)
    SELECT lang, rank, token, n FROM r WHERE rank <= 6"""
)
def doc_top_terms(spark, d):
    tokens = read(spark, d, "documents").select("lang", F.explode(T.search_tokens(F.col("text"))).alias("token"))
    return index.top_terms(tokens, "lang", 6).select("lang", "rank", "token", "n")


@query(
    r"""WITH s AS (SELECT doc_id, unnest([trim(x) FOR x IN regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF length(trim(x)) > 20]) AS s FROM documents)
    SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM s GROUP BY 1"""
)
def doc_sentences(spark, d):
    each = read(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).cast("long").alias("longest"))


# ---- answers ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {SALES}, p AS (SELECT customer_name AS k, order_year AS y, {SUM} AS v FROM sales GROUP BY ALL), l AS (SELECT max(y) AS y FROM p)
    SELECT 'attrition' AS plan, CAST(count(*) AS BIGINT) AS total, count(*) || ' customer_name are missing from the latest order_year.' AS answer
    FROM (SELECT k FROM p GROUP BY k HAVING max(y) < (SELECT y FROM l))"""
)
def answer_attrition(spark, d):
    """What the planner answers: the count takes all lost customers, however few are shown."""
    return answered(spark, d, "which customers churned", {"group": "customer_name", "time": "order_year", "metric": "revenue"})


@query(
    f"""WITH {SALES} SELECT 'total' AS plan, CAST(1 AS BIGINT) AS total,
    'Total revenue: $' || format('{{:.2f}}', {SUM} / 1e6) || 'M over ' || count(*) || ' rows.' AS answer FROM sales WHERE lower(region) = 'asia' AND order_year = 1996"""
)
def answer_total_entity(spark, d):
    return answered(spark, d, "total revenue in 1996", {"metric": "revenue", "time": "order_year", "entity": ("region", "Asia")})


def answered(spark: SparkSession, d: str, question: str, params: dict) -> DataFrame:
    """A question's answer over the sales table as a row."""
    df = sales(spark, d)
    card = profile.card(df, "sales")
    plan = planner.plan(question, card, params)
    out = api.answer(df, plan, card)
    return spark.createDataFrame([(plan.operation, out["total"], out["answer"])], "plan string, total long, answer string")


# ---- retrieval -------------------------------------------------------------------------------------------------------

QUESTION = "thation onst ther heon the"

_BM25 = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(source || ' ' || text), '[a-z0-9]+')) AS term FROM documents),
    sizes AS (SELECT doc_id, len(regexp_extract_all(lower(source || ' ' || text), '[a-z0-9]+')) AS dl FROM documents),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
    post AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    stats AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, corpus GROUP BY term, n),
    flr AS (SELECT 0.25 * avg(idf) AS f FROM stats),
    q AS (SELECT term, count(*) AS qf FROM (SELECT unnest(regexp_extract_all('{q}', '[a-z0-9]+')) AS term) GROUP BY 1),
    raw AS (SELECT p.doc_id, sum(qf * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
      FROM post p JOIN q USING (term) JOIN stats USING (term) JOIN sizes USING (doc_id), flr, corpus GROUP BY 1),
    bm AS (SELECT doc_id, s / max(s) OVER () AS score FROM raw WHERE s > 0 ORDER BY round(s / max(s) OVER (), 9) DESC, doc_id LIMIT {n})"""
_ENGLISH = "FROM documents WHERE lang = 'en'"
_COS = """cosines AS (SELECT v.vec_id AS doc_id, greatest(0, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))) AS score
      FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    cs AS (SELECT * FROM cosines ORDER BY round(score, 9) DESC, doc_id LIMIT {n})"""


_built: dict[tuple, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share; a local one only on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def state_of(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do."""
    return tuple(spark.read.format("binaryFile").load(path).agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def built_postings(spark: SparkSession, d: str) -> str:
    """The postings of ``documents`` by language, built for the first question of an application and kept for others until
    a file of the table changes."""
    key = (spark.sparkContext.applicationId, d, *state_of(spark, f"{d}/documents.parquet"))
    if key not in _built:
        folder = scratch(spark, "millrace-postings")
        rows = read(spark, d, "documents")
        scope = F.coalesce("lang", F.lit("none")) if "lang" in rows.columns else F.lit("none")
        postings.build(rows, "doc_id", F.concat_ws(" ", "source", "text"), folder, scope)
        _built[key] = folder
    return _built[key]


def lexical(spark: SparkSession, d: str, n: int) -> DataFrame:
    return postings.bm25(spark, built_postings(spark, d), QUESTION, "doc_id", "long", n)


def vectors(spark: SparkSession, d: str, n: int) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.nearest(v, v.where("doc_id = 0"), "doc_id", "embedding", n)


@query(f"WITH {_BM25.format(q=QUESTION, n=10)} SELECT doc_id, round(score, 6) AS score FROM bm")
def search_bm25(spark, d):
    return lexical(spark, d, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25.format(q=QUESTION, n=10)} SELECT doc_id, round(score, 6) AS score FROM bm")
def search_bm25_postings(spark, d):
    return postings.bm25(spark, built_postings(spark, d), QUESTION, "doc_id", "long", 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25.format(q=QUESTION, n=10).replace('FROM documents', _ENGLISH)} SELECT doc_id, round(score, 6) AS score FROM bm")
def search_bm25_domain(spark, d):
    """BM25 within one language as the domain that a question was routed to; statistics are that domain's own."""
    return postings.bm25(spark, built_postings(spark, d), QUESTION, "doc_id", "long", 10, "en").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_COS.format(n=10)} SELECT doc_id, round(score, 6) AS score FROM cs")
def search_cosine(spark, d):
    return vectors(spark, d, 10).select("doc_id", F.round("score", 6).alias("score"))


_FUSED = """ranks AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) FROM cs),
    fused AS (SELECT doc_id, least(1, sum(1.0 / (60 + r)) * 61 / 2) AS score FROM ranks GROUP BY 1)"""


@query(f"WITH {_BM25.format(q=QUESTION, n=20)}, {_COS.format(n=20)}, {_FUSED} SELECT doc_id, round(score, 6) AS score FROM fused ORDER BY round(fused.score, 9) DESC, doc_id LIMIT 10")
def search_rrf(spark, d):
    return search.fuse(vectors(spark, d, 20), lexical(spark, d, 20), "doc_id", 10).select("doc_id", F.round("score", 6).alias("score"))


_WEIGHTS = "weights AS (SELECT doc_id, 0.5 + 0.5 * avg(quality) + 0.25 * avg(toxic) AS weight FROM labels GROUP BY 1)"


@query(
    f"""WITH {_BM25.format(q=QUESTION, n=20)}, {_COS.format(n=20)}, {_FUSED}, {_WEIGHTS},
    top AS (SELECT * FROM fused ORDER BY round(score, 9) DESC, doc_id LIMIT 20)
    SELECT doc_id, round(least(1, greatest(0, score * coalesce(weight, 1))), 6) AS score FROM top LEFT JOIN weights USING (doc_id)"""
)
def search_hybrid_weighted(spark, d):
    hits = search.fuse(vectors(spark, d, 20), lexical(spark, d, 20), "doc_id", 20)
    weights = read(spark, d, "labels").join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi")
    weights = weights.groupBy("doc_id").agg((0.5 + 0.5 * F.avg("quality") + 0.25 * F.avg("toxic")).alias("weight"))
    return search.weigh(hits, weights, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT doc_id, (CAST(contains(lower(text), 'heon') AS INTEGER) + CAST(contains(lower(text), 'onst') AS INTEGER) + CAST(contains(lower(text), 'zupfpf') AS INTEGER)) / 3.0 AS score FROM documents)
    SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 10"""
)
def search_keyword_fallback(spark, d):
    hits = search.keyword_fallback(read(spark, d, "documents"), "heon onst zupfpf", "doc_id", F.col("text"))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP)


def _topic_sql(c: str) -> str:
    kept = f"NOT list_contains([{_STOPS}], x) AND (length(x) >= 3 OR regexp_matches(x, '[0-9]'))"
    return f"[CASE WHEN length(x) > 3 AND regexp_matches(x, '[^s]s$') THEN x[:-2] ELSE x END FOR x IN regexp_extract_all(lower({c}), '[a-z0-9]+') IF {kept}]"


@query(
    f"""WITH t AS (SELECT doc_id, 'n' AS w, unnest({_topic_sql('source')}) AS term FROM documents UNION ALL SELECT doc_id, 'k', unnest({_topic_sql('substring(text, 1, 80)')}) FROM documents
      UNION ALL SELECT doc_id, 'b', unnest({_topic_sql('text')}) FROM documents),
    per AS (SELECT doc_id, term, count(*) FILTER (w = 'n') AS a, count(*) FILTER (w = 'k') AS k, count(*) FILTER (w = 'b') AS b FROM t GROUP BY ALL),
    q AS (SELECT DISTINCT unnest({_topic_sql("'ther onst thation src3'")}) AS term), m AS (SELECT per.* FROM per JOIN q USING (term)),
    i AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM m GROUP BY 1),
    s AS (SELECT doc_id, sum(idf * (3 * (a > 0)::INT + 2 * (k > 0)::INT + least(b, 3))) AS score FROM m JOIN i USING (term) GROUP BY 1)
    SELECT doc_id, round(score, 6) AS score FROM s WHERE score >= 2 AND score >= 0.5 * (SELECT max(score) FROM s) ORDER BY round(s.score, 9) DESC, doc_id LIMIT 3"""
)
def search_digest_rank(spark, d):
    """Documents as digests: a made input, whose keyword field is what a text begins with; the body is the whole text."""
    hits = search.rank_digests(read(spark, d, "documents"), "ther onst thation src3", "doc_id", F.col("source"), F.substring("text", 1, 80), F.col("text"))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_COS.format(n=10)}, p AS (SELECT vec_id AS doc_id FROM embeddings WHERE vec_id IN (3, 5)),
    u AS (SELECT doc_id, 1.0 AS score, 0 AS tier FROM p UNION ALL SELECT doc_id, score, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END FROM cs WHERE doc_id NOT IN (SELECT doc_id FROM p))
    SELECT row_number() OVER (ORDER BY tier, round(score, 9) DESC, doc_id) AS place, doc_id, round(score, 6) AS score, tier FROM u"""
)
def search_pins_boosts(spark, d):
    pins = read(spark, d, "embeddings").where("vec_id in (3, 5)").selectExpr("vec_id as doc_id")
    return search.pin(vectors(spark, d, 10), pins, F.col("doc_id") % 2 == 0, "doc_id").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_COS.format(n=10)}, l AS (SELECT label, doc_id, score, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cosines JOIN embeddings ON vec_id = doc_id)
    SELECT label, doc_id, round(score, 6) AS score, rank FROM l WHERE rank <= 3"""
)
def search_per_domain_topk(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    q = F.broadcast(v.where("doc_id = 0").select(F.col("embedding").alias("q")))
    hits = v.crossJoin(q).select("label", "doc_id", F.greatest(F.lit(0.0), S.cosine(F.col("embedding"), F.col("q"))).alias("score"))
    return search.best_per_domain(hits, "label", "doc_id").select("label", "doc_id", F.round("score", 6).alias("score"), "rank")


# ---- routing and merging ---------------------------------------------------------------------------------------------

KEYWORDS = [("people", "ther"), ("people", "heon"), ("places", "onst"), ("places", "ther"), ("things", "tion"), ("things", "heit")]
_KW = "kw(domain, keyword) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in KEYWORDS) + ")"
_HITS = f"""{_KW}, hits AS (SELECT item_id AS question_id, domain, count(DISTINCT keyword) AS hits FROM benchmark JOIN kw
    ON regexp_matches(lower(text), '(^|[^a-z0-9])' || keyword || '(e?s)?([^a-z0-9]|$)') GROUP BY ALL)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").selectExpr("item_id as question_id", "text as question")


def keyword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "domain string, keyword string")


@query(f"WITH {_HITS} SELECT * FROM hits")
def route_keyword_hits(spark, d):
    return routing.keyword_hits(questions(spark, d), keyword_table(spark))


@query(
    f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(hits) OVER w, 0) AS runner_up FROM hits WINDOW w AS (PARTITION BY question_id ORDER BY hits DESC, domain))
    SELECT question_id, domain, hits, runner_up, hits >= 2 AND hits >= 3 * runner_up AS confident FROM r WHERE r = 1"""
)
def route_dominance(spark, d):
    return routing.dominance(routing.keyword_hits(questions(spark, d), keyword_table(spark)))


@query(
    f"""WITH {_HITS}, s AS (SELECT question_id, domain, CAST(hits AS DOUBLE) AS score FROM hits),
    r AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS best, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, domain) AS rank FROM s)
    SELECT question_id, domain, score, rank FROM r WHERE score > 0 AND score >= 0.75 * best AND rank <= 2"""
)
def route_content(spark, d):
    hits = routing.keyword_hits(questions(spark, d), keyword_table(spark))
    return routing.fan_out(hits.select("question_id", "domain", F.col("hits").cast("double").alias("score")))


@query(f"WITH {_KW} SELECT min(domain) AS domain, keyword FROM kw GROUP BY keyword HAVING count(DISTINCT domain) = 1")
def keyword_ownership(spark, d):
    return routing.owned_keywords(keyword_table(spark))


_ANSWERS = "answers AS (SELECT role || '-' || conv_id AS domain, text || ' total revenue is ' || (conv_id % 7) || '00.' AS answer FROM conversations)"


@query(
    rf"""WITH {_ANSWERS}, f AS (SELECT domain, unnest(regexp_extract_all(lower(answer), '(?:[a-z]+\s+){{2}}(?:is|was|are|were|of|:)?\s*\$?[0-9][0-9,.]*')) AS s FROM answers),
    v AS (SELECT DISTINCT domain, regexp_replace(regexp_extract(s, '^([a-z]+\s+[a-z]+)', 1), '\s+', ' ', 'g') AS subject, regexp_replace(regexp_extract(s, '([0-9][0-9,.]*)$', 1), '[,.]+$|,', '', 'g') AS value FROM f)
    SELECT subject, count(DISTINCT domain) AS n_domains, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS values FROM v
    WHERE subject <> '' AND value <> '' GROUP BY 1 HAVING count(DISTINCT domain) > 1 AND count(DISTINCT value) > 1"""
)
def merge_conflicts(spark, d):
    every = read(spark, d, "conversations").selectExpr("concat(role, '-', conv_id) as domain", "concat(text, ' total revenue is ', conv_id % 7, '00.') as answer")
    return routing.conflicts(every)


@query(
    r"""WITH a AS (SELECT doc_id AS domain, text AS answer FROM documents),
    s AS (SELECT domain, [trim(x) FOR x IN regexp_split_to_array(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF length(trim(x)) > 20] AS l FROM a),
    e AS (SELECT domain, unnest(range(0, len(l))) AS nth, unnest(l) AS sentence FROM s),
    w AS (SELECT domain, nth, sentence, unnest(list_distinct(regexp_extract_all(lower(sentence), '[a-z]{4,}'))) AS word FROM e),
    o AS (SELECT word, count(DISTINCT domain) AS n FROM (SELECT domain, unnest(regexp_extract_all(lower(answer), '[a-z]{4,}')) AS word FROM a) GROUP BY 1),
    c AS (SELECT domain, nth, sentence, count(*) FILTER (n = 1) AS n_new FROM w JOIN o USING (word) GROUP BY ALL HAVING count(*) FILTER (n = 1) >= 3)
    SELECT domain, arg_min(sentence, nth) AS sentence, arg_min(n_new, nth) AS n_new FROM c GROUP BY 1"""
)
def merge_complementary(spark, d):
    """Each document is an answer of its own."""
    return routing.complementary(read(spark, d, "documents").selectExpr("doc_id as domain", "text as answer"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(source || ' ' || text), '[a-z0-9]+')) AS term FROM documents),
    sizes AS (SELECT doc_id, len(regexp_extract_all(lower(source || ' ' || text), '[a-z0-9]+')) AS dl FROM documents),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
    post AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    stats AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, corpus GROUP BY term, n),
    flr AS (SELECT 0.25 * avg(idf) AS f FROM stats),
    q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
    raw AS (SELECT item_id, doc_id, sum(qf * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
      FROM post JOIN q USING (term) JOIN stats USING (term) JOIN sizes USING (doc_id), flr, corpus GROUP BY ALL),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS place FROM raw WHERE s > 0),
    h AS (SELECT item_id, text FROM r JOIN documents USING (doc_id) WHERE place <= 10),
    m AS (SELECT b.item_id, b.text AS fact, bool_or(coalesce(contains(lower(h.text), lower(b.text)), false)) AS found FROM benchmark b LEFT JOIN h ON h.item_id = b.item_id GROUP BY ALL)
    SELECT item_id AS question_id, count(*) AS n_facts, count(*) FILTER (found) AS n_found, round(count(*) FILTER (found) / count(*), 4) AS recall FROM m GROUP BY 1"""
)
def eval_recall(spark, d):
    """The recall of benchmark passages in the ten texts that BM25 over all documents gives for each."""
    facts = read(spark, d, "benchmark").selectExpr("item_id as question_id", "text as fact")
    hits = postings.bm25_each(spark, built_postings(spark, d), facts.withColumnRenamed("fact", "question"), "doc_id")
    return routing.recall(facts, hits.join(read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("question_id", "text"))


# ---- logs ------------------------------------------------------------------------------------------------------------

_AUDIT = "audit AS (SELECT user_id AS session_id, event_type AS question, event_type AS domain, ts, value AS latency_ms, event_type = 'error' AS blocked, event_id FROM events)"


def audit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr("user_id as session_id", "event_type as question", "event_type as domain", "ts", "value as latency_ms", "event_type = 'error' as blocked", "event_id")


@query(
    f"""WITH {_AUDIT} SELECT count(*) AS n_turns, count(*) FILTER (blocked) AS n_blocked, round(100 * count(*) FILTER (blocked) / nullif(count(*), 0), 2) AS blocked_pct,
    round(CAST(sum(CAST(latency_ms AS DECIMAL(28,4))) AS DOUBLE) / count(latency_ms), 2) AS mean_latency_ms, count(DISTINCT session_id) AS n_sessions FROM audit WHERE ts >= TIMESTAMP '2024-01-05'"""
)
def audit_summary(spark, d):
    return logs.audit_summary(audit(spark, d), F.lit("2024-01-05").cast("timestamp_ntz"))


@query(f"WITH {_AUDIT} SELECT question, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, question LIMIT 10")
def audit_top_questions(spark, d):
    return logs.top_questions(audit(spark, d))


@query(f"WITH {_AUDIT} SELECT domain, count(*) AS n, count(*) FILTER (blocked) AS n_blocked FROM audit GROUP BY 1")
def audit_domain_counts(spark, d):
    return logs.domain_counts(audit(spark, d))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_at, CAST(max(ts) AS VARCHAR) AS last_at FROM i GROUP BY user_id, island, event_type"""
)
def audit_coalesce(spark, d):
    out = logs.coalesce_repeats(read(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_at", "last_at")})


@query(
    """WITH r AS (SELECT least(5, greatest(1, 1 + 4 * quality - toxic)) AS rating FROM labels), s AS (SELECT unnest(range(1, 6)) AS rating), c AS (SELECT rating, count(*) AS n FROM r GROUP BY 1)
    SELECT CAST(s.rating AS BIGINT) AS rating, coalesce(n, 0) AS n, round(100 * coalesce(n, 0) / (SELECT count(*) FROM r), 2) AS share_pct FROM s LEFT JOIN c ON c.rating = s.rating"""
)
def feedback_summary(spark, d):
    return logs.feedback_summary(read(spark, d, "labels").selectExpr("1 + 4 * quality - toxic as rating"))


@query(
    """WITH f AS (SELECT source AS file, 1 + 4 * quality - toxic AS rating, doc_id % 90 AS ts FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT file, CAST(sum(CAST((least(5, rating) - 3) / 2.0 * (ts / 90.0) AS DECIMAL(28,12))) AS DOUBLE) AS s, count(*) AS n FROM f WHERE ts >= 0 GROUP BY 1)
    SELECT file, round(least(1.5, greatest(0.5, 1 + 0.5 * s / sqrt(n))), 6) AS weight, n FROM g"""
)
def feedback_weights(spark, d):
    rated = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    fb = rated.selectExpr("source as file", "least(5, 1 + 4 * quality - toxic) as rating", "cast(doc_id % 90 as double) as ts")
    return logs.feedback_weights(fb, "file", F.lit(0.0), F.lit(90.0))


@query("SELECT conv_id, count(*) // 2 AS turns, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1")
def sessions_list(spark, d):
    return logs.sessions(read(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def session_last_turns(spark, d):
    return logs.last_turns(read(spark, d, "conversations"), "conv_id", "turn", 1).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(
    """WITH m AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 7200000000 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT user_id, CAST(session AS BIGINT) AS session, CAST(min(ts) AS VARCHAR) AS started, CAST(max(ts) AS VARCHAR) AS ended, count(*) AS n FROM s GROUP BY user_id, session"""
)
def stream_sessions(spark, d):
    out = logs.session_windows(read(spark, d, "events"), "user_id", "ts")
    return out.withColumns({c: F.col(c).cast("string") for c in ("started", "ended")})


# ---- index and gates -------------------------------------------------------------------------------------------------

_FILES = f"{DOCS}, files AS (SELECT path, domain, name AS ext, length(text) AS length, doc_id AS mtime, md5(text) AS hash FROM docs), idx AS (SELECT path, domain, CASE WHEN mtime % 5 = 0 THEN md5(path) ELSE hash END AS hash FROM files WHERE mtime % 3 <> 0 UNION ALL SELECT path || '.old', domain, hash FROM files WHERE mtime % 50 = 0)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("path", "domain", F.col("name").alias("ext"), F.length("text").cast("long").alias("length"), F.col("doc_id").alias("mtime"), F.md5("text").alias("hash"))


def indexed(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    kept = f.where("mtime % 3 != 0").select("path", "domain", F.when(F.col("mtime") % 5 == 0, F.md5("path")).otherwise(F.col("hash")).alias("hash"))
    return kept.unionByName(f.where("mtime % 50 = 0").select(F.concat("path", F.lit(".old")).alias("path"), "domain", "hash"))


@query(
    f"""WITH {_FILES} SELECT coalesce(f.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'missing' WHEN f.path IS NULL THEN 'orphaned' WHEN f.hash <> i.hash THEN 'stale' ELSE 'ok' END AS state
    FROM files f FULL JOIN idx i ON f.path = i.path"""
)
def index_diff(spark, d):
    return index.diff(files(spark, d), indexed(spark, d))


@query(f"WITH {_FILES} SELECT path, hash FROM files WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.path = files.path AND idx.hash = files.hash)")
def index_changed(spark, d):
    return index.changed(files(spark, d), indexed(spark, d)).select("path", "hash")


@query(f"WITH {_FILES}, fresh AS (SELECT path, domain, hash FROM files WHERE mtime % 10 = 0) SELECT path, domain, hash FROM idx WHERE path NOT IN (SELECT path FROM fresh) UNION ALL SELECT path, domain, hash FROM fresh")
def index_upsert(spark, d):
    return index.upsert(indexed(spark, d), files(spark, d).where("mtime % 10 = 0").select("path", "domain", "hash"))


@query(f"WITH {_FILES} SELECT path, hash FROM idx WHERE path NOT IN (SELECT path FROM files)")
def sync_orphans(spark, d):
    return index.orphans(indexed(spark, d), files(spark, d)).select("path", "hash")


@query(
    f"""WITH {_FILES}, i AS (SELECT domain, min(mtime) + 300 AS indexed_at, count(*) AS n_indexed FROM files GROUP BY 1),
    g AS (SELECT domain, n_indexed, count(*) FILTER (mtime > indexed_at) AS n_new FROM files JOIN i USING (domain) GROUP BY ALL)
    SELECT *, n_new > greatest(1, floor(0.05 * n_indexed)) AS stale FROM g"""
)
def index_stale(spark, d):
    f = files(spark, d)
    return index.stale_domains(f, f.groupBy("domain").agg((F.min("mtime") + 300).alias("indexed_at"), F.count("*").alias("n_indexed")))


@query(f"WITH {_FILES} SELECT domain, count(*) AS n_files, CAST(sum(length) AS BIGINT) AS n_chars, count(*) FILTER (length = 0) AS n_empty, max(mtime) AS newest FROM files GROUP BY 1")
def domain_stats(spark, d):
    return index.domain_stats(files(spark, d))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def type_counts(spark, d):
    return index.type_counts(read(spark, d, "documents"), "source")


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id AS path, event_type AS hash FROM e WHERE r = 1 AND event_type <> 'error'"""
)
def sync_latest_wins(spark, d):
    events = read(spark, d, "events").selectExpr("user_id as path", "case when event_type = 'error' then 'deleted' else 'changed' end as kind", "ts", "event_id", "event_type as hash")
    return index.apply_events(events.select("path", "hash").limit(0), events)


@query(
    """WITH t AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN 'Internal use only. ' || text WHEN doc_id % 13 = 0 THEN 'This is RESTRICTED ' || text ELSE text END AS text FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'path: top secret' WHEN doc_id % 11 = 0 THEN 'body: internal use only' ELSE 'body: restricted' END AS reason FROM t WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0"""
)
def gate_confidential(spark, d):
    t = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("Internal use only. "), "text")).when(F.col("doc_id") % 13 == 0, F.concat(F.lit("This is RESTRICTED "), "text")).otherwise(F.col("text"))
    p = F.when(F.col("doc_id") % 17 == 0, F.lit("a/Top_Secret-plan.txt")).otherwise(F.lit("a/plan.txt"))
    return gates.confidential(read(spark, d, "documents").select("doc_id", t.alias("text"), p.alias("path"))).select("doc_id", "reason")


@query(
    r"""WITH s AS (SELECT lang, trim(CASE WHEN doc_id % 9 = 0 THEN substring(text, 1, 30) ELSE text END, E' ') AS t, doc_id FROM documents),
    c AS (SELECT lang, CASE WHEN doc_id % 10 = 0 THEN 'unsupported' WHEN length(t) + 2 * length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) < 40 THEN 'thin' ELSE 'ok' END AS status FROM s)
    SELECT lang, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'thin') AS n_thin, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'unsupported') AS n_unsupported FROM c GROUP BY 1"""
)
def gate_extraction_status(spark, d):
    """A made input: every ninth text is shortened first, so that there are thin ones among them."""
    t = read(spark, d, "documents").select("lang", "doc_id", F.when(F.col("doc_id") % 9 == 0, F.substring("text", 1, 30)).otherwise(F.col("text")).alias("text"))
    return gates.report(gates.statuses(t, supported=F.col("doc_id") % 10 != 0), "lang")


_STEM = "CASE WHEN t LIKE '%ing' AND length(t) >= 6 THEN t[:-4] WHEN t LIKE '%es' AND length(t) >= 5 THEN t[:-3] WHEN t LIKE '%s' AND length(t) >= 4 THEN t[:-2] ELSE t END"
_GATE = r"[x FOR x IN regexp_extract_all(lower({c}), '\p{{L}}+') IF length(x) <= 40 AND length(x) >= CASE WHEN regexp_full_match(x, '[a-z]+') THEN 3 ELSE 2 END]"


@query(
    f"""WITH a AS (SELECT item_id, unnest({_GATE.format(c='text')}) AS t FROM benchmark), c AS (SELECT DISTINCT item_id, {_STEM} AS token FROM a),
    b AS (SELECT unnest({_GATE.format(c='text')}) AS t FROM documents), k AS (SELECT DISTINCT {_STEM} AS token FROM b)
    SELECT item_id AS claim_id, count(*) AS n_claims, count(k.token) AS n_grounded, round(count(k.token) / count(*), 2) AS score FROM c LEFT JOIN k ON k.token = c.token GROUP BY 1"""
)
def gate_grounding(spark, d):
    """``gate_grounding`` against the documents of all languages."""
    corpus = read(spark, d, "documents").select(F.explode(F.transform(T.gate_tokens(F.col("text")), T.stem)).alias("token"))
    return routing.grounding(read(spark, d, "benchmark").selectExpr("item_id as claim_id", "text"), corpus)


# ---- streams -------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return events.source(spark, d, "events.parquet*", read(spark, d, "events").schema)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    name = f"millrace_{uuid.uuid4().hex}"
    return events.drain(stream, name, mode, scratch(stream.sparkSession, "millrace-stream"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    out = _drained(events.counts(_stream(spark, d), "ts", "event_type"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT count(DISTINCT event_id) AS n_events FROM events")
def stream_dedup(spark, d):
    once = _drained(events.unique(_stream(spark, d), "ts", ["event_id"], "30 days"), "append")
    return once.agg(F.count("*").alias("n_events"))


# ---- summaries and further scalars ----------------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT doc_id, unnest({_topic_sql('text')}) AS token FROM documents), g AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank FROM g) SELECT doc_id, token, n, rank FROM r WHERE rank <= 6"""
)
def summary_file_terms(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.lit("x/1.txt").alias("p"), "text")
    return summaries.file_terms(rows, "doc_id", F.col("p"), F.col("text")).select("doc_id", "token", "n", "rank")


@query(
    f"""WITH t AS (SELECT DISTINCT lang, doc_id, unnest({_topic_sql('text')}) AS token FROM documents), g AS (SELECT lang, token, count(*) AS n_files FROM t GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_files DESC, token) AS rank FROM g) SELECT * FROM r WHERE rank <= 12"""
)
def summary_domain_keywords(spark, d):
    tokens = read(spark, d, "documents").select("lang", "doc_id", F.explode(T.topic_tokens(F.col("text"))).alias("token"))
    return summaries.domain_keywords(tokens, "lang", "doc_id")


@query(
    """WITH g AS (SELECT lang, source AS folder, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, folder) AS rank FROM g)
    SELECT * FROM r WHERE rank <= 4"""
)
def summary_topic_folders(spark, d):
    return summaries.topic_folders(read(spark, d, "documents"), "lang", F.col("source"))


@query(
    """WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, doc_id FROM p WHERE i % CAST(ceil(n / 20) AS BIGINT) = 0"""
)
def summary_evidence_sample(spark, d):
    return summaries.sampled_evidence(read(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query(
    """WITH e AS (SELECT lang AS domain, 100 + length(lang) AS last FROM documents WHERE lang <> 'fr' GROUP BY 1)
    SELECT lang AS domain, count(*) FILTER (last IS NULL OR doc_id > last) AS n_newer FROM documents LEFT JOIN e ON lang = domain GROUP BY 1"""
)
def index_drift(spark, d):
    f = read(spark, d, "documents").select(F.col("lang").alias("domain"), F.col("doc_id").alias("mtime"))
    e = f.where("domain != 'fr'").select("domain", (100 + F.length("domain")).cast("long").alias("ts"))
    return summaries.drift(f, e)


@query("SELECT lang AS domain, source AS ext, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') GROUP BY ALL")
def index_not_digested(spark, d):
    return summaries.not_digested(read(spark, d, "documents").select(F.col("lang").alias("domain"), F.col("source").alias("ext")), ["src1", "src2", "src3"])


@query(
    r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, substring(sha256(p_name), 1, 8) AS hash,
    md5(p_name) AS digest, regexp_matches(p_name, '^.*ring.*$') AS is_ring, (p_size - 3) / 2.0 AS sentiment FROM part"""
)
def scalar_text(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", S.slug(F.concat_ws("/", "p_name", "p_type")).alias("slug"), S.answer_hash(F.col("p_name")).alias("hash"), F.md5("p_name").alias("digest"), S.glob_like(F.col("p_name"), "*ring*").alias("is_ring"), S.sentiment(F.col("p_size")).alias("sentiment"))


@query(
    """WITH t AS (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' What is the total revenue by region?' WHEN 1 THEN ' Compare both step by step.' WHEN 2 THEN ' Which files are there, as a table?' ELSE '' END AS q FROM benchmark)
    SELECT item_id, item_id % 4 = 0 AS data, item_id % 4 = 1 AS complex, item_id % 4 = 2 AS overview, CASE item_id % 4 WHEN 2 THEN 'table' END AS format FROM t"""
)
def scalar_questions(spark, d):
    tail = F.when(F.col("item_id") % 4 == 0, " What is the total revenue by region?").when(F.col("item_id") % 4 == 1, " Compare both step by step.").when(F.col("item_id") % 4 == 2, " Which files are there, as a table?").otherwise("")
    q = F.concat("text", tail)
    return read(spark, d, "benchmark").select("item_id", S.is_data(q).alias("data"), S.is_complex(q).alias("complex"), S.is_overview(q).alias("overview"), S.format_key(q).alias("format"))


@query(
    """SELECT o_orderkey, CASE WHEN t >= 1e6 THEN printf('$%.2fM', t / 1e6) WHEN t >= 1e3 THEN printf('$%.1fK', t / 1e3) ELSE printf('$%.2f', t) END AS money,
    CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM (SELECT *, 1000 * floor(o_totalprice / 1000) AS t FROM orders)"""
)
def scalar_periods(spark, d):
    name = F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"))
    return read(spark, d, "orders").select("o_orderkey", S.money(1000.0 * F.floor(F.col("o_totalprice") / 1000)).alias("money"), S.year_of(name).alias("y"), S.quarter_of(name).alias("q"))


# ---- folders -------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {DOCS}, h AS (SELECT domain || '/' || name AS folder, count(*) AS n FROM docs GROUP BY 1),
    u AS (SELECT folder, n AS n_here, 0 AS n_below FROM h UNION ALL SELECT split_part(folder, '/', 1), 0, n FROM h UNION ALL SELECT '', 0, n FROM h)
    SELECT folder, CAST(sum(n_here) AS BIGINT) AS n_here, CAST(sum(n_below) AS BIGINT) AS n_below FROM u GROUP BY 1"""
)
def index_folder_tree(spark, d):
    return folders.tree(docs(spark, d))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN starts_with(path, 'en/') THEN 'english/' || path[4:] ELSE path END AS path FROM docs")
def index_rename(spark, d):
    return folders.rename(docs(spark, d).select("doc_id", "path"), "en", "english")


@query(
    """SELECT CASE WHEN regexp_matches(source, '^src1') THEN 'first' WHEN regexp_matches(source, '5$') THEN 'fives' ELSE source END AS label, count(*) AS n, '' AS quarters
    FROM documents GROUP BY 1"""
)
def index_collapse(spark, d):
    return folders.collapse(read(spark, d, "documents").select(F.col("source").alias("name")), [("^src1", "first"), ("5$", "fives")])


@query(
    f"""WITH {_FILES}, c AS (SELECT path, hash, 'summary of ' || path AS summary FROM idx)
    SELECT f.path, f.hash, CASE WHEN c.hash = f.hash THEN c.summary ELSE f.ext END AS summary, coalesce(c.hash <> f.hash, true) AS fresh FROM files f LEFT JOIN c ON c.path = f.path"""
)
def summary_reuse(spark, d):
    cache = indexed(spark, d).withColumn("summary", F.concat(F.lit("summary of "), "path"))
    return folders.reused(files(spark, d), cache, F.col("ext"))
