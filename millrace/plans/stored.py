"""Queries over what is kept between runs: streams with states, written pages, indexes; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import digest, logs, sketches
from ..sources import commitlog, pages, valueindex, vectorindex
from ..streaming import events, folder, keyed
from .catalogue import DOCS, ORACLES, QUERIES, _topic_sql, docs, query, read, scratch, state_of

__all__ = ["ORACLES", "QUERIES"]  # of the catalogue and of this module

# ---- streams -----------------------------------------------------------------------------------------------------------


def in_steps(rows: DataFrame, steps: list[Column], stream: Callable[[DataFrame], DataFrame], mode: str, idle: bool = True) -> DataFrame:
    """What a stream over files says of ``rows`` that come in steps; between the steps it ends and is started again."""
    spark, top = rows.sparkSession, scratch(rows.sparkSession, "millrace-steps")
    for step in steps:
        rows.where(step).write.mode("append").parquet(f"{top}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{top}/in")
        out = events.drain(stream(arriving), f"millrace_{uuid.uuid4().hex}", mode, f"{top}/checkpoint", idle)
    return out


@query(
    """SELECT path, kind, step FROM (
      SELECT 'nation=' || s_nationkey || '/supplier-' || s_suppkey || '.txt' AS path, s_suppkey AS k FROM supplier
    ), (VALUES ('created', 1), ('modified', 2), ('deleted', 3)) v(kind, step) WHERE step = 1 OR (step = 2 AND k % 3 = 0) OR (step = 3 AND k % 5 = 0)"""
)
def stream_folder_events(spark, d):
    """A page for each supplier; then every page is written again, a third with other content; then a fifth is deleted. A
    stream that ends after each step tells every event once, and nothing where nothing happened."""
    top = scratch(spark, "millrace-folder")
    path = F.concat(F.lit("nation="), "s_nationkey", F.lit("/supplier-"), "s_suppkey", F.lit(".txt"))
    rows = read(spark, d, "supplier").select(path.alias("path"), F.col("s_name").alias("content"), F.col("s_suppkey").alias("k"))
    steps = (rows, rows.withColumn("content", F.when(F.col("k") % 3 == 0, F.concat("content", F.lit(", moved"))).otherwise(F.col("content"))), rows.where("k % 5 = 0").withColumn("content", F.lit(None).cast("string")))
    for step in steps:
        pages.write(step, f"{top}/pages")
        for _ in range(2):
            seen = events.drain(folder.watch(spark, f"{top}/pages", f"{top}/listings"), f"millrace_{uuid.uuid4().hex}", "append", f"{top}/checkpoint")
    return seen.select("path", "kind", F.col("listing").cast("int").alias("step"))


@query(
    """WITH e AS (SELECT user_id, event_type AS path, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS kind, ts, event_id,
      CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 7200000000 THEN 0 ELSE 1 END AS f FROM events),
    i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM e),
    p AS (SELECT user_id, burst, path, min(ts) AS a, max(ts) AS b, count(*) AS n, arg_max(kind, (ts, event_id)) AS kind FROM i GROUP BY ALL)
    SELECT user_id, CAST(min(a) AS VARCHAR) AS first_at, CAST(max(b) AS VARCHAR) AS last_at, CAST(sum(n) AS BIGINT) AS n_events,
      coalesce(string_agg(path, ',' ORDER BY path) FILTER (kind = 'deleted'), '') AS removed, coalesce(string_agg(path, ',' ORDER BY path) FILTER (kind <> 'deleted'), '') AS indexed
    FROM p GROUP BY user_id, burst HAVING max(b) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR"""
)
def stream_debounced(spark, d):
    """Users as folders and kinds of events as their files. Rows come up to an hour late, in three steps, so that bursts lie
    open across steps and late events join them. What is still open at the end isn't told."""
    rows = read(spark, d, "events").select(
        F.col("user_id").alias("folder"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("kind"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )
    day = F.dayofmonth(F.col("at") + F.expr("make_interval(0, 0, 0, 0, 0, 10 * (seq % 7))"))
    out = in_steps(rows, [day <= 10, (day > 10) & (day <= 20), day > 20], lambda s: keyed.debounced(s, "2 hours", "3 hours"), "append")
    texts = {c: F.col(c).cast("string") for c in ("first_at", "last_at")} | {c: F.array_join(c, ",") for c in ("removed", "indexed")}
    return out.withColumns(texts).withColumnRenamed("folder", "user_id")


@query(
    """WITH b AS (SELECT user_id, (day(ts) - 1) // 8 AS step, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY ALL),
    c AS (SELECT *, lag(items) OVER (PARTITION BY user_id ORDER BY step) AS before FROM b)
    SELECT user_id, array_to_string(items, ',') AS items, coalesce(len(before), 0) AS n_before FROM c WHERE before IS NULL OR before <> items"""
)
def stream_changed_sets(spark, d):
    """The kinds of events of each user in steps of eight days, told when they aren't those told last."""
    rows = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("item"), "ts")
    steps = [F.floor((F.dayofmonth("ts") - 1) / 8) == i for i in range(4)]
    out = in_steps(rows, steps, keyed.changed_sets, "update", idle=False)
    return out.select(F.col("key").alias("user_id"), F.array_join("items", ",").alias("items"), F.coalesce("n_before", F.lit(0).cast("long")).alias("n_before"))


# ---- pages ---------------------------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL)
    SELECT lang || '/' || source || '.md' AS path, md5('# ' || lang || ', ' || source || chr(10) || n || ' documents, ' || chars || ' characters' || chr(10)) AS hash,
      CASE WHEN n % 2 = 0 THEN 'kept' ELSE 'written' END AS state, 0 AS left_over FROM n"""
)
def context_pages(spark, d):
    """A page for each language and source. Half of them are there already as they should be, the others hold something
    else, as does a page that has to go; what the folder holds after the write is read back."""
    top = f"{scratch(spark, 'millrace-pages')}/pages"
    n = read(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    text = F.concat(F.lit("# "), "lang", F.lit(", "), "source", F.lit("\n"), "n", F.lit(" documents, "), "chars", F.lit(" characters\n"))
    rows = n.select(F.concat("lang", F.lit("/"), "source", F.lit(".md")).alias("path"), text.alias("content"), (F.col("n") % 2 == 0).alias("same"))
    former = rows.select("path", F.when(F.col("same"), F.col("content")).otherwise(F.lit("former")).alias("content"))
    gone = rows.select(F.concat(F.lit("gone/"), F.regexp_replace("path", "/", "-")).alias("path"), F.lit("gone").alias("content"))
    pages.write(former.unionByName(gone), top)
    done = pages.write(rows.select("path", "content").unionByName(gone.withColumn("content", F.lit(None).cast("string"))), top)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(top)
    there = there.select(F.regexp_replace("path", "^.*/pages/", "").alias("path"), F.md5("content").alias("hash"))
    state = F.when(F.col("same"), "kept").otherwise("written")
    counts = rows.agg(F.count_if("same"), F.count("*")).first()
    wrong = sum(abs(a - b) for a, b in zip((done["kept"], done["written"], done["deleted"]), (counts[0], counts[1] - counts[0], counts[1]), strict=True))
    return there.join(rows.select("path", state.alias("state")), "path", "left").withColumn("left_over", F.lit(wrong))


# ---- indexes -------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT v.vec_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score
      FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    SELECT vec_id, round(greatest(0, score), 6) AS score FROM c ORDER BY round(greatest(0, score), 9) DESC, vec_id LIMIT 10"""
)
def search_vector_index(spark, d):
    """The exact answer from inverted lists: those that can't hold one of the ten best aren't opened."""
    found = built_vectors(spark, d)
    asked = read(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return found.nearest(list(asked["embedding"]) if asked else [], "vec_id", 10).select("vec_id", F.round("score", 6).alias("score"))


_vectors: dict[tuple, str] = {}


def built_vectors(spark: SparkSession, d: str) -> vectorindex.VectorIndex:
    """The lists of ``embeddings``, built for an application's first question and again when the table changes."""
    key = (spark.sparkContext.applicationId, d, *state_of(spark, f"{d}/embeddings.parquet"))
    if key not in _vectors:
        top = scratch(spark, "millrace-vectors")
        vectorindex.build(read(spark, d, "embeddings"), "vec_id", "embedding", top, lists=32)
        _vectors[key] = top
    return vectorindex.VectorIndex(spark, _vectors[key])


@query(
    """SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'changed ' || coalesce(text, '') ELSE coalesce(text, '') END) AS hash, true AS small
    FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 4 = 0"""
)
def index_segments(spark, d):
    """Two thirds of the documents; then a fifth of those changes, the rest comes, a seventh goes, part of which comes back,
    and segments are merged. ``small`` tells that no update wrote more than what changed needs."""
    all_ = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    log = commitlog.CommitLog(spark, scratch(spark, "millrace-segments"), "doc_id long, text string", "doc_id")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))
    log.append(all_.where("doc_id % 3 != 0"))
    before = log.state().segments
    log.upsert(all_.where("doc_id % 3 != 0 and doc_id % 5 = 0").withColumn("text", changed))
    new = sum(s.bytes for s in log.state().segments.values() if s.name not in before)
    log.upsert(all_.where("doc_id % 3 = 0"))
    log.delete(all_.where("doc_id % 7 = 0"))
    log.upsert(all_.where("doc_id % 28 = 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(changed)))
    log.merge(2)
    small = new < 0.5 * sum(s.bytes for s in before.values())
    return log.read().select("doc_id", F.md5("text").alias("hash"), F.lit(small).alias("small"))


@query("SELECT user_id, event_type, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS n_archived FROM events GROUP BY ALL")
def log_commits(spark, d):
    """Four writers beside each other append the events to one log, and two rotations set what is old aside meanwhile."""
    rows = read(spark, d, "events").select("user_id", "event_type", "ts")
    log = commitlog.CommitLog(spark, scratch(spark, "millrace-log"), "user_id long, event_type string, ts timestamp_ntz")
    old = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")

    def work(i: int) -> None:
        log.append(rows.where(F.pmod(F.xxhash64("ts"), F.lit(4)) == i))
        if i % 2:
            log.rotate(old)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    archived = log.rotate(old)
    both = log.read().withColumn("archived", F.lit(False)).unionByName(archived.withColumn("archived", F.lit(True)))
    return both.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if("archived").alias("n_archived"))


_TABLES = {
    "region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",), "part": ("p_name", "p_brand", "p_type"),
}
_NAMES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
}
_ASKED = {"region": "r_name", "nation": "n_name", "customer": "c_mktsegment", "part": "p_type"}
_VALUE_ROWS = " UNION ALL ".join(f"SELECT '{t}.parquet' AS path, 1 AS weight, {c} AS text FROM {t}" for t, cs in _TABLES.items() for c in cs)
_NAME_ROWS = ", ".join(f"('{t}.parquet', 3, '{t}')" for t in _TABLES) + ", " + ", ".join(f"('{t}.parquet', 2, '{c.replace('_', ' ')}')" for t, cs in _NAMES.items() for c in cs.split())


@query(
    f"""WITH v AS (SELECT DISTINCT path, weight, unnest({_topic_sql('text')}) AS term FROM ({_VALUE_ROWS})),
    n AS (SELECT path, weight, unnest({_topic_sql('text')}) AS term FROM (VALUES {_NAME_ROWS}) x(path, weight, text)),
    e AS (SELECT term, path, max(weight) AS weight FROM (SELECT * FROM v WHERE regexp_matches(term, '[a-z]') OR length(term) <= 4 UNION ALL SELECT * FROM n) GROUP BY ALL),
    i AS (SELECT term, ln(1 + 5 / count(*)) AS idf FROM e GROUP BY 1),
    q AS (SELECT DISTINCT question, unnest({_topic_sql('question')}) AS term FROM ({" UNION ".join(f"SELECT 'figures of ' || {c} AS question FROM {t}" for t, c in _ASKED.items())})),
    s AS (SELECT question, path, sum(idf * weight) AS score FROM q JOIN e USING (term) JOIN i USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, path) AS rank FROM s)
    SELECT question, CAST(rank AS INTEGER) AS rank, path, round(score, 6) AS score FROM r WHERE rank <= 2"""
)
def route_tables(spark, d):
    """For each region, nation, market segment and kind of part the two tables that fit a question for its figures."""
    found = valueindex.ValueIndex(spark, scratch(spark, "millrace-values"))
    found.refresh({f"{t}.parquet": read(spark, d, t) for t in _TABLES})
    asked = None
    for t, c in _ASKED.items():
        some = read(spark, d, t).select(F.concat(F.lit("figures of "), c).alias("question"))
        asked = some if asked is None else asked.unionByName(some)
    routed = found.route_each(asked.distinct().withColumn("question_id", F.col("question")), 2)
    return routed.select(F.col("question_id").alias("question"), "rank", "path", F.round("score", 6).alias("score"))


_SKETCHED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_SKETCHED_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, nullif(trim(CAST({c} AS VARCHAR)), '') AS v, {c if c not in ('c_name', 'c_mktsegment') else 'NULL'}::DOUBLE AS x FROM customer" for c in _SKETCHED)


@query(
    f"""SELECT name, count(*) AS n_rows, count(*) - count(v) AS n_nulls, round((count(*) - count(v)) / count(*), 3) AS null_rate, round(count(x) / nullif(count(v), 0), 4) AS numeric_ratio,
    CAST(sum(CAST(x AS DECIMAL(28,4))) AS DOUBLE) AS total, true AS cardinality_near, true AS quartiles_near, true AS common_near FROM ({_SKETCHED_CELLS}) GROUP BY name"""
)
def profile_sketches(spark, d):
    """Customers in four files; a fifth state is merged from the sketches of three known files and a new one. What is exact
    is shown; distinct counts, quartiles and common values are compared with exact ones within the stated errors."""
    rows = read(spark, d, "customer").select(*_SKETCHED)
    log = commitlog.CommitLog(spark, scratch(spark, "millrace-sketches"), sketches.SCHEMA, "path")
    for i in range(4):
        log.upsert(sketches.sketch(rows.where(F.pmod("c_custkey", F.lit(4)) == i), f"part{i}"))
    found = sketches.report(log.read(), common=3)
    cells = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), S.label(F.col(c)).alias("value")) for c in _SKETCHED))))
    x = S.number(F.col("value"))
    exact = cells.groupBy("name").agg(F.count_distinct("value").alias("distinct"), F.count("value").alias("known"))
    ranks = cells.select("name", x.alias("x")).join(F.broadcast(found.select("name", "quartiles")), "name")  # a row for each column
    ranks = ranks.groupBy("name").agg(*(F.avg((F.col("x") <= F.element_at("quartiles", k)).cast("double")).alias(f"upto{k}") for k in (1, 2, 3)), *(F.avg((F.col("x") < F.element_at("quartiles", k)).cast("double")).alias(f"below{k}") for k in (1, 2, 3)))
    near = F.lit(True)
    for k in (1, 2, 3):
        near = near & F.coalesce((F.col(f"upto{k}") >= k / 4 - 0.017) & (F.col(f"below{k}") <= k / 4 + 0.017), F.lit(True))
    counts = cells.where("value is not null").groupBy("name", "value").agg(F.count("*").alias("exact"))
    told = found.select("name", F.explode("common").alias("c")).select("name", "c.value", "c.n")
    told = counts.join(F.broadcast(told), ["name", "value"], "left").groupBy("name").agg(
        F.max(F.abs(F.col("n") - F.col("exact"))).alias("off"), F.count("n").alias("n_told"), F.max(F.when(F.col("n").isNull(), F.col("exact"))).alias("untold")
    )
    bound = F.col("known") / sketches.TRACKED
    # a column may have fewer common values than are asked for, or none: then no other value is common
    common = (F.coalesce("off", F.lit(0)) <= bound) & ((F.coalesce("n_told", F.lit(0)) >= 3) | (F.coalesce("untold", F.lit(0)) <= bound))
    out = found.join(exact, "name").join(ranks, "name").join(told, "name", "left")
    return out.select(
        "name", "n_rows", "n_nulls", "null_rate", F.round("numeric_ratio", 4).alias("numeric_ratio"), "total",
        (F.abs(F.col("cardinality") - F.col("distinct")) <= 0.025 * F.col("distinct")).alias("cardinality_near"), near.alias("quartiles_near"), common.alias("common_near"),
    )


@query(
    """WITH c AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(28,4)) AS price, CAST(o_custkey AS DECIMAL(28,4)) AS customer FROM orders),
    g AS (SELECT 'status' AS dimension, status AS key, sum(price) AS price, sum(customer) AS customer, count(*) AS n_rows FROM c GROUP BY 2
      UNION ALL SELECT 'priority', priority, sum(price), sum(customer), count(*) FROM c GROUP BY 2),
    m AS (SELECT 'price' AS metric, dimension, key, round(CAST(price AS DOUBLE), 2) AS value, n_rows FROM g UNION ALL SELECT 'customer', dimension, key, round(CAST(customer AS DOUBLE), 2), n_rows FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY metric, dimension ORDER BY value DESC, key) AS r, count(*) OVER (PARTITION BY metric, dimension) AS n_groups FROM m WHERE key IS NOT NULL)
    SELECT metric, dimension, key, value, n_rows, n_groups FROM r WHERE r <= 4"""
)
def digest_all_metrics(spark, d):
    """Every metric in every dimension of the orders, the four largest groups of each."""
    rows = read(spark, d, "orders").selectExpr("o_orderstatus as status", "o_orderpriority as priority", "o_totalprice as price", "o_custkey as customer")
    return digest.breakdowns(rows, ["price", "customer"], ["status", "priority"], 4)


# ---- logs ------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, 1 + 4 * quality - toxic AS rating, doc_id % 90 AS ts FROM labels ORDER BY rating, ts DESC, doc_id LIMIT 10")
def feedback_lowest(spark, d):
    """The ten answers that were rated lowest, the newest first among equals."""
    rated = read(spark, d, "labels").selectExpr("doc_id", "1 + 4 * quality - toxic as rating", "doc_id % 90 as ts")
    return logs.lowest_rated(rated, "doc_id")


@query(
    f"""WITH {DOCS}, a AS (SELECT doc_id, unnest([array_to_string(string_split(path, '/')[1 : i], '/') FOR i IN range(1, len(string_split(path, '/')))]) AS folder FROM docs)
    SELECT folder, count(*) AS n_documents FROM a GROUP BY 1"""
)
def index_ancestors(spark, d):
    """How many documents lie in each folder and in those below it."""
    rows = docs(spark, d).select(F.explode(S.ancestors(F.col("path"))).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_documents"))
