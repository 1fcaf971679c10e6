"""One query for each operator, over its whole table, and SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, exact_dedup, filter_audit, html, minhash, packing, perplexity, pii, quality, sharding, url_lists, vector_codes

VOCABULARY = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def page_captures(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch times: a page is taken as fetched on a day of 2024 that its id gives."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """There is no list table either: entries for hosts, parents and folders of ``pages``, by the host's digest."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("h")).where("h != ''").distinct().withColumn("c", F.conv(F.substring(F.md5("h"), 1, 6), 16, 10).cast("long"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("c", F.lit(180)).cast("int"))
    parent = F.regexp_replace("h", r"^[^.]*\.", "")

    def entry(name, key, action, after, when):
        return F.when(F.expr(when), F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), F.date_add(start, after).alias("at")))

    h = F.col("h")
    entries = F.array(
        entry("adult", h, "add", 0, "c % 4 = 0"),
        entry("adult", h, "remove", 60, "c % 4 = 0"),
        entry("adult", h, "add", 120, "c % 8 = 0"),
        entry("spam", parent, "add", 30, "c % 7 = 0 and h like '%.%.%'"),
        entry("spam", parent, "remove", 100, "c % 14 = 0 and h like '%.%.%'"),
        entry("mirror", F.concat(h, F.lit("/fr")), "add", 10, "c % 3 = 0"),
        entry("ads", h, "add", 0, "h like '%ads-track%'"),
    )
    return hosts.select(F.explode(F.array_compact(entries)).alias("e")).select("e.*")


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.active_lists(page_captures(pages), dated_entries(pages)).withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(_read(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: A text counts as good from this score on.
GOOD_FROM = 0.3


def held_out(id_col: str = "doc_id"):
    """The fifth of ids that training never sees."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    model = quality.fit(documents, _read(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score(documents, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents")).drop("redacted")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(_read(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_url_lists, op3_minhash, op4_sharding, op5_quality, op6_embeddings, op7_bpe, op8_pii, op9_exact_dedup, op10_html,
        op11_filter_audit, op12_vector_codes, op13_quality_rules,
    )
}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Assigning and averaging, once per round. Distances are sums of products of whole numbers, exact as doubles."""
    steps, book = [], "b0"
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
          SELECT vec_id, p.pos, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
            SELECT vec_id, p.pos, b.k, list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y) AS d FROM p JOIN {book} b ON b.pos = p.pos
          ) p GROUP BY vec_id, p.pos
        )""")
        if r < rounds:
            steps.append(f"""s{r} AS (
          SELECT pos, k, list(v ORDER BY i) AS y FROM (
            SELECT pos, k, i, floor(sum(x[i]) / count(*)) AS v FROM (SELECT p.pos, a.k, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN a{r} a ON a.vec_id = p.vec_id AND a.pos = p.pos) GROUP BY pos, k, i
          ) GROUP BY pos, k
        ), b{r + 1} AS MATERIALIZED (SELECT b.pos, b.k, coalesce(s.y, b.y) AS y FROM {book} b LEFT JOIN s{r} s ON s.pos = b.pos AND s.k = b.k)""")
            book = f"b{r + 1}"
    return f"""
        WITH v AS MATERIALIZED (
          SELECT vec_id, label, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS x, len(embedding) // {parts} AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT vec_id, pos, x[pos * w + 1 : (pos + 1) * w] AS x FROM v, range({parts}) r(pos)),
        b0 AS MATERIALIZED (
          SELECT pos, k, x AS y FROM (SELECT pos, x, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS k FROM p) WHERE k < {entries}
        ), {", ".join(steps)},
        c AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(v AS BIGINT) AS VARCHAR) FOR v IN y], ','), ',' ORDER BY pos, k)) AS h FROM {book}),
        e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, c.h AS codebooks_sha256
        FROM v JOIN e ON e.vec_id = v.vec_id, c
    """


ORACLES: dict[str, str] = {
    "op11_filter_audit": r"""
        WITH t AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
        m AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
                 + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INTEGER)
                 + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(t.doc_id > min(t.doc_id) OVER (PARTITION BY text) AS INTEGER) AS mask
          FROM t LEFT JOIN g ON g.doc_id = t.doc_id
        ), n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        f(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
          SELECT [p.c, q.c, r.c, s.c, u.c] AS l, [p.b, q.b, r.b, s.b, u.b] AS b FROM f p, f q, f r, f s, f u WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.c, q.c, r.c, s.c, u.c])) = 5
        ), x AS (SELECT array_to_string(l, '') AS filter_order, step, CAST(b[step] AS INTEGER) AS bit, CAST(coalesce(list_sum(b[1 : step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(step)),
        y AS (
          SELECT part, filter_order, step, bit,
                 sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
                 sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
                 sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
          FROM n, x GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
        FROM y
    """,
    "op12_vector_codes": _codes_sql(),
    "op2_url_lists": r"""
        WITH p AS (
          SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_at,
                 rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
          FROM pages
        ), h AS (
          SELECT host AS h, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS c,
                 host LIKE '%.%.%' AS deep, regexp_replace(host, '^[^.]*\.', '') AS parent
          FROM (SELECT DISTINCT host FROM p WHERE host <> '')
        ), d AS (SELECT *, DATE '2024-01-01' + CAST(c % 180 AS INTEGER) AS start FROM h),
        e AS (
          SELECT 'adult' AS list, h AS key, 'add' AS action, start AS "at" FROM d WHERE c % 4 = 0
          UNION ALL SELECT 'adult', h, 'remove', start + 60 FROM d WHERE c % 4 = 0
          UNION ALL SELECT 'adult', h, 'add', start + 120 FROM d WHERE c % 8 = 0
          UNION ALL SELECT 'spam', parent, 'add', start + 30 FROM d WHERE c % 7 = 0 AND deep
          UNION ALL SELECT 'spam', parent, 'remove', start + 100 FROM d WHERE c % 14 = 0 AND deep
          UNION ALL SELECT 'mirror', h || '/fr', 'add', start + 10 FROM d WHERE c % 3 = 0
          UNION ALL SELECT 'ads', h, 'add', start FROM d WHERE h LIKE '%ads-track%'
        ), v AS (
          SELECT list, key, action, "at" AS since, lead("at") OVER (PARTITION BY list, key ORDER BY "at", action) AS until
          FROM (SELECT DISTINCT * FROM e)
        ), hits AS (
          SELECT p.url, p.fetched_at, count(DISTINCT (v.list, v.key, v.since)) AS n_entries,
                 array_to_string(list_sort(list(DISTINCT v.list)), ',') AS lists
          FROM p JOIN v ON v.action = 'add' AND (v.until IS NULL OR v.until > v.since)
           AND p.fetched_at >= v.since AND (v.until IS NULL OR p.fetched_at < v.until)
           AND (p.host = split_part(v.key, '/', 1) OR ends_with(p.host, '.' || split_part(v.key, '/', 1)))
           AND contains(split_part(v.key, '/', 1), '.')
           AND (NOT contains(v.key, '/') OR p.path = '/' || split_part(v.key, '/', 2) OR starts_with(p.path, '/' || split_part(v.key, '/', 2) || '/'))
          GROUP BY p.url, p.fetched_at
        )
        SELECT p.page_id, p.url, CAST(p.fetched_at AS VARCHAR) AS fetched_at, p.host,
               coalesce(hits.n_entries, 0) AS n_entries, coalesce(hits.lists, '') AS lists, hits.n_entries IS NOT NULL AS blocked
        FROM p LEFT JOIN hits ON hits.url = p.url AND hits.fetched_at = p.fetched_at
    """,
    "op3_minhash": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest([array_to_string(l[i : i + 3], ' ') FOR i IN range(1, greatest(1, len(l) - 3) + 1)]) AS shingle FROM w WHERE len(l) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        linked AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
        e AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """,
    "op4_sharding": r"""
        WITH RECURSIVE t(n, k, c) AS (
          SELECT n, 0, n FROM range(256) r(n)
          UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY n) AS l FROM t WHERE k = 8),
        b AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (
          SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(h, '..')]),
            lambda a, x: xor(a // 256, l[CAST(xor(a % 256, x) AS INTEGER) + 1])), 4294967295) AS text_crc32
          FROM b, crc
        ), e AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS till, sum(size) OVER () AS total FROM s),
        p AS (SELECT *, CAST(least(15, floor((till - size / 2) * 16 / total)) AS INTEGER) AS shard FROM e)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
    """,
    "op6_embeddings": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
        linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.9),
        r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.y FROM r JOIN linked l ON r.b = l.x),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
        k AS (SELECT x AS vec_id, count(*) AS n FROM linked GROUP BY 1)
        SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.vec_id = c.vec_id
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents
        ), k AS (
          SELECT doc_id, norm,
                 first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size
          FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
}
