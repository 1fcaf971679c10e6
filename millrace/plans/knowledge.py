"""A knowledge base over a folder of documents: index, status, search, context, write-back, health."""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed
from ..functions import scalars as S
from ..operators import gates, index, routing, search, sketches
from ..sources import config, documents, postings, tables, vectorindex
from ..sources.commitlog import CommitLog
from ..sources.store import Store
from ..sources.valueindex import ValueIndex
from . import plugins, render


class KnowledgeBase:
    def __init__(self, spark: SparkSession, settings: config.Settings, domains: dict[str, config.Domain] | None = None):
        self.spark, self.settings, self.domains = spark, settings, domains or {}
        self.store = Store(spark, settings.store)
        self.held = plugins.Cache()
        self.values = ValueIndex(spark, f"{settings.store.rstrip('/')}/values")
        self.sketches = CommitLog(spark, f"{settings.store.rstrip('/')}/sketches", sketches.SCHEMA, "path")

    # ---- index

    def files(self) -> DataFrame:
        """Indexable files with their content hash."""
        listed = documents.listing(self.spark, self.settings.root)
        wanted = documents.indexable(listed, list(self.settings.ignored), documents.noindex_folders(self.spark, self.settings.root))
        return wanted.withColumn("hash", F.md5("content"))

    def readmes(self) -> DataFrame:
        """README files, which are read as a whole and not indexed."""
        listed = documents.listing(self.spark, self.settings.root, "*[Rr][Ee][Aa][Dd][Mm][Ee]*")
        return listed.where(F.lower("name").rlike(r"^readme(\.(md|txt))?$"))

    def chunks(self, files: DataFrame) -> DataFrame:
        texts = documents.extract(files).join(files.select("path", "domain", "name", "hash"), "path")
        rows = texts.select(F.col("path").alias("doc_id"), "domain", "name", "path", "hash", "text")
        s = self.settings
        return search.chunk(rows, s.chunk_size, s.chunk_overlap, s.chunk_cap).withColumn("source", F.lit("raw"))

    def reindex(self, now: float, force: bool = False) -> dict:
        """Indexes what is new or changed and drops what is gone; a second run finds nothing to do."""
        files, known = self.files(), self.store.files()
        fresh = files if force else index.changed(files, known)
        gone = index.orphans(known, files).select("path")
        counts = {"changed": fresh.count(), "removed": gone.count()}
        if counts["changed"] or counts["removed"]:
            out = gone.unionByName(fresh.select("path"))
            self.values.remove(out)
            self.sketches.delete(out)
            if found := self.tables(fresh):
                self.values.refresh(found)
                each = [sketches.sketch(df, path) for path, df in found.items() if df.columns]
                if each:
                    self.sketches.upsert(functools.reduce(DataFrame.unionByName, each))
            # files that have no text any more keep no chunks either
            self.store.remove(gone.unionByName(fresh.select("path")))
            self.store.upsert(self.chunks(fresh))
            self.store.replace_meta({r["domain"]: {"n_files": r["n_files"], "model": embed.NAME} for r in self.store.domains().collect()}, now)
            self.postings()
            self.vectors()
        return counts

    def tables(self, files: DataFrame) -> dict[str, DataFrame]:
        """The tables among these files that can be read."""
        found = {}
        for r in files.select("path").toLocalIterator():
            if tables.extension(r["path"]) in tables.TABULAR:
                try:
                    found[r["path"]] = tables.load(self.spark, f"{self.settings.root.rstrip('/')}/{r['path']}")
                except (ValueError, PySparkException, Py4JJavaError):
                    continue  # its digest says why
        return found

    def profile(self, domain: str) -> DataFrame:
        """The columns of all tables of a domain, by name, from the sketches of its files; no file is read."""
        return sketches.report(self.sketches.read().where(F.substring_index("path", "/", 1) == domain))

    def worded(self) -> DataFrame:
        return self.store.read("chunks").select("chunk_id", "path", "domain", F.concat_ws(" ", "name", "text").alias("t"))

    def postings(self) -> str | None:
        """The folder of the postings of the newest chunks, built if it isn't there yet; those of older ones go."""
        return self._derived("postings", "corpus", lambda folder: postings.build(self.worded(), "chunk_id", F.col("t"), folder, F.col("domain")))

    def vectors(self) -> vectorindex.VectorIndex | None:
        """The inverted lists of the newest chunks' vectors, likewise."""
        rows = self.worded().select("chunk_id", "domain", embed.hashed(F.col("t")).alias("v"))
        folder = self._derived("vectors", "centroids", lambda folder: vectorindex.build(rows, "chunk_id", "v", folder, scope_col="domain"))
        return folder and vectorindex.VectorIndex(self.spark, folder)

    def _derived(self, name: str, last: str, build: Callable[[str], None]) -> str | None:
        known = self.store.versions("chunks")
        if not known:
            return None
        folder, top = f"{self.store.root}/{name}/v={known[-1]}", f"{self.store.root}/{name}"
        path, files = self.store._fs(f"{folder}/{last}/_SUCCESS")
        if not files.exists(path):
            top_path, files = self.store._fs(top)
            if files.exists(top_path):
                files.delete(top_path, True)
            build(folder)
        return folder

    def status(self) -> DataFrame:
        """``path, state`` for files on disk and in the index."""
        return index.diff(self.files(), self.store.files())

    def domain_status(self) -> DataFrame:
        per = self.status().join(self.files().select("path", "domain"), "path", "left").withColumn("domain", F.coalesce("domain", F.substring_index("path", "/", 1)))
        count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
        return per.groupBy("domain").agg(*(count(s) for s in ("ok", "stale", "missing", "orphaned")))

    def out_of_step(self) -> list[str]:
        """Domains whose files and index differ. Found again once a file's size or time of change or the index is another."""
        listed = documents.listing(self.spark, self.settings.root).agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "mtime"))).first()
        stamp = (*listed, *self.store.versions("chunks")[-1:])
        differ = self.domain_status().where("n_missing > 0 or n_stale > 0 or n_orphaned > 0").select("domain")
        return self.held.get("out of step", lambda: sorted(r["domain"] for r in differ.collect()), stamp)

    def stale_files(self, now: float) -> DataFrame:
        age = S.age_days(F.col("mtime"), F.timestamp_seconds(F.lit(now)))
        return self.files().select("path", age.alias("age_days")).where(F.col("age_days") >= self.settings.stale_days)

    def changed_since(self, since: float) -> DataFrame:
        return self.files().where(F.col("mtime") > F.timestamp_seconds(F.lit(since))).select("path", "mtime")

    def doctor(self) -> list[dict]:
        """Health findings: domains without files, without rules or keywords, out of step, or with another model."""
        found = []
        status = {r["domain"]: r for r in self.domain_status().collect()}
        for name, r in sorted(status.items()):
            if r["n_missing"] or r["n_stale"] or r["n_orphaned"]:
                found.append({"domain": name, "finding": "index out of step"})
            if self.store.meta(name).get("model", embed.NAME) != embed.NAME:
                found.append({"domain": name, "finding": "indexed with another model"})
            if name not in self.domains:
                found.append({"domain": name, "finding": "no rules"})
            elif len(self.domains[name].keywords) <= 1:
                found.append({"domain": name, "finding": "few keywords"})
        return found + [{"domain": d, "finding": "no files"} for d in sorted(set(self.domains) - set(status))]

    # ---- retrieval

    def search(self, question: str, domain: str | None = None, n: int = 10, weights: DataFrame | None = None) -> DataFrame:
        """``path, score``: BM25 and vectors over chunks, fused by rank, best chunk per file, weighted by feedback; the
        keyword fallback if neither finds anything."""
        rows = self.store.read("chunks")
        rows = rows.where(F.col("domain") == domain) if domain else rows
        worded = rows.select("chunk_id", "path", F.concat_ws(" ", "name", "text").alias("t"))
        stored = self.postings()
        if stored is None:
            return self.spark.createDataFrame([], "path string, score double")
        lexical = postings.bm25(self.spark, stored, question, "chunk_id", "string", 4 * n, domain or "")
        asked = self.spark.range(1).select(embed.hashed(F.lit(question)).alias("v")).first()["v"]
        near = self.vectors().nearest(asked, "chunk_id", 4 * n, scope=domain or "").where("score > 0")
        by_file = lambda hits: search.best_chunk(worded.select("chunk_id", "path").join(F.broadcast(hits), "chunk_id"), "path")
        fused = search.fuse(by_file(near), by_file(lexical), "path", n)
        if fused.isEmpty():
            whole = rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).getField("text"), " ").alias("text"))
            fused = search.keyword_fallback(whole, question, "path", F.col("text"), n)
        if plugins.find("reranker") and not fused.isEmpty():
            best = rows.join(F.broadcast(fused), "path").groupBy("path").agg(F.max("score").alias("score"), F.min_by("text", "chunk_index").alias("text"))
            fused = plugins.rerank(best, question, "path", "text", n)
        return search.weigh(fused, weights, "path") if weights is not None else fused

    def route(self, question: str) -> list[str]:
        """Confident domain by keywords; else the domains of the best hits; else all."""
        pairs = [(d.domain, k) for d in self.domains.values() for k in d.keywords]
        if pairs:
            keywords = routing.owned_keywords(self.spark.createDataFrame(pairs, "domain string, keyword string"))
            asked = self.spark.createDataFrame([(0, question)], "question_id int, question string")
            led = routing.dominance(routing.keyword_hits(asked, keywords)).where("confident").collect()
            if led:
                return [led[0]["domain"]]
        hits = self.search(question, n=10).select(F.lit(0).alias("question_id"), F.substring_index("path", "/", 1).alias("domain"), "score")
        best = routing.fan_out(hits.groupBy("question_id", "domain").agg(F.max("score").alias("score")))
        return [r["domain"] for r in best.orderBy("rank").collect()] or sorted(self.domains)

    def context(self, question: str, acknowledged: bool = False) -> dict:
        """What a model would read: the pinned and best files of the routed domains within their size, without
        confidential ones unless acknowledged."""
        each = [self.domain_context(name, question, acknowledged=acknowledged) for name in self.route(question)]
        parts = [f"## {s['path']}\n\n{s['text']}" for found in each for s in found["sources"]]
        sources = [{"path": s["path"], "score": s["score"]} for found in each for s in found["sources"]]
        return {"text": "\n\n".join(parts), "sources": sources, "withheld": sum(found["withheld"] for found in each)}

    def domain_context(self, name: str, question: str, n: int | None = None, acknowledged: bool = False, weights: DataFrame | None = None) -> dict:
        """One domain's pinned and best files, ``n`` or as many as its rules say: path, score and text of each."""
        rules = self.domains.get(name, config.Domain(name))
        n = n or rules.top_n
        hits = self.search(question, name, n, weights)
        chunks = self.store.read("chunks").where(F.col("domain") == name)
        match = F.lit(False)
        for p in rules.pins:
            match = match | S.glob_like(F.col("path"), f"*{p}")
        boosted = F.lit(False)
        for b in rules.boosts:
            boosted = boosted | F.contains(F.lower("path"), F.lit(b.lower()))
        ordered = search.pin(hits, chunks.select("path").distinct().where(match), boosted, "path").where(F.col("place") <= 2 * n)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n")
        rows = ordered.join(chunks.join(F.broadcast(ordered.select("path")), "path", "left_semi").groupBy("path").agg(text.alias("text")), "path")
        shown = gates.withhold(rows, gates.confidential(rows).select("path"), acknowledged)
        found = shown.orderBy("place").limit(n).select("path", "score", S.trimmed_to(F.col("text"), rules.max_chars).alias("text")).collect()
        withheld = gates.confidential(rows.where(F.col("place") <= n)).count() if not acknowledged else 0
        return {"domain": name, "sources": [r.asDict() for r in found], "withheld": withheld}

    def index_page(self, domain: str) -> str:
        """A domain's index, with as many files as its bytes allow and the number of all."""
        mine = self.store.files().where(F.col("domain") == domain)
        rows = mine.orderBy("path").limit(render.INDEX_FILES + 1).collect()
        total = mine.count() if len(rows) > render.INDEX_FILES else len(rows)
        return render.index_page(domain, [{"path": r["path"], "type": PurePosixPath(r["path"]).suffix.lstrip(".")} for r in rows[: render.INDEX_FILES]], total)

    def manifest(self) -> str:
        rows = self.store.domains().orderBy("domain").collect()
        return render.manifest([r.asDict() | {"keywords": list(self.domains[r["domain"]].keywords) if r["domain"] in self.domains else []} for r in rows])

    def update_document(self, relative: str, content: str, mode: str = "overwrite") -> str:
        """Writes a document under the root: overwrite, append or prepend. Paths that leave the root are refused."""
        if mode not in ("overwrite", "append", "prepend"):
            raise ValueError(f"unknown mode {mode}")
        parts = PurePosixPath(relative).parts
        if not parts or relative.startswith("/") or ".." in parts:
            raise ValueError("the path leaves the root")
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.settings.root.rstrip('/')}/{relative}")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = ""
        if mode != "overwrite" and fs.exists(target):
            old = bytes(self.spark.read.format("binaryFile").load(target.toString()).select("content").first()[0]).decode("utf-8", "replace")
        text = {"overwrite": content, "append": old + content, "prepend": content + old}[mode]
        out = fs.create(target, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return relative
