"""A store of digests beside a knowledge base: one per file, an index page per domain, a manifest.

``sync`` builds the digests of files that are new or changed, reuses the others, deletes those whose file is gone, and
writes the pages again. A digest's front matter has its file's hash, by which it is reused. ``read`` gives a page.
"""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folders, search
from ..session import ship
from ..sources import documents, pages, tables
from . import api, profile_page, render
from .knowledge import KnowledgeBase

#: Keywords that the manifest knows of a domain.
MANIFEST_WORDS = 8
TABULAR = ("csv", "tsv", "xlsx", "xlsm", "json", "jsonl", "parquet")


class ContextStore:
    def __init__(self, kb: KnowledgeBase, root: str | None = None):
        self.kb, self.spark = kb, kb.spark
        self.root = (root or f"{kb.settings.store.rstrip('/')}/context").rstrip("/")

    # ---- pages as files

    def _file(self, relative: str):
        if relative.startswith("/") or ".." in PurePosixPath(relative).parts:
            raise ValueError("the path leaves the store")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, relative: str, text: str) -> None:
        path, files = self._file(relative)
        out = files.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, relative: str) -> str | None:
        path, files = self._file(relative)
        if not files.exists(path):
            return None
        return bytes(self.spark.read.format("binaryFile").load(path.toString()).select("content").first()[0]).decode("utf-8", "replace")

    def pages(self) -> DataFrame:
        """``page, text`` of all digests."""
        path, files = self._file("digests")
        if not files.exists(path):
            return self.spark.createDataFrame([], "page string, text string")
        listed = documents.listing(self.spark, f"{self.root}/digests", "*.md")
        return listed.select(F.col("path").alias("page"), F.decode("content", "UTF-8").alias("text"))

    def digests(self) -> DataFrame:
        """``page, path, hash, type, extraction, keywords, text`` of all digests, from their front matter."""
        rows = self.pages().withColumn("m", documents.front_matter(F.col("text")))
        value = lambda k: F.element_at("m", k).alias(k)
        words = F.filter(F.split(F.regexp_replace(F.coalesce(F.element_at("m", "keywords"), F.lit("")), r'[\[\]"]', ""), r",\s*"), lambda w: w != "")
        return rows.select("page", value("path"), F.element_at("m", "sha").alias("hash"), value("type"), value("extraction"), words.alias("keywords"), "text")

    # ---- sync

    def sync(self) -> dict:
        """Counts of digests that were built, reused and removed."""
        files = self.kb.files().withColumn("page", folders.digest_path(F.col("path")))
        known = self.digests().select(F.col("path"), F.col("hash").alias("old"), F.col("page").alias("old_page"))
        both = files.select("path", "hash", "page").join(known, "path", "full_outer").cache()
        fresh = both.where("hash is not null and (old is null or old != hash)").select("path", "hash", "page")
        reused = both.where("old = hash").count()
        texts = self.document_pages(files.join(fresh.where(~tables_only(F.col("path"))).select("path"), "path", "left_semi"))
        at = lambda c: F.concat(F.lit("digests/"), c)
        done = pages.write(texts.join(fresh.select("path", "page"), "path"), self.root, at("page"), "text")
        built = done["written"] + done["kept"]
        for r in fresh.where(tables_only(F.col("path"))).orderBy("path").toLocalIterator():  # each is a few jobs
            self.write(f"digests/{r['page']}", self.table_page(r["path"], r["hash"]))
            built += 1
        gone = both.where("hash is null").select(at("old_page").alias("path"), F.lit(None).cast("string").alias("content"))
        removed = pages.write(gone, self.root)["deleted"]
        both.unpersist()
        self.index()
        return {"built": built, "reused": reused, "removed": removed}

    def table_page(self, path: str, sha: str) -> str:
        """A table's digest, or one that says why there is none."""
        try:
            df = tables.load(self.spark, f"{self.kb.settings.root.rstrip('/')}/{path}")
            return with_front(api.digest_of(df, path), {"sha": sha, "extraction": "ok"})
        except (ValueError, PySparkException, Py4JJavaError) as e:
            return failure(path, sha, api.first_line(e))

    def document_pages(self, files: DataFrame) -> DataFrame:
        """``path, text``: digests of documents, rendered where they were read; each has its headings with their first
        paragraphs, or its first paragraphs where there are no headings."""
        read = documents.extract(files).join(files.select("path", "hash"), "path")
        parts = documents.sections(read).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("nth", "level", "heading", "lead"))).alias("sections"))
        words = read.select("path", F.slice(F.array_distinct(T.topic_tokens(F.col("text"))), 1, 25).alias("keywords"))
        leads = F.slice(F.transform(F.filter("events", lambda e: e["kind"] == "para"), lambda e: e["text"]), 1, 8).alias("leads")
        rows = read.select("path", "hash", "status", leads).join(parts, "path", "left").join(words, "path", "left")
        return profile_page.rendered(rows)

    def index(self) -> None:
        """A page per domain with a line per file, written by the tasks that have them, and the manifest with the keywords
        that most files share; pages of domains that are gone are deleted."""
        rows = self.digests().withColumn("domain", F.coalesce(F.nullif(F.substring_index("path", "/", 1), F.lit("")), F.lit("root"))).cache()
        sizes = rows.groupBy("domain").agg(F.count("*").alias("n_files"))
        place = F.row_number().over(Window.partitionBy("domain").orderBy("path"))
        listed = rows.withColumn("place", place).where(F.col("place") <= render.INDEX_FILES).join(sizes, "domain")
        kind = F.concat_ws(", ", F.coalesce("type", F.lit("file")), F.when(F.col("extraction") == "empty", "empty"))
        ship(self.spark)
        made = listed.select("domain", "n_files", "path", kind.alias("type"), "keywords").groupBy("domain").applyInPandas(index_pages, "path string, content string")
        there, files = self._file("index")
        if files.exists(there):
            old = documents.listing(self.spark, f"{self.root}/index", "*.md").select(F.concat(F.lit("index/"), "path").alias("path"))
            known = sizes.select(F.concat(F.lit("index/"), "domain", F.lit(".md")).alias("path"))
            made = made.unionByName(old.join(known, "path", "left_anti").withColumn("content", F.lit(None).cast("string")))
        pages.write(made, self.root)
        words = rows.select("domain", F.explode("keywords").alias("word")).groupBy("domain", "word").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "word"))
        best = words.withColumn("rank", rank).where(F.col("rank") <= MANIFEST_WORDS).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).getField("word").alias("keywords"))
        self.write("MANIFEST.md", render.manifest([r.asDict() for r in sizes.join(best, "domain", "left").orderBy("domain").collect()]))
        rows.unpersist()

    # ---- tiers

    def fitting(self, domain: str, question: str, n: int = 3, limit: int = 6000) -> list[dict]:
        """``path, score, text`` of the domain's digests that fit the question, best first, compacted."""
        mine = self.digests().where(F.col("path").startswith(f"{domain}/"))
        hits = search.bm25_texts(mine.select("path", F.concat_ws(" ", "path", "text").alias("t")), question, "path", F.col("t"), n)
        if hits.isEmpty():
            hits = search.keyword_fallback(mine.select("path", "text"), question, "path", F.col("text"), n)
        found = mine.join(F.broadcast(hits), "path").orderBy(F.desc("score"), "path").collect()
        return [{"path": r["path"], "score": r["score"], "text": compact(r["text"], question, limit)} for r in found]

    def context(self, domain: str, question: str, n: int = 3, limit: int = 6000) -> str:
        """From the index page to the digests that fit the question."""
        return "\n\n".join([self.read(f"index/{domain}.md") or "", *(r["text"] for r in self.fitting(domain, question, n, limit))]).strip()


def index_pages(files: pd.DataFrame) -> pd.DataFrame:
    """The index page of one domain, from as many of its files as a page may list."""
    domain, n = files["domain"].iloc[0], int(files["n_files"].iloc[0])
    rows = [{"path": r.path, "type": r.type, "keywords": list(r.keywords)} for r in files.sort_values("path").itertuples(index=False)]
    return pd.DataFrame({"path": [f"index/{domain}.md"], "content": [render.index_page(domain, rows, n)]})


def tables_only(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*TABULAR)


def with_front(page: str, values: dict) -> str:
    """Further values in a digest's front matter."""
    return page.replace("---\n", "---\n" + "".join(f"{k}: {v}\n" for k, v in values.items()), 1)


def failure(path: str, sha: str, reason: str) -> str:
    """The digest of a file that can't be read: its reason instead of content."""
    return render.front_matter({"sha": sha, "path": path, "extraction": "empty", "reason": json.dumps(reason)}) + f"# {path}\n\nNothing could be read from this file.\n"


def compact(page: str, question: str, limit: int) -> str:
    """A digest without front matter and column list, its parts ordered by how many of the question's words they have,
    cut at ``limit`` characters with a mark."""
    body = re.sub(r"\A---\n.*?\n---\n", "", page, flags=re.S)
    first, *parts = re.split(r"(?m)^(?=## )", body)
    words = set(re.findall(r"[a-z0-9]{3,}", question.lower()))
    parts = [p for p in parts if not p.startswith("## Columns")]
    parts.sort(key=lambda p: -len(words & set(re.findall(r"[a-z0-9]{3,}", p.lower()))))
    text = (first + "".join(parts)).strip()
    return text if len(text) <= limit else text[:limit].rstrip() + "\n\n_cut_"

