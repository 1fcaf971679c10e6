"""Text and structure of document files, from ``binaryFile`` tables.

A document becomes text, a status and events ``(kind, text, level, place)``: headings, paragraphs, table rows, list
items. DOCX, PPTX, PDF and note files are read with the standard library; image text needs a plug-in, and without one
the status is ``unsupported``.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_EVENTS = "array<struct<kind:string,text:string,level:int,place:string>>"

Event = tuple[str, str, int, str]
#: Extension → function from bytes to events; register a plug-in here for further formats.
READERS: dict[str, Callable[[bytes], Iterator[Event]]] = {}

SKIPPED = ("readme", ".ds_store", "__pycache__")


def reader(*extensions: str):
    def add(f):
        READERS.update(dict.fromkeys(extensions, f))
        return f

    return add


def _joined(node, tag: str) -> str:
    return re.sub(r"\s+", " ", "".join(t.text or "" for t in node.iter(tag))).strip()


@reader("txt", "csv", "tsv")
def plain(content: bytes) -> Iterator[Event]:
    for i, block in enumerate(re.split(r"\n\s*\n", content.decode("utf-8", "ignore"))):
        if block.strip():
            yield "para", block.strip(), 0, str(i)


_FENCE = re.compile(r"^[ \t]*(?P<mark>```+|~~~+)[^\n]*\n.*?(?:^[ \t]*(?P=mark)[^\n]*$|\Z)", re.S | re.M)
_BLOCK = re.compile(r"^(?P<signs>#{1,6})[ \t]+(?P<title>[^\n]*?)[ \t]*#*[ \t]*$|(?P<para>(?:^(?!#{1,6}[ \t])[ \t]*\S[^\n]*(?:\n|\Z))+)", re.M)


@reader("md")
def markdown(content: bytes) -> Iterator[Event]:
    """What is left without front matter and fenced code is a sequence of headings and runs of lines."""
    text = content.decode("utf-8", "ignore").replace("\r\n", "\n")
    text = _FENCE.sub("\n", re.sub(r"\A---\n.*?\n---\n", "", text, flags=re.S))
    for block in _BLOCK.finditer(text):
        if block["signs"]:
            yield "heading", block["title"], len(block["signs"]), ""
        else:
            yield "para", " ".join(block["para"].split()), 0, ""


_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?P<text>(?:\\.|[^\\()])*)\)|<(?P<hex>[0-9A-Fa-f\s]+)>|(?P<move>\bT[dDm*]|\bET)|(?P<gap>-?\d+(?:\.\d+)?)(?=[^\[\]]*\]\s*TJ)", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(.))", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


@reader("pdf")
def pdf(content: bytes) -> Iterator[Event]:
    """Text that a file's content streams show, plain or deflated, a paragraph for each stream and its place. Fonts with
    codes of their own, and encrypted files, show nothing that can be read here; they come out empty."""
    if not content.startswith(b"%PDF") or b"/Encrypt" in content:
        return
    page = 0
    for found in _STREAM.finditer(content):
        data = found["data"]
        if b"/FlateDecode" in found["dict"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data or not re.search(rb"\bT[jJ]\b|['\"]\s", data):
            continue
        page += 1
        parts: list[str] = []
        for m in _SHOWN.finditer(data):
            if m["move"]:
                parts.append("\n")
            elif m["gap"]:
                parts.append(" " if float(m["gap"]) < -200 else "")
            elif m["text"] is not None:
                raw = _ESCAPE.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1] else _ESCAPED.get(e[2], e[2]), m["text"])
                parts.append(raw.decode("utf-16-be", "ignore") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "ignore"))
            else:
                digits = re.sub(rb"\s", b"", m["hex"])
                parts.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "ignore"))
        text = "\n".join(line for line in (" ".join(x.split()) for x in "".join(parts).split("\n")) if line)
        if any(c.isalnum() for c in text):
            yield "para", text, 0, f"Page {page}"


@reader("docx")
def docx(content: bytes) -> Iterator[Event]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := _joined(node, f"{_W}t")):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "").lower()
            level = re.search(r"heading\s*(\d)", name)
            yield ("heading", text, int(level[1]), "") if level else ("heading", text, 1, "") if name == "title" else ("para", text, 0, "")
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                yield "row", " | ".join(_joined(c, f"{_W}t") for c in row.findall(f"{_W}tc")), 0, ""


@reader("pptx")
def pptx(content: bytes) -> Iterator[Event]:
    book = zipfile.ZipFile(io.BytesIO(content))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    for part in sorted((n for n in book.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        place = f"Slide {number(part)}"
        root = ElementTree.fromstring(book.read(part))
        for shape in root.iter(f"{_P}sp"):
            kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            title = kind is not None and kind.get("type") in ("title", "ctrTitle")
            for p in shape.iter(f"{_A}p"):
                if text := _joined(p, f"{_A}t"):
                    yield ("heading", text, 1, place) if title else ("para", text, 0, place)
        for row in root.iter(f"{_A}tr"):
            yield "row", " | ".join(_joined(c, f"{_A}t") for c in row.findall(f"{_A}tc")), 0, place
        notes = f"ppt/notesSlides/notesSlide{number(part)}.xml"
        if notes in book.namelist() and (text := _joined(ElementTree.fromstring(book.read(notes)), f"{_A}t")):
            yield "note", text, 0, place


@reader("boxnote")
def note(content: bytes) -> Iterator[Event]:
    """Any JSON document tree whose leaves hold ``text``; nodes typed heading, list_item or table_row keep their kind."""

    def texts(node) -> str:
        if isinstance(node, dict):
            return (node.get("text") or "") + "".join(map(texts, node.get("content", []))) if isinstance(node.get("text", ""), str) else ""
        return "".join(map(texts, node)) if isinstance(node, list) else ""

    def visit(node):
        kind = node.get("type") if isinstance(node, dict) else None
        if kind in ("heading", "paragraph", "list_item", "table_row"):
            if text := texts(node).strip():
                level = int((node.get("attrs") or {}).get("level", 1)) if kind == "heading" else 0
                yield {"heading": "heading", "list_item": "item", "table_row": "row"}.get(kind, "para"), text, level, ""
            return
        if isinstance(node, dict) and isinstance(node.get("text"), str) and node["text"].strip():
            yield "para", node["text"].strip(), 0, ""
        for child in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()):
            if isinstance(child, dict | list):
                yield from visit(child)

    yield from visit(json.loads(content))


@reader("html", "htm")
def web(content: bytes) -> Iterator[Event]:
    page = re.sub(r"(?is)<(script|style|nav|footer|aside)\b.*?</\1\s*>|<!--.*?-->", " ", content.decode("utf-8", "ignore"))
    from html import unescape

    for m in re.finditer(r"(?is)<(h[1-6]|p|li|tr)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|p|li|tr)\b|\Z)", page):
        if text := re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", m[2]))).strip():
            tag = m[1].lower()
            yield {"l": "item", "t": "row", "p": "para"}.get(tag[0], "heading"), text, int(tag[1]) if tag[0] == "h" else 0, ""


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under a folder: ``path`` relative to it, ``domain`` (first folder), ``name, ext, length, mtime, content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").rpartition("/")[2]
    relative = F.regexp_replace("path", rf"^.*?/\Q{base}\E/", "")
    return files.select(
        relative.alias("path"),
        F.when(F.contains(relative, F.lit("/")), F.substring_index(relative, "/", 1)).otherwise("").alias("domain"),
        F.substring_index(relative, "/", -1).alias("name"),
        F.lower(F.regexp_extract(relative, r"\.([^./]+)$", 1)).alias("ext"),
        "length",
        F.col("modificationTime").alias("mtime"),
        "content",
    )


def noindex_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders, relative to ``root``, that hold a ``.noindex`` file. Spark's file sources leave out names that begin
    with a dot, so the file system is asked."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, files = fs.makeQualified(top).toString().rstrip("/") + "/", [], fs.listFiles(top, True)
    while files.hasNext():
        p = files.next().getPath()
        if p.getName() == ".noindex":
            found.append((p.getParent().toString() + "/").removeprefix(base))
    return found


def indexable(files: DataFrame, ignored: list[str] = (), off: list[str] = ()) -> DataFrame:
    """Without skipped names, ignored or hidden domains, and the folders ``off`` (see ``noindex_folders``)."""
    low = F.lower("name")
    wanted = ~F.lit(False)
    for s in SKIPPED:
        wanted = wanted & ~F.contains(low, F.lit(s))
    domain = F.lower("domain")
    wanted = wanted & ~domain.startswith(".") & ~domain.rlike(r"\.(egg|dist)-info$")
    if ignored:
        wanted = wanted & ~domain.isin(*[i.lower() for i in ignored])
    for folder in off:
        wanted = wanted & ~F.col("path").startswith(folder)
    return files.where(wanted)


def extract(files: DataFrame) -> DataFrame:
    """``path, status, events, text``; an unreadable file has the status ``failed``, never an error."""
    ship(files.sparkSession)
    readers = dict(READERS)

    def run(batches):
        for b in batches:
            out = []
            for path, ext, content in zip(b["path"], b["ext"], b["content"], strict=True):
                if ext not in readers:
                    out.append((path, "unsupported", [], ""))
                    continue
                try:
                    events = [dict(zip(("kind", "text", "level", "place"), e, strict=True)) for e in readers[ext](bytes(content))]
                    out.append((path, "ok" if events else "empty", events, "\n".join(e["text"] for e in events)))
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    out.append((path, f"failed: {type(e).__name__}", [], ""))
            yield pd.DataFrame(out, columns=["path", "status", "events", "text"])

    return files.select("path", "ext", "content").mapInPandas(run, f"path string, status string, events {_EVENTS}, text string")


def sections(extracted: DataFrame, shortest: int = 4) -> DataFrame:
    """``path, nth, level, heading, lead``: each heading with its first paragraph of at least ``shortest`` words."""
    each = extracted.select("path", F.posexplode("events").alias("at", "e")).select("path", "at", "e.*")
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    mark = each.withColumn("nth", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    para = (F.col("kind") == "para") & (F.size(F.split("text", r"\s+")) >= shortest)
    per = mark.where("nth > 0").groupBy("path", "nth").agg(
        F.min_by("level", "at").alias("level"), F.min_by("text", "at").alias("heading"), F.min_by(F.when(para, F.col("text")), F.when(para, F.col("at"))).alias("lead")
    )
    return per


def running_headers(pages: DataFrame, least_pages: int = 4) -> DataFrame:
    """Lines that open more than half of a document's pages ``(path, page, line)``."""
    per = Window.partitionBy("path")
    counted = pages.withColumn("n_pages", F.size(F.collect_set("page").over(per))).groupBy("path", "line", "n_pages").agg(F.count_distinct("page").alias("n"))
    return counted.where((F.col("n_pages") >= least_pages) & (F.col("n") * 2 > F.col("n_pages"))).select("path", "line")


def front_matter(text: Column) -> Column:
    """``key: value`` lines between a document's opening rules, as a map; empty if unterminated."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))
