"""XLSX without a spreadsheet library: a Python data source with one partition per worksheet.

``spark.dataSource.register(XlsxDataSource)`` then ``spark.read.format("xlsx").load(path)`` gives rows
``sheet, row, cells array<string>``; ``table`` turns a sheet into named string columns.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_index(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for ch in re.match(r"[A-Z]*", reference.upper())[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def number_text(raw: str) -> str:
    """Whole numbers without a fraction, others as they stand."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def text_of(node) -> str:
    """Runs of text, without phonetic hints."""
    if node is None:
        return ""
    return "".join((t.text or "") for r in ([node, *node.findall(f"{_MAIN}r")]) for t in r.findall(f"{_MAIN}t"))


class Workbook:
    """Sheets of a workbook, read as streams."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            self.shared = [text_of(si) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        self.sheets: list[tuple[str, str]] = []
        if "xl/workbook.xml" in names:
            targets = {}
            if "xl/_rels/workbook.xml.rels" in names:
                for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")).findall(f"{_PACKAGE}Relationship"):
                    targets[r.get("Id")] = posixpath.normpath(posixpath.join("xl", r.get("Target").lstrip("/").removeprefix("xl/")))
            for s in ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                if (part := targets.get(s.get(f"{_REL}id"))) in names:
                    self.sheets.append((s.get("name"), part))
        if not self.sheets:
            self.sheets = [(posixpath.basename(n)[:-4], n) for n in sorted(names) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]

    def cell(self, c) -> str | None:
        kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return text_of(c.find(f"{_MAIN}is")) or None
        raw = v.text if v is not None else None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(raw)] if int(raw) < len(self.shared) else None
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE"
        return raw if kind == "str" else number_text(raw)

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        """(row number from 0, cells): cell references are honoured, empty rows skipped."""
        n = 0
        with self.zip.open(part) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                at = 0
                for c in node.findall(f"{_MAIN}c"):
                    at = column_index(c.get("r")) if c.get("r") else at
                    cells[at] = self.cell(c)
                    at += 1
                node.clear()
                if any(v not in (None, "") for v in cells.values()):
                    yield n, [cells.get(i) for i in range(max(cells) + 1)]
                    n += 1


class _Sheet(InputPartition):
    def __init__(self, name: str, part: str):
        self.name, self.part = name, part


class _Reader(DataSourceReader):
    def __init__(self, content: bytes):
        self.content = content

    def partitions(self):
        return [_Sheet(n, p) for n, p in Workbook(self.content).sheets] or [_Sheet("", "")]

    def read(self, partition):
        if partition.part:
            for i, cells in Workbook(self.content).rows(partition.part):
                yield partition.name, i, cells


class XlsxDataSource(DataSource):
    """Options: ``content``, the file as hexadecimal text (set by ``cells``)."""

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        return "sheet string, row int, cells array<string>"

    def reader(self, schema):
        return _Reader(bytes.fromhex(self.options["content"]))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of one workbook. The file is read through Spark, so any store will do."""
    ship(spark)
    content = spark.read.format("binaryFile").load(path).select("content").first()
    spark.dataSource.register(XlsxDataSource)
    return spark.read.format("xlsx").option("content", bytes(content[0]).hex()).load()


def many(files: DataFrame) -> DataFrame:
    """``path, sheet, row, cells`` of a ``binaryFile`` table of workbooks, one task per file; an unreadable file gives
    one row whose sheet is null."""

    ship(files.sparkSession)
    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    book = Workbook(bytes(content))
                    out += [(path, name, i, row) for name, part in book.sheets for i, row in book.rows(part)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def clean_headers(names: list[str | None]) -> list[str]:
    """Blank headers become col_i, repeated ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        name = (n or "").strip() or f"col_{i}"
        seen[name.lower()] = k = seen.get(name.lower(), 0) + 1
        out.append(name if k == 1 else f"{name} ({k})")
    return out


def table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet, the first by default, as string columns named by its first row."""
    rows = cells(spark, path)
    if sheet is None:
        content = spark.read.format("binaryFile").load(path).select("content").first()
        sheet = Workbook(bytes(content[0])).sheets[0][0]
    rows = rows.where(F.col("sheet") == sheet)
    head = rows.where("row = 0").select("cells").first()
    names = clean_headers(list(head[0])) if head else []
    return rows.where("row > 0").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
