"""Pages: one file for each row, written by the tasks that have the rows.

``write(rows, root)`` takes ``(path, content)``. A page is replaced only if its content differs, in one move, so readers see
the old or the new page and a task that runs twice changes nothing the second time. Null content deletes the page. When
all tasks are done, the driver records how many pages were written, kept and deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship

FORMAT = "millrace_pages"
#: Where a root keeps its records of writes and unfinished pages; no page may lie there.
PRIVATE = "_pages"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    found, path = fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


def inside(path: str) -> str:
    """``path``, if it stays below the root it is relative to."""
    parts = PurePosixPath(path).parts
    if not parts or path.startswith("/") or ".." in parts or parts[0] == PRIVATE:
        raise ValueError(f"not a page below its root: {path!r}")
    return "/".join(parts)


def put(files: fs.FileSystem, target: str, content: bytes, unfinished: str) -> bool:
    """Replaces a file in one move if its content differs; tells whether it did."""
    known = files.get_file_info(target)
    if known.type == fs.FileType.File and known.size == len(content):
        with files.open_input_stream(target) as f:
            if f.read() == content:
                return False
    files.create_dir(target.rpartition("/")[0])
    with files.open_output_stream(unfinished) as f:
        f.write(content)
    files.move(unfinished, target)
    return True


@dataclass
class Done(WriterCommitMessage):
    written: int = 0
    kept: int = 0
    deleted: int = 0


class PageWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        files, root = located(self.root)
        files.create_dir(f"{root}/{PRIVATE}/unfinished")
        done = Done()
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").cast(pa.binary()).to_pylist(), strict=True):
                target = f"{root}/{inside(path)}"
                if content is not None:
                    changed = put(files, target, content, f"{root}/{PRIVATE}/unfinished/{uuid.uuid4().hex}")
                    done.written, done.kept = done.written + changed, done.kept + (not changed)
                elif files.get_file_info(target).type == fs.FileType.File:
                    files.delete_file(target)
                    done.deleted += 1
        return done

    def commit(self, messages: list) -> None:
        files, root = located(self.root)
        record = Done(*(sum(getattr(m, c) for m in messages) for c in ("written", "kept", "deleted")))
        with files.open_output_stream(f"{root}/{PRIVATE}/{self.run}.json") as f:
            f.write(json.dumps(record.__dict__).encode())
        files.delete_dir_contents(f"{root}/{PRIVATE}/unfinished", missing_dir_ok=True)

    def abort(self, messages: list) -> None:
        """Pages that were replaced are whole, and the next write finds them as they should be."""


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["root"])


def write(rows: DataFrame, root: str, path: Column | str = "path", content: Column | str = "content") -> dict[str, int]:
    """Writes the pages and returns ``written``, ``kept`` and ``deleted``. Two rows with one path are an error of the
    caller: either may win."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Pages)
    before = records(spark, root)
    named = [c if isinstance(c, Column) else F.col(c) for c in (path, content)]
    rows.select(named[0].cast("string").alias("path"), named[1].alias("content")).write.format(FORMAT).option("root", root).mode("append").save()
    (new,) = records(spark, root).keys() - before.keys()
    return records(spark, root)[new]


def records(spark: SparkSession, root: str) -> dict[str, dict[str, int]]:
    files, top = located(root)
    found = files.get_file_info(fs.FileSelector(f"{top}/{PRIVATE}", allow_not_found=True))
    out = {}
    for f in found:
        if f.path.endswith(".json"):
            with files.open_input_stream(f.path) as s:
                out[f.base_name] = json.loads(s.read())
    return out
