"""Creations, changes and deletions of files as a stream.

Spark's file streams see new files only. This source's offsets are the numbers of stored listings: whenever the folder
looks different, its listing is stored under the next number, and the rows of a micro-batch are what differs between two
listings. A stream that is started again goes on from the listing of its checkpoint, so nothing is lost or told twice,
whatever happened to the folder in between. Listings are stored in buckets by path, which tasks compare side by side.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import carry
from ..sources import pages
from ..sources.pages import located

FORMAT = "millrace_folder"
LISTING = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
#: Listings that stay behind the committed one: Spark may go back that many batches.
KEPT = 100


@dataclass
class Piece(InputPartition):
    start: int
    end: int
    bucket: int


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.listings = options["path"], options["listings"]
        self.pattern = options.get("pattern", "*")
        self.ignored = [p for p in options.get("ignore", "_*,.*").split(",") if p]
        self.buckets = int(options.get("buckets", "16"))

    # -- listings

    def now(self) -> pa.Table:
        """The folder's files by path. Parts of a path that an ignored pattern matches are left out."""
        files, root = located(self.root)
        rows = []
        for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type != fs.FileType.File:
                continue
            path = f.path[len(root) + 1 :]
            if fnmatch.fnmatch(f.base_name, self.pattern) and not any(fnmatch.fnmatch(part, p) for part in path.split("/") for p in self.ignored):
                rows.append((path, f.size, f.mtime_ns // 1000))
        rows.sort()
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()).cast(LISTING.field("modified").type)], schema=LISTING)

    def numbers(self) -> list[int]:
        """Stored listings; one is stored when its last bucket has been moved into place as a whole folder."""
        files, top = located(self.listings)
        found = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return sorted(int(f.base_name[8:]) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("listing-"))

    def bucket(self, number: int, bucket: int) -> pa.Table:
        """A bucket of a listing; listing 0 is of an empty folder."""
        if number == 0:
            return LISTING.empty_table()
        files, top = located(self.listings)
        return pq.read_table(f"{top}/listing-{number}/{bucket}.parquet", filesystem=files)

    def store(self, listing: pa.Table, number: int) -> None:
        files, top = located(self.listings)
        unfinished = f"{top}/unfinished-{number}"
        files.create_dir(unfinished)
        of = pa.array([zlib.crc32(p.encode()) % self.buckets for p in listing.column("path").to_pylist()], pa.int64())
        for k in range(self.buckets):
            pq.write_table(listing.filter(pc.equal(of, k)), f"{unfinished}/{k}.parquet", filesystem=files)
        files.move(unfinished, f"{top}/listing-{number}")

    # -- what Spark asks

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self.numbers(), default=0)
        listing = self.now()
        known = pa.concat_tables([self.bucket(last, k) for k in range(self.buckets)]).sort_by("path")
        if listing.equals(known):
            return {"listing": last}
        self.store(listing, last + 1)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        a, b = start["listing"], end["listing"]
        return [Piece(a, b, k) for k in range(self.buckets)] if a != b else []

    def read(self, partition: Piece) -> Iterator[tuple]:
        before, after = ({r["path"]: r for r in self.bucket(n, partition.bucket).to_pylist()} for n in (partition.start, partition.end))
        for path in sorted(before.keys() | after.keys()):
            old, new = before.get(path), after.get(path)
            if old != new:
                row = new or old
                yield path, path.rpartition("/")[0], "created" if not old else "deleted" if not new else "modified", row["size"], row["modified"], partition.end

    def commit(self, end: dict) -> None:
        files, top = located(self.listings)
        for n in self.numbers():
            if n < end["listing"] - KEPT:
                files.delete_dir(f"{top}/listing-{n}")


class FolderEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, folder string, kind string, size long, modified timestamp, listing long"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def watch(spark: SparkSession, root: str, listings: str, pattern: str = "*", **options: str) -> DataFrame:
    """The stream of ``path, folder, kind, size, modified, listing``: ``kind`` is created, modified or deleted (by size
    and time of change), a moved file is deleted and created. ``listings`` is a folder of this stream's own beside its
    checkpoint, on storage that driver and executors share. Names that begin with ``_`` or ``.`` are ignored unless the
    option ``ignore`` says otherwise."""
    carry(__name__, pages.__name__)
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format(FORMAT).option("path", root).option("listings", listings).option("pattern", pattern).options(**options).load()
