"""Streams with a state for each key: bursts of file events, and sets that are reported when they change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import carry, ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_states(spark: SparkSession) -> None:
    """Prepares for stateful processors. States of many keys need the store that lies on disk; streams that were started before keep their own."""
    carry(__name__)
    ship(spark)
    _on_disk(spark)


def _on_disk(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, _ROCKS)


# -- bursts


def merged(pieces: pd.DataFrame, quiet: int) -> pd.DataFrame:
    """What ``debounced`` makes of a key's events in memory: ``first, last, path, kind, at, seq, n``, one row for each burst
    and path. Pieces less than ``quiet`` apart are one burst, in which a path's latest event wins, of equal times the one
    with the larger ``seq``."""
    pieces = pieces.sort_values(["first", "last", "at", "seq"], kind="stable", ignore_index=True)
    before = pieces["last"].cummax().shift(fill_value=pieces["first"].iloc[0])
    burst = (pieces["first"] - before >= quiet).cumsum()
    spans = pieces.groupby(burst).agg(first=("first", "min"), last=("last", "max"))
    newest = pieces.assign(burst=burst).sort_values(["at", "seq"], kind="stable").groupby(["burst", "path"], sort=True)
    out = newest.agg(kind=("kind", "last"), at=("at", "last"), seq=("seq", "last"), n=("n", "sum")).reset_index()
    return out.join(spans, on="burst")[["first", "last", "path", "kind", "at", "seq", "n"]]


def debounced(events: DataFrame, quiet: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """The stream of ``folder, first_at, last_at, n_events, removed, indexed`` from ``folder, path, kind, at, seq``: a
    folder's burst leaves once no event has come for ``quiet``, with the paths to take out of an index and then those to
    put in, by the last event of each, of equal times the one with the larger ``seq``. A burst is a session window. Events
    that are ``late`` and ``quiet`` behind the newest are dropped, others find their burst in whatever order they come, and
    may join two; one whose burst has left makes another. An event exactly ``quiet`` after another begins a burst of its own. The state holds the events of open
    bursts; a folder with too many of them is to be cut into smaller ones by the caller."""
    spark = events.sparkSession
    _on_disk(spark)
    # session windows that touch are one, so they end just before what begins another burst
    micros = int(spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {quiet})")).first()[0])
    event = F.struct("path", "at", "seq", "kind")
    bursts = events.withWatermark("at", late).groupBy(F.session_window("at", f"{micros - 1} microseconds"), "folder").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_events"), F.sort_array(F.collect_list(event)).alias("events")
    )
    # in order of paths, then of time: a path's last event is followed by another path or by nothing
    newest = F.filter("events", lambda e, i: (i == F.size("events") - 1) | ~F.get("events", i + 1)["path"].eqNullSafe(e["path"]))
    paths = lambda gone: F.transform(F.filter("newest", lambda e: e["kind"].eqNullSafe("deleted") == gone), lambda e: e["path"])
    told = bursts.select("folder", "first_at", "last_at", "n_events", newest.alias("newest"))
    return told.select("folder", "first_at", "last_at", "n_events", paths(True).alias("removed"), paths(False).alias("indexed"))


# -- sets that are reported when they change


class ChangedSets(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reported = handle.getValueState("reported", "items array<string>", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: set[str] = set()
        for b in rows:
            found.update(b["item"].dropna())
        items = sorted(found)
        old = self.reported.get() if self.reported.exists() else None
        if old is None or list(old[0]) != items:
            self.reported.update((items,))
            yield pd.DataFrame({"key": [key[0]], "items": [items], "n_before": [None if old is None else len(old[0])]}).astype({"n_before": "Int64"})

    def close(self) -> None:
        pass


def changed_sets(rows: DataFrame, keep: str = "1 day") -> DataFrame:
    """The stream of ``key, items, n_before`` from ``key, item``: what a micro-batch has of a key, told only when it isn't
    the set last told. A set is forgotten ``keep`` after it was told, and then told again. Keys that a batch doesn't have
    say nothing; null items aren't in a set."""
    spark = rows.sparkSession
    keep_states(spark)
    ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_micros(0) + interval {keep})")).first()[0])
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.col("item").cast("string").alias("item")).groupBy("key").transformWithStateInPandas(
        ChangedSets(ms), f"key {kind}, items array<string>, n_before bigint", "Update", "ProcessingTime"
    )
