"""Temporal list join: captures against the URL list entries that were active when they were fetched.

Dated add and remove entries become validity intervals. A capture asks for every key that can name it, its host and
the host's parent domains, each with its leading path folders. What is asked, a key and a time, is put between the
starts of the key's intervals in the order of time and takes the last one before it, so the join costs one sorted pass
however long a key's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import named, small, stored

#: Interval rows up to which the list is broadcast; about 100 bytes each.
BROADCAST_INTERVALS = 200_000


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, key, since, until)`` from ``entries (list, key, action, at)``.

    An ``add`` holds from its time, included, to the next entry of the same list and key, excluded; without one,
    ``until`` is null. A ``remove`` that follows nothing has no effect; of entries at one time the removal counts.
    Entries with a null list, key, action or time are ignored; repeated ones do no harm.
    """
    known = entries.select("list", "key", "action", "at").dropna().distinct()
    order = Window.partitionBy("list", "key").orderBy("at", "action")
    return known.withColumn("until", F.lead("at").over(order)).where("action = 'add' and (until is null or until > at)").select("list", "key", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column, folders: int) -> Column:
    """All keys that name a URL: ``host`` and its parents of at least two labels, alone and with 1 to ``folders``
    leading path segments (``a.example.com/x/y``)."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    hosts = F.when(
        n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    ).otherwise(F.array(host(url)))
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    depths = F.sequence(F.lit(0), F.least(F.lit(folders), F.size(segments)))
    return F.array_distinct(
        F.flatten(
            F.transform(
                hosts, lambda h: F.transform(depths, lambda d: F.when(d == 0, h).otherwise(F.concat(h, F.lit("/"), F.array_join(F.slice(segments, 1, d), "/"))))
            )
        )
    )


def slices(at: Column, kind: T.DataType) -> Column:
    """The month of a date or timestamp, by which a key's history is cut; other times aren't cut."""
    dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return F.year(at) * 12 + F.month(at) if dated else F.lit(0)


def as_of(asked: DataFrame, valid: DataFrame) -> DataFrame:
    """``(key, t, list)``: for each row of ``asked (key, t)`` and each list that has the key, whether its last interval
    that began at or before ``t`` still holds, by sorting and not by comparing times with intervals.

    A key's captures and intervals are dealt by list, key and month, so a hot key is sorted in as many tasks as it has
    months; each month begins with the interval that the months before leave.
    """
    kind = valid.schema["since"].dataType
    empty = F.lit(None).cast(kind)
    wanted = asked.join(valid.select("list", "key").distinct(), "key").select("list", "key", F.col("t").cast(kind).alias("at"), F.col("t"), empty.alias("since"), empty.alias("until"))
    starts = valid.select("list", "key", F.col("since").alias("at"), F.lit(None).cast(asked.schema["t"].dataType).alias("t"), "since", "until")
    events = wanted.unionByName(starts).withColumn("slice", slices(F.col("at"), kind))
    order = Window.partitionBy("list", "key", "slice").orderBy("at", F.col("since").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select("*", F.last(F.when(F.col("since").isNotNull(), F.struct("since", "until")), True).over(order).alias("now"))
    # the last interval that began in each month, and with it what every month finds at its beginning
    ends = valid.withColumn("slice", slices(F.col("since"), kind)).groupBy("list", "key", "slice").agg(F.max_by(F.struct("since", "until"), "since").alias("left"))
    months = wanted.select("list", "key", slices(F.col("at"), kind).alias("slice")).distinct().join(ends, ["list", "key", "slice"], "full")
    before = Window.partitionBy("list", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    found = months.select("list", "key", "slice", F.last("left", True).over(before).alias("found"))
    held = seen.where("t is not null").join(found, ["list", "key", "slice"], "left").withColumn("now", F.coalesce("now", "found"))
    return held.where(F.col("now").isNotNull() & (F.col("now.until").isNull() | (F.col("at") < F.col("now.until")))).select("key", "t", "list")


def active_lists(captures: DataFrame, entries: DataFrame, folders: int | None = None, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``n_entries`` (active entries that name the URL), ``lists`` (their lists, sorted,
    comma-joined; empty if none) and ``blocked``.

    A null URL or fetch time matches nothing; every row of ``captures`` comes back once, repeated rows too. Columns of
    ``captures`` named like a new one are replaced, all others kept whatever their names. Equal (URL, time) pairs are
    asked once, and of them equal (key, time) pairs. A URL asks for as many leading folders as the deepest interval
    has, or for ``folders`` if that is given. Listed keys and what matched are broadcast while they have at most
    ``BROADCAST_INTERVALS`` rows; beyond that, keys are shuffled and Spark splits hot ones.
    """
    valid = stored(intervals(entries), "intervals")
    rows, deepest = valid.agg(F.count("*"), F.max(F.size(F.split("key", "/")) - 1)).first()
    listed = valid.select("key").distinct()
    folders = (deepest or 0) if folders is None else folders
    asked = captures.select(named(url_col).alias("u"), named(at_col).alias("t")).dropna().distinct()
    each = asked.select("u", "t", F.explode(keys(F.col("u"), folders)).alias("key"))
    each = stored(each.join(F.broadcast(listed) if rows <= BROADCAST_INTERVALS else listed, "key", "left_semi"), "asked")
    hits = stored(as_of(each.select("key", "t").distinct(), valid), "active")
    each = each.join(F.broadcast(hits) if small(hits, BROADCAST_INTERVALS) else hits, ["key", "t"])
    found = each.groupBy("u", "t").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("names"))
    found = found.select("u", "t", F.struct("n", "names").alias("found"))
    new = ("host", "n_entries", "lists", "blocked")
    plain = captures.select(F.struct(*(named(c) for c in captures.columns if c not in new)).alias("row"), named(url_col).alias("u"), named(at_col).alias("t"))
    return plain.join(found, ["u", "t"], "left").select(
        "row.*",
        F.coalesce(host(F.col("u")), F.lit("")).alias("host"),
        F.coalesce("found.n", F.lit(0).cast("long")).alias("n_entries"),
        F.coalesce("found.names", F.lit("")).alias("lists"),
        F.col("found").isNotNull().alias("blocked"),
    )
