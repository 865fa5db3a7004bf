"""Granule timelines: spans of time with data for each collection, and the records that start in them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UNITS = ("year", "month", "day", "hour", "minute", "second")


def _trunc(unit: str, c: Column) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def _plus(unit: str, c: Column) -> Column:
    if unit in ("year", "month"):
        return c + F.make_ym_interval(F.lit(1 if unit == "year" else 0), F.lit(1 if unit == "month" else 0))
    n = {"day": (1, 0, 0, 0), "hour": (0, 1, 0, 0), "minute": (0, 0, 1, 0), "second": (0, 0, 0, 1)}[unit]
    return c + F.make_dt_interval(*[F.lit(x) for x in n])


def _steps(unit: str, a: Column, b: Column) -> Column:
    """Whole units from ``a`` to ``b``, both starts of units."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "month":
        return months
    if unit == "year":
        return F.floor(months / 12)
    size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return F.floor((F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))) / size)


def sweep(events: DataFrame, key: str, at: str, change: str) -> DataFrame:
    """Events with ``running``, the sum of changes so far; starts come before ends of one time."""
    w = W.partitionBy(key).orderBy(at, F.desc(change)).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("running", F.sum(change).over(w))


def merge_adjacent(spans: DataFrame, interval: str, key: str = "collection_id") -> DataFrame:
    """Spans (key, s, e, n, left) merged where one ends a unit before the next starts; counts add up, ``left`` is the last's."""
    w = W.partitionBy(key).orderBy("s")
    apart = F.coalesce(_steps(interval, F.lag("e").over(w), F.col("s")) != 1, F.lit(True))
    d = spans.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("_span", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(key, "_span").agg(F.min("s").alias("s"), F.max_by("e", "s").alias("e"), F.max_by("left", "s").alias("left"), F.sum("n").alias("n"))


def timeline(granules: DataFrame, interval: str, start: dt.datetime, end: dt.datetime, check: bool = False) -> DataFrame:
    """(collection_id, start, end, n): spans with granules at the granularity, clipped to the request.

    Starts and ends fall to the start of their unit. A span closes where as many have ended as
    started; spans one unit apart merge; their end moves one unit on, so that it covers the unit
    that it names. Spans that never close end with the request.

    Granules are first counted by unit, so a collection's sweep has a row for each unit with
    events, however many granules it has. With ``check``, a lost granule raises.
    """
    if interval not in UNITS:
        raise ValueError(f"unknown interval: {interval}")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    meets = F.col("start_date").isNotNull() & (F.col("start_date") <= b) & (F.col("end_date").isNull() | (F.col("end_date") >= a))
    g = granules.where(meets)
    starts = g.groupBy("collection_id", _trunc(interval, F.col("start_date")).alias("at")).agg(F.count("*").alias("hits")).withColumn("change", F.col("hits"))
    ends = g.where("end_date is not null").groupBy("collection_id", _trunc(interval, F.col("end_date")).alias("at")).agg((-F.count("*")).alias("change")).withColumn("hits", F.lit(0).cast("long"))
    swept = sweep(starts.unionByName(ends), "collection_id", "at", "change")
    order = W.partitionBy("collection_id").orderBy("at", F.desc("change"))
    swept = swept.withColumn("_closed", F.coalesce(F.sum(F.when(F.col("running") == 0, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    spans = swept.groupBy("collection_id", "_closed").agg(
        F.min("at").alias("s"), F.max(F.when(F.col("change") < 0, F.col("at"))).alias("e"), F.sum("hits").alias("n"), F.sum("change").alias("left")
    )
    merged = merge_adjacent(spans, interval)
    open_ = (F.col("left") != 0) | F.col("e").isNull()
    out = merged.select(
        "collection_id", F.greatest("s", a).alias("start"), F.when(open_, b).otherwise(F.least(_plus(interval, F.col("e")), b)).alias("end"), "n"
    )
    if check:
        total, seen = g.count(), out.agg(F.sum("n")).first()[0] or 0
        if total != seen:
            raise ValueError(f"intervals hold {seen} of {total} records")
    return out
