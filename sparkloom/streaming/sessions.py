"""Sessions of events that come in any order.

A session is a run of events with at most ``gap`` between neighbours, kept as an interval (key, start, end).  A batch adds
points to the intervals of its own keys and merges what lies within the gap of each other: an old event can extend a
session, or join two that seemed closed, so nothing is dropped for being late and there is no watermark.  Merging is the
same in any order and for events that come twice, so a batch that is run again changes nothing.

Points of a key within one stretch of the length of the gap belong together whatever else there is; a task sends one
interval for them, so a key with a large part of all events sends few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.sources.versions import Store

NAME = "sessions"
KEY = "key"


def begin(store: Store, kind: str = "long", buckets: int = 16) -> None:
    """An empty table of sessions; nothing where there is one."""
    if NAME not in store.tables()["tables"]:
        store.replace({NAME: (store.spark.createDataFrame([], f"{KEY} {kind}, start long, end long"), [KEY])}, buckets)


def merged(intervals: DataFrame, gap: int) -> DataFrame:
    """(key, start, end) without two that lie within the gap of each other."""
    order = Window.partitionBy(KEY).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reached + gap, 0).otherwise(1)
    runs = intervals.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(KEY, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(KEY, "start", "end")


def absorb(store: Store, events: DataFrame, gap: int) -> None:
    """Events (key, at) into the sessions; rows without a time are passed over, a null key is a key."""
    points = events.where(F.col("at").isNotNull()).groupBy(KEY, F.floor(F.col("at") / (gap + 1)).alias("stretch")).agg(F.min("at").alias("start"), F.max("at").alias("end")).select(KEY, "start", "end")
    points = points.persist()
    try:
        old = store.of_keys(NAME, points.select(KEY).distinct())
        store.upsert(NAME, merged(old.unionByName(points), gap))
    finally:
        points.unpersist()
