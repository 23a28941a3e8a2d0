"""The log's projection kept up to date from a stream of events.

Each micro-batch adds the ids it has not seen to the log and folds their writes into the latest
ones that are kept, so the outcome equals one batch over everything and the log itself is not read
again (but for its ids).  Nothing is dropped for being late: an event counts where its clock puts
it, whenever it arrives, so there is no watermark, and re-read rows are dropped by id.

State is two tables in a folder that driver and executors share: log/batch=<n>, and latest writes
in ``BUCKETS`` buckets of entities, state/version=<n>/bucket=<k>.  A batch writes the buckets that
it touches; a bucket's state is its last version.  A batch that is run again after a failure
overwrites its own folders, which makes the sink idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import eventlog

BUCKETS = 64


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match, in one look at the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def _number(path: str, name: str) -> int:
    return int(path.rsplit(f"{name}=", 1)[1].split("/")[0])


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _states(spark: SparkSession, folder: str, before: int) -> dict[int, str]:
    """Bucket -> folder of its last version before that number."""
    last: dict[int, str] = {}
    for path in sorted(_folders(spark, f"{folder}/state/version=*/bucket=*"), key=lambda p: _number(p, "version")):
        if _number(path, "version") < before:
            last[_number(path, "bucket")] = path
    return last


def bucket() -> Column:
    return F.pmod(F.xxhash64(*eventlog.KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def absorb(batch: DataFrame, number: int, folder: str) -> None:
    """One micro-batch of log rows into the log and the state."""
    spark = batch.sparkSession
    earlier = [p for p in _folders(spark, f"{folder}/log/batch=*") if _number(p, "batch") < number]
    fresh = eventlog.merge_new(_read(spark, earlier, batch.schema), batch)
    fresh.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
    fresh = spark.read.schema(batch.schema).parquet(f"{folder}/log/batch={number}")
    touched = {r.bucket for r in fresh.select(bucket()).distinct().collect()}  # at most BUCKETS numbers
    before = _read(spark, [p for k, p in _states(spark, folder, number).items() if k in touched], eventlog.LATEST)
    now = eventlog.settled(before.unionByName(eventlog.latest_writes(fresh)))
    now.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/version={number}")


def follow(events: DataFrame, folder: str, checkpoint: str):
    """A streaming query over events that keeps the state in ``folder``."""
    log = eventlog.log_of_events(events)
    return log.writeStream.foreachBatch(lambda batch, n: absorb(batch, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The projection after that batch."""
    return eventlog.living(_read(spark, list(_states(spark, folder, version + 1).values()), eventlog.LATEST))


def next_cursor(server_ms: Column, last_arrival_ms: Column, finished: Column, old: Column, margin_ms: int = 600_000) -> Column:
    """Where the next read starts: ten minutes before the server's time, or at the last row of an unfinished
    read if that is earlier.  A server time that is not there, or more than a second before a row that has
    arrived, can't be right and leaves the old place."""
    wrong = F.coalesce(server_ms <= 0, F.lit(True)) | F.coalesce(last_arrival_ms > server_ms + 1000, F.lit(False))
    limit = server_ms - margin_ms
    return F.when(wrong, old).when(finished | last_arrival_ms.isNull(), limit).otherwise(F.least(last_arrival_ms, limit))


#: Events that make an exchange urgent; milliseconds between exchanges, at least and by courtesy.
URGENT_EVENTS, LEAST_MS, COURTESY_MS = 25, 90_000, 15 * 60_000


def backoff_minutes(failures: Column) -> Column:
    """0 without failures, then 1, 2, 4 ... 30 minutes."""
    return F.when(failures <= 0, 0.0).otherwise(F.least(F.lit(30.0), F.pow(F.lit(2.0), failures - 1)))


def exchange(pending: Column, since_ms: Column, failures: Column, low_battery: Column, able: Column) -> Column:
    """Whether to exchange now: 'urgent', 'normal', or null for not now.

    ``able`` says that there is somebody to exchange with, nothing is under way and the application is in front;
    ``since_ms`` is null before the first exchange.
    """
    waits = ~able | (low_battery & (pending < URGENT_EVENTS)) | ((failures > 0) & F.coalesce(since_ms < backoff_minutes(failures) * 60_000, F.lit(False)))
    return F.when(waits, None).when(since_ms.isNull(), "urgent").when(since_ms < LEAST_MS, None).when(pending >= URGENT_EVENTS, "urgent").when(since_ms >= COURTESY_MS, "normal")


#: Minutes since the last exchange within which logs count as close, and from which as far apart.
CLOSE_MINUTES, FAR_MINUTES = 60, 240


def divergence(pending: Column, since_minutes: Column) -> Column:
    """How far two logs are apart, by events not sent and minutes since the last exchange (null: never)."""
    far = since_minutes.isNull() | (pending >= URGENT_EVENTS) | (since_minutes >= FAR_MINUTES)
    return F.when((pending == 0) & F.coalesce(since_minutes < CLOSE_MINUTES, F.lit(False)), "allineati").when(far, "marcata").otherwise("leggera")


def weekly_windows(events: DataFrame) -> DataFrame:
    """Event-time roll-up by week with a watermark, for monitoring, where late rows may be missed."""
    stamped = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return stamped.withWatermark("ts", "7 days").groupBy(F.window("ts", "7 days", startTime="4 days"), "event_type").agg(F.count("*").alias("n"))
