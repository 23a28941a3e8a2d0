"""Sinks: log appends, catalogue files, audit tables, encrypted packets."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import hlc
from sparkloom.operators import ordering


def append_log(events: DataFrame, path: str) -> None:
    """The log is only ever appended to, by entity."""
    events.write.mode("append").partitionBy("entity").parquet(path)


def materialise(df: DataFrame, path: str, *sort: str) -> DataFrame:
    """A summary written once, sorted inside its files so that row groups can be skipped, and read from then on."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df_writer, spark, folder: str) -> None:
    """Writes a folder anew beside the old one and puts it in its place.  Readers never see a half of it, but for a moment
    none; where that matters, or several writers, ``versions.Store`` has whole versions at any time."""
    fresh = f"{folder}.new-{uuid.uuid4().hex}"
    df_writer(fresh)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(folder), True)
    if not system.rename(path(fresh), path(folder)):
        raise OSError(f"{folder} could not be replaced")


def transaction(frames: dict[str, DataFrame], folder: str) -> None:
    """Several tables that change together: all are written anew, then the folder that holds them is replaced."""

    def write(place: str) -> None:
        for name, df in frames.items():
            df.write.parquet(f"{place}/{name}")

    replaced(write, next(iter(frames.values())).sparkSession, folder)


@contextmanager
def writer(spark, folder: str, attempts: int = 50, wait: float = 0.1) -> Iterator[None]:
    """One writer at a time: a lock file that is created only where there is none, and goes with the writer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}.lock")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for _ in range(attempts):
        if system.createNewFile(path):
            break
        time.sleep(wait)
    else:
        raise TimeoutError(f"{folder} has another writer")
    try:
        yield
    finally:
        system.delete(path, False)


def catalogue(items: DataFrame, folder: str) -> None:
    """The catalogue as JSON lines, with a manifest of counts and a report in Markdown."""

    def write(place: str) -> None:
        items.write.json(f"{place}/items")
        counts = items.groupBy("source").agg(F.count("*").alias("n"), F.max("day").alias("latest")).coalesce(1)  # a row per source
        counts.write.json(f"{place}/manifest")
        line = F.concat(F.lit("| "), F.coalesce("source", F.lit("")), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.coalesce(F.col("latest").cast("string"), F.lit("")), F.lit(" |"))
        head = items.sparkSession.createDataFrame([(0, "| source | items | latest |"), (1, "|-|-|-|")], "k int, value string")
        rows = counts.select(F.lit(2).alias("k"), line.alias("value"))
        head.unionByName(rows).coalesce(1).sortWithinPartitions("k", "value").select("value").write.text(f"{place}/report")

    replaced(write, items.sparkSession, folder)


def derived_key(passphrase: str, salt: bytes, rounds: int = 210_000) -> Column:
    """A 32-byte key of a passphrase (PBKDF2, SHA-256), derived once, on the driver."""
    return F.lit(hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32))


def audit(frames: list[DataFrame], folder: str) -> None:
    """Audit rows of differing columns as one CSV table under all their headers."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole.write.mode("overwrite").option("header", True).csv(folder)


def sealed(payload: Column, key: Column) -> Column:
    """AES-GCM of a text, base 64; the key is 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM")))


def opened(packet: Column, key: Column) -> Column:
    """The text of a packet; null if it was tampered with or sealed with another key."""
    return F.try_aes_decrypt(F.unbase64(packet), key, F.lit("GCM")).cast("string")


def packets(log: DataFrame, key: Column, rows: int = 500) -> DataFrame:
    """The log in sealed packets of about ``rows`` rows, each device's in order."""
    numbered = ordering.numbered(log, ["device"], ["hlc", "id"], hlc.stretch(F.col("hlc")), "nth").withColumn("packet", F.floor(F.col("nth") / rows))
    body = F.to_json(F.array_sort(F.collect_list(F.struct("hlc", "id", "entity", "entity_id", "kind", "payload"))))
    return numbered.groupBy("device", "packet").agg(F.count("*").alias("n"), sealed(body, key).alias("body"))
