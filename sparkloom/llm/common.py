"""What the operators of this subpackage share: inputs, Arrow helpers, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.tables import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only where none is set."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        place = jsc.getCheckpointDir().get()
    return place.rstrip("/")


_MADE: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that written() made in this process; results that were not saved yet can't be read after it."""
    while _MADE:
        _delete(spark, _MADE.pop())


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes one table that written() made, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        path = next((p for p in _MADE if p.rpartition("/")[2] in file), None)
        if path:
            _MADE.remove(path)
            _delete(df.sparkSession, path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column of the frame has already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles(spark: SparkSession, rows: int, per_task: int) -> Iterator[None]:
    """Shuffles that are planned within are as wide as so many narrow rows need, at most as wide as the session's."""
    width = shuffle_width(spark)
    spark.conf.set("spark.sql.shuffle.partitions", min(width, max(8, -(-rows // per_task))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The blobs as one array, and where each ends."""
    return np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)))


def pieces(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that a batch of long texts stays small in memory."""
    if not batch.num_rows:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


def per_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = 4 << 20) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``work`` to slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute

        for batch in batches:
            for part in pieces(batch, most):
                if (out := work(part)) is not None:
                    yield out

    return run
