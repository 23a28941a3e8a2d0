"""The driver's tables, read lazily and only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


SMALL = 20 << 20  # bytes of files
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out to all cores, before work that costs much per row.

    A file's row groups are read by one task each, so a table of a few megabytes keeps one core busy however
    many there are.  Larger tables, in many row groups, are left as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


class Tables:
    """``t.orders`` is the orders table; column pruning and pushed filters reach its scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        if spark.conf.get(_BATCH) == "67108864b":  # Spark's own; batches of long texts in Python stay as small for large tables
            spark.conf.set(_BATCH, f"{BATCH_BYTES}b")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def views(self) -> None:
        """All tables as temporary views of the session."""
        for name in NAMES:
            getattr(self, name).createOrReplaceTempView(name)
