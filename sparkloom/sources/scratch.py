"""Folders for intermediate tables: in the place that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        place = context.getCheckpointDir().get()
    return f"{place.rstrip('/')}/{label}-{uuid.uuid4().hex}"
