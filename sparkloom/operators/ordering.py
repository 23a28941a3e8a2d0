"""Order within a key when one key may hold a large part of all rows.

A window over such a key is one task's.  Here a key's rows are taken in buckets of the order (for
a change log, stretches of time): windows run within a bucket, and only a row per bucket meets on
the key to carry counts, last rows or maxima over.  Null keys are a key like any other, and so is a null
bucket, which comes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from sparkloom.sources.scratch import scratch


def _carried(rows: DataFrame, carried: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows and what is carried into their bucket, joined so that null keys meet null keys."""
    on = [*keys, "__bucket"]
    named = carried.withColumnsRenamed({k: f"__c{n}" for n, k in enumerate(on)})
    meet = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__c{n}")) for n, k in enumerate(on)))
    return rows.join(named, meet, how)


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """The rows with their place, from 0, among the rows of their key; ``bucket`` rises with the order."""
    placed = df.withColumn("__bucket", bucket)
    counts = placed.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket"))
    before = counts.select(*keys, "__bucket", (upto - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    joined = placed.withColumn(name, within.cast("bigint"))
    joined = _carried(joined, before, keys, "inner")
    return joined.withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, columns: list[str], name: str) -> DataFrame:
    """The rows with a struct of the columns of the row before in their key, null for the first."""
    row = F.struct(*columns)
    placed = df.withColumn("__bucket", bucket)
    last = placed.groupBy(*keys, "__bucket").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    carried = last.select(*keys, "__bucket", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__carried"))
    within = F.lag(row).over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    joined = placed.withColumn(name, within)
    joined = _carried(joined, carried.where("__carried IS NOT NULL"), keys, "left")
    return joined.withColumn(name, F.coalesce(name, "__carried")).select(*df.columns, name)


def running_max(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """The rows with the largest value of their key so far."""
    placed = df.withColumn("__bucket", bucket)
    tops = placed.groupBy(*keys, "__bucket").agg(F.max(value).alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "__bucket", F.max("__top").over(before).alias("__carried"))
    within = F.max(value).over(Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = _carried(placed.withColumn(name, within), carried, keys, "inner")
    return joined.withColumn(name, F.greatest(name, "__carried")).select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """The rows with the sum of a value over their key so far."""
    placed = df.withColumn("__bucket", bucket).withColumn("__v", value)
    sums = placed.groupBy(*keys, "__bucket").agg(F.sum("__v").alias("__s"))
    upto = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__bucket"))
    before = sums.select(*keys, "__bucket", (upto - F.col("__s")).alias("__before"))
    within = F.sum("__v").over(Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = _carried(placed.withColumn(name, within), before, keys, "inner")
    return joined.withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def running_total(df: DataFrame, order: list[Column], value: str, name: str, most: int | None = None) -> DataFrame:
    """The rows with the sum of a value over one long order; with ``most`` only those whose sum stays within it.

    The rows are dealt out in ranges of the order and written, as ranges are drawn from samples; a sum per range gives
    what is before it, and windows run within ranges.  The order is total.  Values are not negative where ``most`` is given:
    ranges that begin beyond it are not read again.
    """
    spark, part = df.sparkSession, F.col("__part")
    place = scratch(spark, "ranges")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()).write.parquet(place)
    ranges = spark.read.schema(StructType([*df.schema.fields, StructField("__part", IntegerType())])).parquet(place)
    sums = ranges.groupBy("__part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__s"))  # a row per range
    before = sums.select(part, (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))
    before = before if most is None else before.where(F.col("__before") <= most)
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranges.join(F.broadcast(before), "__part").withColumn(name, F.coalesce(within, F.lit(0)) + F.col("__before"))
    out = out if most is None else out.where(F.col(name) <= most)
    return out.select(*df.columns, name)
