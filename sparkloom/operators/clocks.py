"""A device's clock over its log, as a fold that runs in parallel.

As one number (``hlc.number``), a clock v goes to max(now, v + 1) with an own event, and to
max(now, other + 1, v + 1) with an event of another device; an event whose clock can't be read leaves
it as it is.  So each step is v -> max(a, v + 1) for an a of its own, and after n steps the clock is
n plus the largest a(i) - i so far: places and running maxima, which ``ordering`` takes in buckets.
A device with half of all events is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import hlc
from sparkloom.operators import ordering


def restamped(events: DataFrame, bucket: Column) -> DataFrame:
    """(device, nth, now, other) -> the columns and hlc, the device's clock after the event.

    nth orders a device's events and now is the wall clock in milliseconds; other is the clock of
    another device's event, or null for an own one.  ``bucket`` rises with nth.  A clock starts at 0;
    until its first readable event, hlc is that of 0.
    """
    seen = hlc.parsed(F.col("other"))
    least = F.greatest(hlc.number(F.col("now"), F.lit(0)), hlc.number(seen["ms"], seen["counter"]) + 1)
    counts = F.col("other").isNull() | seen.isNotNull()
    steps = events.withColumn("__a", F.when(counts, least))
    placed = ordering.running_sum(steps, ["device"], ["nth"], bucket, F.when(counts, 1).otherwise(0), "__k")
    placed = placed.withColumn("__rest", F.when(counts, F.col("__a") - F.col("__k")))
    folded = ordering.running_max(placed, ["device"], ["nth"], bucket, "__rest", "__most")
    clock = F.greatest(F.coalesce(F.col("__most"), F.lit(0)), F.lit(0)) + F.col("__k")
    return folded.select(*events.columns, hlc.of_number(clock, F.col("device")).alias("hlc"))
