"""Sources over many runs, as state that a stream keeps: failures in a row, and the items seen before.

A run row is (source, run, transient, items): what one visit to a source gave.  A transient failure adds to the
source's count of failures in a row, and from ``DOWN`` on the source is down; any other outcome sets it to 0.  Items of
runs that did not fail are new if no earlier run of the source had them.  Runs of a source are taken in order; a row of
a run that the source has had already changes nothing, so a batch that is read again gives no second row.

State is one value per source and a map of its items, kept by the stream's state store under the checkpoint: a restart
goes on from there, and a batch reads the state of its own sources alone.  Each look at the state is a call to the JVM, so
a batch asks for each of its items once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DOWN = 3
RUNS = "source long, run long, transient boolean, items array<string>"
STATES = "source long, run long, failures long, down boolean, n_items long, n_new long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Health(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "run long, failures long")
        self.seen = handle.getMapState("seen", "item string", "run long")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))  # a source's runs in one batch
        before = self.last.get()
        run, failures = before or (None, 0)
        out, asked = [], set()

        def is_new(item: str) -> bool:
            """Each item of the batch is asked for once, and none where the source has had no run."""
            if item in asked:
                return False
            asked.add(item)
            return before is None or not self.seen.containsKey((item,))

        for row in frame.sort_values("run", kind="stable").itertuples():
            if run is not None and row.run <= run:
                continue
            run, failures = int(row.run), failures + 1 if row.transient else 0
            items = set() if row.transient or row.items is None else {i for i in row.items if i is not None}
            new = [i for i in sorted(items) if is_new(i)]
            for item in new:
                self.seen.updateValue((item,), (run,))
            out.append((key[0], run, failures, failures >= DOWN, len(items), len(new)))
        if out:
            self.last.update((run, failures))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """States of several variables need this store; queries that are started within use it."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def follow(runs: DataFrame, out: str, checkpoint: str):
    """A stream of run rows into the states after each run, as a table that is only added to; it ends when all is read."""
    spark = runs.sparkSession
    states = runs.where("source IS NOT NULL AND run IS NOT NULL").groupBy("source").transformWithStateInPandas(Health(), STATES, "Append", "None")
    with _rocks(spark):
        return states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
