"""A log read page by page in the order of its arrival times, as a server stamps them.

A row may become visible after rows of later stamps (its writer was slow to commit), so each page starts a margin before
the cursor, without the rows that are kept already.  Pages go by (arrived, id).  The kept rows and the cursor change in
one version of a ``versions.Store``: a reader that dies at any step reads its page again, and a row that comes twice is
one row, by its id: the one that arrived last.  Stamps further ahead than ``AHEAD_MS`` of the reader's own clock are kept but don't move the cursor,
which would else pass over all that comes before them.

Each version writes the buckets that its page touches again, so ``follow`` takes pages of half of what is kept, once that is
more than was asked for: all pages of a backlog together write a few times the table, not its size times their number.
A page of more than ``SORTED`` rows ends at a stamp near that number, so that no task sorts it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.versions import Store

MARGIN_MS = 10 * 60_000
AHEAD_MS = 60_000
PAGE = 20_000
SORTED = 100_000
NAME = "arrivals"


def begin(store: Store, schema: DataFrame, buckets: int = 16) -> None:
    """An empty table for rows of a log that has id and arrived (milliseconds); nothing where there is one."""
    if NAME not in store.tables()["tables"]:
        store.replace({NAME: (schema.limit(0), ["id"])}, buckets)


def page(store: Store, log: DataFrame, margin_ms: int = MARGIN_MS, rows: int = PAGE) -> DataFrame:
    """The next rows that are not kept yet, in the order of their arrival."""
    cursor = store.note(NAME).get("cursor")
    kept, new = store.read(NAME), log.where("id IS NOT NULL AND arrived IS NOT NULL")
    if cursor is not None:
        new, kept = new.where(F.col("arrived") > cursor - margin_ms), kept.where(F.col("arrived") > cursor - margin_ms)
    known = kept.select(F.col("id").alias("__id"), F.col("arrived").alias("__at"))
    fresh = new.join(known, (F.col("id") == F.col("__id")) & (F.col("__at") >= F.col("arrived")), "left_anti")
    if rows <= SORTED:
        return fresh.orderBy("arrived", "id").limit(rows)
    n = fresh.count()
    return fresh.where(F.col("arrived") <= fresh.approxQuantile("arrived", [rows / n], 0.001)[0]) if n > rows else fresh


def pull(store: Store, log: DataFrame, now_ms: int, margin_ms: int = MARGIN_MS, rows: int = PAGE) -> int:
    """Reads a page; the number of rows, 0 when there is nothing new."""
    part = page(store, log, margin_ms, rows)
    one = part.groupBy("id").agg(F.max_by(F.struct(*part.columns), "arrived").alias("r")).select("r.*").persist()
    try:
        n, last = one.agg(F.count("*"), F.max(F.when(F.col("arrived") <= now_ms + AHEAD_MS, F.col("arrived")))).first()
        if n:
            store.upsert(NAME, one, note=lambda old: {"rows": old.get("rows", 0) + n, "cursor": max((x for x in (old.get("cursor"), last) if x is not None), default=None)})
        return n
    finally:
        one.unpersist()


def follow(store: Store, log: DataFrame, now_ms: int, margin_ms: int = MARGIN_MS, rows: int = PAGE) -> int:
    """Page after page until there is nothing new; the number of rows.  Pages are of so many rows, or of half of those kept."""
    total = 0
    while n := pull(store, log, now_ms, margin_ms, max(rows, store.note(NAME).get("rows", 0) // 2)):
        total += n
    return total
