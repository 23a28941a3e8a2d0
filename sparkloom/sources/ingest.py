"""Rows that come again and again, taken into a table once: an index of the ids that are known.

``known`` holds the rows in buckets by id; a batch adds files to it and never rewrites any.  ``filters`` is a Bloom filter
in blocks of 512 bits, a row per word of 64: an id has one block, and four bits in it.  A batch asks the filter's blocks of
its own ids; ids that the filter does not know are new for certain, and only for the others the id column of their
buckets is read, which decides.  So a batch of new rows reads no rows, and one that comes again reads the buckets that it
touches; the result is exact whatever the filter says.  Rows, filter and the number of the batch change in one version of
the store: a batch that is run again changes nothing.

``compact`` puts a bucket's files together where they have become many, and makes the filter larger once it has fewer than
ten bits for an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.versions import Added, Store

BITS = 512  # of a block


def begin(store: Store, schema: str, blocks: int = 4096, buckets: int = 64) -> None:
    """Empty tables for rows of a schema, which has a string column id; nothing where there are some."""
    if "known" in store.tables()["tables"]:
        return
    empty = store.spark.createDataFrame([], schema)
    store.replace({"known": (empty, ["id"]), "filters": (store.spark.createDataFrame([], "block long, word int, bits long"), ["block", "word"])}, buckets, by={"filters": ["block"]})
    store.amend(lambda version: {}, {"known": lambda note: {"batch": -1, "rows": 0, "blocks": blocks}})


def _marks(ids: DataFrame, blocks: int) -> DataFrame:
    """(id, block, word, bits): the bits of each id, four rows of one bit."""
    h = F.xxhash64("id", F.lit(1))
    nine = [F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(BITS - 1)) for k in range(4)]
    mark = F.explode(F.array(*(F.struct((p / 64).cast("int").alias("word"), _bit(p).alias("bits")) for p in nine)))
    return ids.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), mark.alias("m")).select("id", "block", "m.*")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def _together(marks: DataFrame) -> DataFrame:
    return marks.groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))


def maybe_known(store: Store, ids: DataFrame, version: int | None = None) -> DataFrame:
    """The ids of a frame that the filter knows: all that are in the table, and a few others."""
    marks = _marks(ids, store.tables(version)["tables"]["known"]["note"]["blocks"])
    words = store.of_keys("filters", marks.select("block").distinct(), version).withColumnRenamed("bits", "there")
    asked = marks.join(words, ["block", "word"], "left")
    return asked.groupBy("id").agg(F.bool_and(F.coalesce(F.col("there").bitwiseAND(F.col("bits")) != 0, F.lit(False))).alias("all")).where("all").select("id")


def absorb(store: Store, number: int, rows: DataFrame) -> None:
    """A batch of rows; of several with one id the smallest in the order of the columns is taken.  Rows without an id are
    passed over."""
    note = store.note("known")
    if note["batch"] >= number:
        return
    rest = [c for c in rows.columns if c != "id"]
    once = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(*rest)).alias("__r")).select("id", "__r.*").persist()
    kept = [once]
    added = [0]

    def make(version: int) -> dict:
        maybe = maybe_known(store, once.select("id"), version).persist()
        kept.append(maybe)
        known = store.of_keys("known", maybe, version).select("id")
        fresh = once.join(known, "id", "left_anti").persist()
        kept.append(fresh)
        added[0] = fresh.count()
        marks = _together(_marks(fresh.select("id"), store.tables(version)["tables"]["known"]["note"]["blocks"])).persist()
        kept.append(marks)
        old = store.of_keys("filters", marks.select("block").distinct(), version).join(marks.select("block", "word"), ["block", "word"], "left_semi")
        return {"known": Added(fresh), "filters": (_together(old.unionByName(marks)), None)}

    try:
        store.amend(make, {"known": lambda n: n | {"batch": number, "rows": n["rows"] + added[0]}})
    finally:
        for df in kept:
            df.unpersist()


def compact(store: Store, most: int = 8) -> int:
    """Fewer files, and a larger filter where it is due; how many buckets were rewritten."""
    done = store.compact("known", most)
    if store.note("known")["rows"] * 10 > store.note("known")["blocks"] * BITS:
        blocks = [0]

        def make(version: int) -> dict:
            blocks[0] = -(-store.tables(version)["tables"]["known"]["note"]["rows"] * 20 // BITS)
            new = _together(_marks(store.read("known", version).select("id"), blocks[0])).withColumn("gone", F.lit(False))
            old = store.read("filters", version).join(new, ["block", "word"], "left_anti").withColumn("gone", F.lit(True))
            return {"filters": (new.unionByName(old), "gone")}

        store.amend(make, {"known": lambda n: n | {"blocks": blocks[0]}})
    return done
