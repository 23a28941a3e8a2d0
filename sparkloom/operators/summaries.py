"""A summary of a join, kept by differences.

Facts (id, dim, value) belong to rows of a dimension (dim, and the columns that the summary is grouped by).  The summary
has, for each group, the number of facts, and the sum, least and greatest of their values.  A batch of inserts, updates and
deletes of both tables becomes signed rows, which go through the join and the grouping:

    changes of (facts x dims)  =  changes of facts x dims as they were  +  facts as they are x changes of dims

Counts and sums are added.  A least value that is taken away can't be found by adding, so the values themselves are kept
with their counts, in slots of ``SLOT`` neighbouring values: a slot has at most that many rows, however many facts there
are, and a batch counts again the slots of the buckets that it touches, and no others.  Values are whole numbers (cents, say), so that
sums come out as if they had been computed anew, in any order.

Five tables of one versioned store change in one version, together with the number of the batch: ``facts``, ``dims``,
``held`` (dim, value, n: facts by dimension row), ``counts`` (group, slot, value, n) and ``slots`` (group, slot, n, total,
least, greatest).  A batch that is run again changes nothing.  Look-ups are by bucket: what is read depends on the buckets
that the batch touches, not on the tables.

A null dim joins nothing; a null group is a group; a null value is counted and has a slot of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources.versions import BUCKET, Rewritten, Store

SLOT = 4096
ROWS = 200_000  # facts in a bucket
LEAST = 16  # buckets
TABLES = ("facts", "dims", "held", "counts", "slots")


def begin(store: Store, groups: dict[str, str], buckets: int = LEAST) -> None:
    """Empty tables of a summary by columns ``groups`` (name: type); nothing where there are some.  A bucket is written by
    one task, so their number should grow with the facts (``buckets_for``)."""
    if "slots" in store.tables()["tables"]:
        return
    g, names = ", ".join(f"{n} {t}" for n, t in groups.items()), list(groups)
    empty = lambda schema: store.empty(StructType.fromDDL(schema))
    store.replace(
        {
            "facts": (empty("id long, dim long, value long"), ["id"]),
            "dims": (empty(f"dim long, {g}"), ["dim"]),
            "held": (empty("dim long, value long, n long"), ["dim", "value"]),
            "counts": (empty(f"{g}, slot long, value long, n long"), [*names, "slot", "value"]),
            "slots": (empty(f"{g}, slot long, n long, total long, least long, greatest long"), [*names, "slot"]),
        },
        buckets,
        by={"held": ["dim"], "counts": [*names, "slot"]},
    )


def buckets_for(facts: int) -> int:
    """Buckets for a number of facts: so many that a bucket has at most some ``ROWS`` of them."""
    return max(LEAST, -(-facts // ROWS))


def _summed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


def _signed(moved: DataFrame, *columns: str) -> DataFrame:
    """Rows as they were, with n = -1, and as they are now, with n = 1; ``columns`` stand beside them."""
    sides = (moved.where(F.col(side).isNotNull()).select(*columns, f"{side}.*", F.lit(n).cast("long").alias("n")) for side, n in (("was", -1), ("now", 1)))
    return reduce(DataFrame.unionByName, sides).drop("gone")


def slot(value: Column) -> Column:
    return F.floor(value / SLOT).cast("long")


def absorb(store: Store, number: int, facts: DataFrame, dims: DataFrame) -> None:
    """A batch: facts (id, dim, value, gone) and dims (dim, groups, gone), with rows as they are now; ``gone`` rows are
    deleted.  Of several rows of a key the greatest counts, in the order of its columns.  Batches are numbered upwards.

    A table's rows and its changes go by bucket through one shuffle, where they are put together and from where they are
    written; no row of an old version is looked up by a join."""
    if store.note("slots").get("batch", -1) >= number:
        return
    tables = store.tables()["tables"]
    if tables["slots"].get("by") != tables["counts"]["by"]:
        raise ValueError(f"{store.folder}: its slots lie in other buckets than its counts, as an earlier version made them; begin a new one")
    groups = [f["name"] for f in tables["dims"]["schema"]["fields"]][1:]
    kept: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return df

    def make(version: int) -> dict:
        def by_bucket(table: str, rows: DataFrame) -> DataFrame:
            return rows.withColumn(BUCKET, store.bucket(table, version)).repartition(BUCKET)

        def of(table: str, keys: DataFrame) -> tuple[set[str], DataFrame]:
            touched = store.touched(table, keys, version)
            return touched, store.of_buckets(table, touched, version)

        def compared(table: str, key: str, columns: list[str], changes: DataFrame) -> tuple[DataFrame, Rewritten]:
            """The rows that changes make other (key, was, now), and the buckets with all their rows."""
            touched, old = of(table, changes)
            given = changes.select(key, *columns, F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(True).alias("__new"))
            both = old.select("*", F.lit(False).alias("gone"), F.lit(False).alias("__new")).unionByName(given)
            row, new, now = F.struct(*columns, "gone"), F.col("__new"), F.col("now")
            pairs = by_bucket(table, both).groupBy(BUCKET, key).agg(F.max(F.when(~new, row)).alias("was"), F.max(F.when(new, row)).alias("now"))
            pairs = hold(pairs.withColumn("now", F.when(now.isNull(), F.col("was")).when(~now["gone"], now)))
            rows = pairs.where(now.isNotNull()).select(BUCKET, key, *(now[c].alias(c) for c in columns))
            return pairs.where(~F.col("was").eqNullSafe(now)).select(key, "was", "now"), Rewritten(rows, touched)

        other_facts, facts_now = compared("facts", "id", ["dim", "value"], facts)
        other_dims, dims_now = compared("dims", "dim", groups, dims)
        moved_facts, moved_dims = _signed(other_facts), _signed(other_dims.where(F.col("dim").isNotNull()), "dim").withColumnRenamed("n", "sign")
        touched, old = of("held", moved_facts)
        held = hold(_summed(by_bucket("held", old.unionByName(moved_facts)), [BUCKET, "dim", "value"]))
        others = store.of_buckets("held", store.touched("held", moved_dims, version) - touched, version)
        as_they_are = held.select(others.columns).unionByName(others)
        of_facts = moved_facts.join(of("dims", moved_facts)[1], "dim").select(*groups, "value", "n")
        of_dims = as_they_are.join(moved_dims, "dim").select(*groups, "value", (F.col("n") * F.col("sign")).alias("n"))
        change = hold(_summed(of_facts.unionByName(of_dims), [*groups, "value"]).withColumn("slot", slot(F.col("value"))))
        spots, old = of("counts", change)
        counts = hold(_summed(by_bucket("counts", old.unionByName(change)), [BUCKET, *groups, "slot", "value"]))
        slots = counts.groupBy(BUCKET, *groups, "slot").agg(
            F.sum(F.col("n") * F.col("value")).alias("total"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum("n").alias("n")
        )
        return {
            "facts": facts_now,
            "dims": dims_now,
            "held": Rewritten(held, touched),
            "counts": Rewritten(counts, spots),
            "slots": Rewritten(slots, spots),  # its buckets are those of counts
        }

    try:
        store.amend(make, {"slots": lambda note: note | {"batch": number}})
    finally:
        for df in kept:
            df.unpersist()


def summary(store: Store, version: int | None = None) -> DataFrame:
    """The groups that have facts: n, total, least, greatest."""
    slots = store.read("slots", version)
    groups = slots.columns[: slots.columns.index("slot")]
    return slots.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
