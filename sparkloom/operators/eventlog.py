"""The append-only change log: order, merge, conflicts, projection.

A log row is (id, hlc, device, entity, entity_id, kind, payload): kind is crea, aggiorna or
elimina, payload is a JSON object as text.  The order is (hlc, id); folds are ``max_by`` over
it, which combine before the shuffle, never a sort of collected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions import hlc
from sparkloom.operators import ordering

CREATE, UPDATE, DELETE = "crea", "aggiorna", "elimina"
DELETED = "__eliminato"
KEY = ["entity", "entity_id"]


def log_of_events(events: DataFrame) -> DataFrame:
    """The change log that the events table stands for: users, written by two devices."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    clock = hlc.written(ms, F.pmod("event_id", F.lit(65536)), F.concat(F.lit("d"), F.pmod("event_id", F.lit(2)).cast("string")))
    kind = F.when(F.col("event_type") == "signup", CREATE).when(F.col("event_type") == "error", DELETE).otherwise(UPDATE)
    payload = F.when(kind != DELETE, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "type": "'), F.col("event_type"), F.lit('"}'))).otherwise("{}")
    return events.select(
        F.concat_ws(":", clock, F.col("user_id").cast("string")).alias("id"),
        clock.alias("hlc"),
        F.concat(F.lit("d"), F.pmod("event_id", F.lit(2)).cast("string")).alias("device"),
        F.lit("user").alias("entity"),
        F.col("user_id").cast("string").alias("entity_id"),
        kind.alias("kind"),
        payload.alias("payload"),
    )


def position() -> Column:
    return F.struct("hlc", "id")


def fields(payload: Column) -> Column:
    """Field -> value as text; nested values stay JSON; anything but an object has no fields."""
    return F.when(F.ltrim(payload).startswith("{"), F.from_json(payload, "map<string,string>"))


def merge_new(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows that the local log has not; of repeated ids the first in order."""
    first = remote.groupBy("id").agg(F.min_by(F.struct(*[F.col(c) for c in remote.columns]), position()).alias("row")).select("row.*")
    return first.join(local.select("id"), "id", "left_anti")


def merge_counts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: rows received, new, duplicate."""
    fresh = merge_new(local, remote).agg(F.count("*").alias("n_new"))
    return remote.agg(F.count("*").alias("n_received")).crossJoin(fresh).withColumn("n_duplicate", F.col("n_received") - F.col("n_new"))  # one row each


def field_writes(log: DataFrame) -> DataFrame:
    """A row per field that an event writes; a deletion writes one field of its own."""
    names = F.when(F.col("kind") == DELETE, F.array(F.lit(DELETED))).otherwise(F.map_keys(fields(F.col("payload"))))
    return log.select(*KEY, "id", "hlc", "device", F.explode(names).alias("field"))


def conflicts(log: DataFrame) -> DataFrame:
    """Writes of a field whose previous writer was another device; the later write wins."""
    before = ordering.with_previous(field_writes(log), [*KEY, "field"], ["hlc", "id"], hlc.stretch(F.col("hlc")), ["device", "id"], "lost")
    return before.where("lost.device <> device").select(*KEY, "field", F.col("id").alias("won_id"), F.col("lost.id").alias("lost_id"), F.col("device").alias("winner"), F.col("lost.device").alias("loser"))


def touched(fresh: DataFrame) -> DataFrame:
    return fresh.select(*KEY).distinct()


def projected(log: DataFrame) -> DataFrame:
    """Per living entity: fields (a map; explicit nulls stay), hlc of its last event.

    A deletion forgets all that came before; a later write brings the entity back with only what
    was written since.  Unreadable payloads are skipped.

    A field's latest write settles it: if even that is not later than the entity's last deletion,
    no other is.  So every task reduces its events to one row per entity and field before
    anything is shuffled, and an entity with very many events is no task's burden.
    """
    return living(latest_writes(log))


LATEST = "entity string, entity_id string, gone boolean, field string, value string, at struct<hlc: string, id: string>"


def latest_writes(log: DataFrame) -> DataFrame:
    """LATEST: the last write of each field, and the last deletion, of each entity."""
    gone = F.col("kind") == DELETE
    rows = log.select(*KEY, position().alias("at"), gone.alias("gone"), F.map_entries(fields(F.col("payload"))).alias("entries"))
    rows = rows.where("gone OR entries IS NOT NULL")
    pairs = rows.select(*KEY, "at", "gone", F.explode_outer(F.when(~F.col("gone"), F.col("entries"))).alias("e"))
    return settled(pairs.select(*KEY, "gone", F.col("e.key").alias("field"), F.col("e.value").alias("value"), "at"))


def settled(writes: DataFrame) -> DataFrame:
    """Of writes the latest ones: folding a part of them first, or one twice, makes no difference."""
    return writes.groupBy(*KEY, "gone", "field").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def living(latest: DataFrame) -> DataFrame:
    """Per living entity: fields, hlc; see ``projected``."""
    entity = latest.groupBy(*KEY).agg(F.max(F.when(F.col("gone"), F.col("at"))).alias("last"), F.collect_list(F.when(~F.col("gone"), F.struct("field", "value", "at"))).alias("writes"))
    live = entity.withColumn("live", F.filter("writes", lambda w: F.col("last").isNull() | (w["at"] > F.col("last")))).where(F.size("live") > 0)
    named = F.transform(F.filter("live", lambda w: w["field"].isNotNull()), lambda w: F.struct(w["field"].alias("field"), w["value"].alias("value")))
    return live.select(*KEY, F.map_from_entries(F.sort_array(named)).alias("fields"), F.array_max(F.transform("live", lambda w: w["at"]["hlc"])).alias("hlc"))


def materialised(states: DataFrame, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """States as typed rows of the entity's schema, and those that lack a required column.

    Fields the schema does not have are dropped; true and false become 1 and 0 in numbers.
    """

    def typed(name: str, kind: str) -> Column:
        value = F.element_at("fields", name)
        if kind in ("bigint", "int", "double"):
            value = F.when(value == "true", "1").when(value == "false", "0").otherwise(value)
        return F.expr(f"try_cast(__v_{name} AS {kind})").alias(name) if kind != "string" else value.alias(name)

    names = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    raw = states.withColumns({f"__v_{n}": F.when(F.element_at("fields", n) == "true", "1").when(F.element_at("fields", n) == "false", "0").otherwise(F.element_at("fields", n)) for n, k in names if k != "string"})
    rows = raw.select("entity", "entity_id", "hlc", *(typed(n, k) for n, k in names))
    whole = F.lit(True)
    for name in required:
        whole &= F.col(name).isNotNull()
    return rows.where(whole), rows.where(~whole)


def fingerprint(log: DataFrame) -> DataFrame:
    """One row: the number of distinct ids and an order-free digest of them, for two logs to compare."""
    return log.select("id").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(digest(F.col("id"))), F.lit(0)).alias("digest"))


def digest(text: Column) -> Column:
    """32 bits of a text's MD5: sums of it do not depend on order, and any engine can compute them."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unsent(log: DataFrame, sent: DataFrame, most: int = 500) -> DataFrame:
    """The first rows, in order, that are not yet sent: one page of a limited exchange."""
    return log.join(sent.select("id"), "id", "left_anti").orderBy("hlc", "id").limit(most)
