"""Queries on the change log that the events table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import hlc
from sparkloom.operators import clocks, eventlog, ordering
from sparkloom.plans.registry import query
from sparkloom.tables import Tables, spread

#: The log in the checking engine's SQL; its millisecond comes from the microsecond, as epoch_ms rounds otherwise.
LOG = """clocks AS (SELECT *, printf('%012x-%04x-d%d', epoch_us(ts) // 1000, event_id % 65536, event_id % 2) AS hlc FROM events),
log AS (SELECT hlc || ':' || user_id AS id, hlc, 'd' || (event_id % 2) AS device, 'user' AS entity, user_id::VARCHAR AS entity_id, event_id,
CASE event_type WHEN 'signup' THEN 'crea' WHEN 'error' THEN 'elimina' ELSE 'aggiorna' END AS kind, json_extract_string(props, '$.k') AS k, event_type AS type FROM clocks)"""
FIELDS = """writes AS (SELECT *, 'k' AS field, k AS value FROM log WHERE kind <> 'elimina' UNION ALL SELECT *, 'type', type FROM log WHERE kind <> 'elimina')"""
STATE = f"""{LOG}, {FIELDS}, gone AS (SELECT entity_id, max((hlc, id)) AS at FROM log WHERE kind = 'elimina' GROUP BY 1),
alive AS (SELECT w.* FROM writes w LEFT JOIN gone g USING (entity_id) WHERE g.at IS NULL OR (w.hlc, w.id) > g.at),
state AS (SELECT entity_id, field, arg_max(value, (hlc, id)) AS value, max(hlc) AS hlc FROM alive GROUP BY 1, 2)"""


def log(t: Tables) -> DataFrame:
    return eventlog.log_of_events(spread(t.events))


@query(f"WITH {LOG} SELECT event_id, hlc, id FROM log")
def hlc_build(t: Tables) -> DataFrame:
    return _with_event(t)


def _with_event(t: Tables) -> DataFrame:
    e = t.events
    clock = hlc.written(F.unix_millis(F.col("ts").cast("timestamp")), F.pmod("event_id", F.lit(65536)), F.concat(F.lit("d"), F.pmod("event_id", F.lit(2)).cast("string")))
    return e.select("event_id", clock.alias("hlc"), F.concat_ws(":", clock, F.col("user_id").cast("string")).alias("id"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, (event_id % 65536)::INT AS counter, 'd' || (event_id % 2) AS device FROM events")
def hlc_parse(t: Tables) -> DataFrame:
    p = hlc.parsed(F.col("hlc"))
    return _with_event(t).select("event_id", p["ms"].alias("ms"), p["counter"].alias("counter"), p["device"].alias("device"))


@query(f"WITH {LOG} SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY hlc, id) AS nth FROM log")
def log_order(t: Tables) -> DataFrame:
    """The log's order, entity by entity: a global order needs no global sort to be used."""
    rows = log(t).select("entity_id", "hlc", "id")
    return ordering.numbered(rows, ["entity_id"], ["hlc", "id"], hlc.stretch(F.col("hlc")), "k").select("id", (F.col("k") + 1).alias("nth"))


def _two_logs(t: Tables) -> tuple[DataFrame, DataFrame]:
    def part(condition: str) -> DataFrame:
        return eventlog.log_of_events(t.events.where(condition))

    return part("event_id % 3 <> 0"), part("event_id % 2 = 0")


@query(f"WITH {LOG} SELECT id, kind FROM log WHERE event_id % 2 = 0 AND id NOT IN (SELECT id FROM log WHERE event_id % 3 <> 0)")
def merge_new_events(t: Tables) -> DataFrame:
    return eventlog.merge_new(*_two_logs(t)).select("id", "kind")


@query(f"WITH {LOG} SELECT count(*) AS n_received, count(*) FILTER (WHERE event_id % 3 = 0) AS n_new, count(*) FILTER (WHERE event_id % 3 <> 0) AS n_duplicate FROM log WHERE event_id % 2 = 0")
def merge_counts(t: Tables) -> DataFrame:
    return eventlog.merge_counts(*_two_logs(t))


@query(f"""WITH {LOG}, {FIELDS}, every AS (SELECT entity_id, field, hlc, id, device FROM writes UNION ALL SELECT entity_id, '__eliminato', hlc, id, device FROM log WHERE kind = 'elimina'),
l AS (SELECT *, lag(device) OVER (PARTITION BY entity_id, field ORDER BY hlc, id) AS loser FROM every) SELECT entity_id, field, count(*) AS n FROM l WHERE loser <> device GROUP BY 1, 2""")
def merge_conflicts(t: Tables) -> DataFrame:
    return eventlog.conflicts(log(t)).groupBy("entity_id", "field").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT DISTINCT entity, entity_id FROM log WHERE event_id % 2 = 0 AND event_id % 3 = 0")
def touched_entities(t: Tables) -> DataFrame:
    return eventlog.touched(eventlog.merge_new(*_two_logs(t)))


@query(f"WITH {STATE} SELECT entity_id, field, value FROM state")
def project_latest(t: Tables) -> DataFrame:
    return eventlog.projected(log(t)).select("entity_id", F.explode("fields").alias("field", "value"))


@query(f"WITH {STATE} SELECT entity_id, max(CASE field WHEN 'k' THEN value END) AS k, max(CASE field WHEN 'type' THEN value END) AS type, max(hlc) AS hlc FROM state GROUP BY 1")
def log_projection(t: Tables) -> DataFrame:
    """The flagship: the log folded into a row per living entity."""
    return eventlog.projected(log(t)).select("entity_id", F.element_at("fields", "k").alias("k"), F.element_at("fields", "type").alias("type"), "hlc")


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("type", T.StringType())])


@query(f"WITH {STATE} SELECT entity_id, max(CASE field WHEN 'k' THEN value END)::BIGINT AS k, max(CASE field WHEN 'type' THEN value END) AS type FROM state GROUP BY 1 HAVING k IS NOT NULL AND max(CASE field WHEN 'type' THEN value END) IS NOT NULL")
def materialise(t: Tables) -> DataFrame:
    return eventlog.materialised(eventlog.projected(log(t)), SCHEMA, ["k", "type"])[0].select("entity_id", "k", "type")


@query(f"""WITH {LOG}, late AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN NULL ELSE k END AS kk FROM log), gone AS (SELECT entity_id, max((hlc, id)) AS at FROM late WHERE kind = 'elimina' GROUP BY 1),
alive AS (SELECT l.* FROM late l LEFT JOIN gone g USING (entity_id) WHERE kind <> 'elimina' AND (g.at IS NULL OR (l.hlc, l.id) > g.at)),
s AS (SELECT entity_id, arg_max(kk, (hlc, id)) FILTER (WHERE kk IS NOT NULL) AS k FROM alive GROUP BY 1) SELECT entity_id FROM s WHERE k IS NULL""")
def incomplete_rows(t: Tables) -> DataFrame:
    """Entities that lack a mandatory column: here only every fifth event carries k."""
    bare = F.when(F.pmod("event_id", F.lit(5)) != 0, "{}").otherwise(F.col("props"))
    events = t.events.withColumn("props", bare)
    # '{}' plus a field: the stray comma of an empty object goes.
    rows = eventlog.log_of_events(events).withColumn("payload", F.regexp_replace("payload", r"^\{, ", "{"))
    return eventlog.materialised(eventlog.projected(rows), SCHEMA, ["k"])[1].select("entity_id")


@query("SELECT 'd' || (event_id % 2) AS device, max(abs((event_id * 37) % 90000)) AS worst_ms, max(abs((event_id * 37) % 90000)) > 60000 AS alarm FROM events GROUP BY 1")
def drift_check(t: Tables) -> DataFrame:
    """How far each device's clock is from the time its events were seen."""
    seen = _with_event(t).select(hlc.parsed(F.col("hlc")).alias("p"), "event_id").select("p.*", (F.col("p.ms") + F.pmod(F.col("event_id") * 37, F.lit(90000))).alias("seen_ms"))
    return seen.groupBy("device").agg(F.max(F.abs(F.col("ms") - F.col("seen_ms"))).alias("worst_ms"), F.max(hlc.drifts(F.col("ms"), F.col("seen_ms"))).alias("alarm"))


@query(f"WITH {LOG} SELECT id FROM log WHERE event_id % 3 = 0 ORDER BY hlc, id LIMIT 500")
def unsent_page(t: Tables) -> DataFrame:
    sent = eventlog.log_of_events(t.events.where("event_id % 3 <> 0"))
    return eventlog.unsent(log(t), sent).select("id")


@query(f"WITH {LOG} SELECT count(*) AS n, coalesce(sum(('0x' || substr(md5(id), 1, 8))::BIGINT), 0)::BIGINT AS digest, TRUE AS same FROM (SELECT DISTINCT id FROM log)")
def log_fingerprint(t: Tables) -> DataFrame:
    """Merging in either order gives the same log."""
    a, b = _two_logs(t)
    one = eventlog.fingerprint(a.unionByName(eventlog.merge_new(a, b)).unionByName(eventlog.log_of_events(t.events.where("event_id % 6 = 3"))))
    two = eventlog.fingerprint(b.unionByName(eventlog.merge_new(b, a)).unionByName(eventlog.log_of_events(t.events.where("event_id % 6 = 3"))))
    return one.crossJoin(two.select(F.col("n").alias("m"), F.col("digest").alias("other"))).select("n", "digest", ((F.col("n") == F.col("m")) & (F.col("digest") == F.col("other"))).alias("same"))  # one row each


@query("""WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'd0' ELSE 'd' || (1 + event_id % 5) END AS device, epoch_us(ts) // 1000 - (event_id * 7919) % 90000 AS now,
CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 + (event_id % 11) * 1000 END AS m, event_id % 65536 AS c, event_id % 33 = 0 AS bad FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY event_id) AS k FROM e),
f AS (SELECT DISTINCT device, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::BIGINT AS ms, 0::BIGINT AS counter FROM e
UNION ALL SELECT device, k, event_id, CASE WHEN n > 65535 THEN top + 1 ELSE top END, CASE WHEN n > 65535 THEN 0 ELSE n END FROM (
SELECT r.device, r.k, r.event_id, CASE WHEN bad THEN f.ms ELSE greatest(f.ms, r.now, coalesce(r.m, 0)) END AS top,
CASE WHEN bad THEN f.counter WHEN r.now > f.ms AND r.now > coalesce(r.m, 0) THEN 0 WHEN f.ms > coalesce(r.m, 0) THEN f.counter + 1 WHEN r.m > f.ms THEN (CASE WHEN r.m >= r.now THEN r.c + 1 ELSE 0 END) ELSE greatest(f.counter, r.c) + 1 END AS n
FROM f JOIN r ON r.device = f.device AND r.k = f.k + 1))
SELECT event_id, printf('%012x-%04x-%s', ms, counter, device) AS hlc FROM f WHERE k > 0""")
def clock_fold(t: Tables) -> DataFrame:
    """Each device's clock after each of its events, own ones and those of others; d0 has half of all events."""
    k, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    other = F.when(k % 33 == 0, F.lit("not a clock")).when(k % 3 == 0, hlc.written(ms + (k % 11) * 1000, k % 65536, F.lit("x")))
    e = t.events.select(k.alias("nth"), F.when(k % 2 == 0, F.lit("d0")).otherwise(F.concat(F.lit("d"), (1 + k % 5).cast("string"))).alias("device"), (ms - (k * 7919) % 90000).alias("now"), other.alias("other"))
    return clocks.restamped(spread(e), F.floor(F.col("nth") / 4096)).select(F.col("nth").alias("event_id"), "hlc")


@query("SELECT device, count(*) AS n, ceil(count(*) / 500.0)::BIGINT AS packets FROM (SELECT CASE WHEN event_id % 65536 % 3 <> 0 THEN 'd' || (event_id % 2) END AS device FROM events) GROUP BY 1")
def sealed_nameless(t: Tables) -> DataFrame:
    """Packets of a log in which a third of the events name no device: they are sealed as well."""
    from sparkloom.sources import sinks

    key = sinks.derived_key("a passphrase that both devices know", b"0123456789abcdef")
    device = F.when(hlc.parsed(F.col("hlc"))["counter"] % 3 != 0, F.col("device"))
    packets = sinks.packets(log(t).withColumn("device", device), key)
    opened = packets.select("device", F.size(F.from_json(sinks.opened(F.col("body"), key), "array<struct<id:string>>")).alias("n"))
    return opened.groupBy("device").agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("packets"))
