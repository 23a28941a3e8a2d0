"""Streaming queries over the events table as a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import eventlog, summaries
from sparkloom.plans.changelog import STATE
from sparkloom.plans.registry import query
from sparkloom.sources import ingest, versions
from sparkloom.sources.scratch import scratch
from sparkloom.streaming import health, projection, sessions
from sparkloom.tables import Tables


def _stream(t: Tables) -> DataFrame:
    """The events table as a stream, whether it is one file or a folder of files."""
    path = f"{t.folder}/events.parquet"
    where = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1)
    if where.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query(f"WITH {STATE} SELECT entity_id, field, value FROM state")
def stream_projection(t: Tables) -> DataFrame:
    """The projection kept by a stream, batch by batch; equal to the batch projection."""
    folder = scratch(t.spark, "stream")
    follow = projection.follow(_stream(t), folder, f"{folder}/checkpoint")
    follow.awaitTermination()
    done = [p["batchId"] for p in follow.recentProgress if p["numInputRows"]]
    if not done:  # an empty table
        return eventlog.projected(eventlog.log_of_events(t.events)).select("entity_id", F.explode("fields").alias("field", "value"))
    version = max(done)
    return projection.state(t.spark, folder, version).select("entity_id", F.explode("fields").alias("field", "value"))


@query(f"""WITH {STATE}, s AS (SELECT entity_id, max(CASE field WHEN 'k' THEN value END) AS k, max(CASE field WHEN 'type' THEN value END) AS type, max(hlc) AS hlc FROM state GROUP BY 1)
SELECT (SELECT count(DISTINCT id) FROM log) AS n_log, count(*) AS n_state, coalesce(sum(('0x' || substr(md5(concat_ws('|', entity_id, k, type, hlc)), 1, 8))::BIGINT), 0)::BIGINT AS digest FROM s""")
def stream_replay(t: Tables) -> DataFrame:
    """Three uneven batches with overlaps, the oldest last: the log and a digest of the state, as after one batch."""
    folder = scratch(t.spark, "replay")
    parts = ["event_id % 3 = 0", "event_id % 2 = 0", "true"]
    for n, part in enumerate(parts):
        projection.absorb(eventlog.log_of_events(t.events.where(part)), n, folder)
    kept = projection.state(t.spark, folder, len(parts) - 1)
    row = F.concat_ws("|", "entity_id", F.try_element_at("fields", F.lit("k")), F.try_element_at("fields", F.lit("type")), "hlc")
    digest = kept.agg(F.count("*").alias("n_state"), F.coalesce(F.sum(eventlog.digest(row)), F.lit(0)).alias("digest"))
    return t.spark.read.parquet(f"{folder}/log").agg(F.count("*").alias("n_log")).crossJoin(digest)  # one row each


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly(t: Tables) -> DataFrame:
    """A windowed count by Monday week, complete mode: each batch replaces the table in the shared folder."""
    folder, weeks = scratch(t.spark, "weekly"), projection.weekly_windows(_stream(t))
    weeks.sparkSession.createDataFrame([], weeks.schema).write.parquet(f"{folder}/weeks")  # what a table without events gives

    def replace(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/weeks")

    weeks.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(weeks.schema).parquet(f"{folder}/weeks").select(F.col("window.start").cast("date").alias("week"), "event_type", "n")


_RUNS_SQL = """e AS (SELECT user_id AS source, date_diff('day', DATE '2020-01-01', ts::DATE) AS run, event_type || event_id % 5 AS item, event_type = 'error' AS bad FROM events),
r AS (SELECT source, run, bool_or(bad) AS transient FROM e GROUP BY 1, 2),
i AS (SELECT source, item, run, min(run) OVER (PARTITION BY source, item) AS first FROM (SELECT DISTINCT source, item, run FROM e JOIN r USING (source, run) WHERE NOT transient)),
n AS (SELECT source, run, count(*) AS n_items, count(*) FILTER (WHERE first = run) AS n_new FROM i GROUP BY 1, 2),
g AS (SELECT *, sum((NOT transient)::INT) OVER (PARTITION BY source ORDER BY run) AS island FROM r),
f AS (SELECT source, run, (sum(transient::INT) OVER (PARTITION BY source, island ORDER BY run))::BIGINT AS failures FROM g)"""


@query(f"""WITH {_RUNS_SQL} SELECT source, run, failures, failures >= 3 AS down, coalesce(n_items, 0) AS n_items, coalesce(n_new, 0) AS n_new FROM f LEFT JOIN n USING (source, run)""")
def source_runs(t: Tables) -> DataFrame:
    """Failures in a row and new items of each source after each run, kept by a stream that is stopped and started
    twice; each start reads a third of the days and the days before it once more."""
    folder, day = scratch(t.spark, "runs"), F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint")
    e = t.events.select(F.col("user_id").cast("bigint").alias("source"), day.alias("run"), F.concat("event_type", F.pmod("event_id", F.lit(5)).cast("string")).alias("item"), (F.col("event_type") == "error").alias("bad"))
    runs = e.groupBy("source", "run").agg(F.bool_or("bad").alias("transient"), F.collect_set("item").alias("items"))
    first, last = runs.agg(F.min("run"), F.max("run")).first()
    t.spark.createDataFrame([], health.RUNS).write.parquet(f"{folder}/in/0")
    t.spark.createDataFrame([], health.STATES).write.parquet(f"{folder}/out")  # what a table without events gives
    for k in range(3 if first is not None else 0):
        upto = first + (last - first) * (k + 1) // 3
        runs.where(F.col("run").between(upto - (last - first) // 2, upto)).write.parquet(f"{folder}/in/{k + 1}")
        stream = t.spark.readStream.schema(health.RUNS).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        health.follow(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(health.STATES).parquet(f"{folder}/out")


@query(f"""WITH {_RUNS_SQL}, s AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE transient) AS network, count(*) FILTER (WHERE NOT transient) AS accepted FROM r GROUP BY 1)
SELECT *, lag(accepted) OVER (ORDER BY run) AS previous, network >= 0.4 * n OR coalesce(lag(accepted) OVER (ORDER BY run) >= 5 AND accepted < 0.5 * lag(accepted) OVER (ORDER BY run), FALSE) AS open FROM s""")
def breaker_runs(t: Tables) -> DataFrame:
    """The circuit breaker of each run, against the run before it."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    per = t.events.groupBy("user_id", day.alias("run")).agg(F.bool_or(F.col("event_type") == "error").alias("transient"))
    s = per.groupBy("run").agg(F.count("*").alias("n"), F.count_if("transient").alias("network"), F.count_if(~F.col("transient")).alias("accepted"))
    s = s.withColumn("run", F.col("run").cast("bigint")).withColumn("previous", F.lag("accepted").over(Window.orderBy("run")))  # a row per run
    fell = (F.col("previous") >= 5) & (F.col("accepted") < 0.5 * F.col("previous"))
    return s.withColumn("open", (F.col("network") >= 0.4 * F.col("n")) | F.coalesce(fell, F.lit(False)))


@query("""WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms FROM events), m AS (SELECT *, ms - lag(ms) OVER (PARTITION BY key ORDER BY ms) > 21600000 AS far FROM e),
s AS (SELECT *, sum(coalesce(far, TRUE)::INT) OVER (PARTITION BY key ORDER BY ms) AS k FROM m) SELECT key, min(ms) AS start, max(ms) AS "end" FROM s GROUP BY key, k""")
def late_sessions(t: Tables) -> DataFrame:
    """Sessions with gaps of at most six hours, from batches that come in no order and overlap."""
    store = versions.Store(t.spark, scratch(t.spark, "sessions"))
    e = t.events.select("event_id", F.col("user_id").cast("bigint").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    sessions.begin(store)
    for part in ("event_id % 3 = 2", "event_id % 2 = 0", "event_id % 3 <> 2"):
        sessions.absorb(store, e.where(part).select("key", "at"), 6 * 3_600_000)
    return store.read(sessions.NAME)


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total, min(round(o_totalprice * 100)::BIGINT) AS least, max(round(o_totalprice * 100)::BIGINT) AS greatest
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def summary_by_differences(t: Tables) -> DataFrame:
    """Orders by nation and segment in cents, kept by differences: half of the orders come wrong (other prices, other
    customers, orders that are taken back), a sixth of the customers in another segment; two batches put them right."""
    store, key = versions.Store(t.spark, scratch(t.spark, "summary")), F.col("id")
    kinds = {f.name: f.dataType.simpleString() for f in t.customer.schema}
    summaries.begin(store, {c: kinds[c] for c in ("c_nationkey", "c_mktsegment")}, summaries.buckets_for(t.orders.count()))
    stay = F.lit(False).alias("gone")
    right = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dim"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"), stay)
    changed = F.pmod(key, F.lit(4)) == 0
    wrong = right.withColumn("dim", F.when(F.pmod(key, F.lit(8)) == 0, F.col("dim") + 1).otherwise(F.col("dim"))).withColumn("value", F.when(changed, F.col("value") * F.pmod(key, F.lit(3))).otherwise(F.col("value")))
    extra = right.where(F.pmod(key, F.lit(5)) == 0).select((-key - 1).alias("id"), "dim", (F.col("value") + 50_000_000).alias("value"), "gone")
    dims = t.customer.select(F.col("c_custkey").alias("dim"), "c_nationkey", "c_mktsegment", stay)
    moved = F.pmod("dim", F.lit(6)) == 0
    none = lambda df: df.where("false")
    summaries.absorb(store, 0, wrong.unionByName(extra), dims.withColumn("c_mktsegment", F.when(moved, "OTHER").otherwise(F.col("c_mktsegment"))))
    summaries.absorb(store, 1, right.where(changed).unionByName(extra.withColumn("gone", F.lit(True))), none(dims))
    summaries.absorb(store, 2, none(right), dims.where(moved))
    return summaries.summary(store)


@query("SELECT event_id, user_id, event_type FROM events")
def ingested_once(t: Tables) -> DataFrame:
    """Events from four batches that overlap, the last one all of them, each taken once by an index of known ids; files
    are put together and the filter, which starts too small, is made larger in between."""
    store, rows = versions.Store(t.spark, scratch(t.spark, "ingest")), t.events.select(F.col("event_id").cast("string").alias("id"), "event_id", "user_id", "event_type")
    ingest.begin(store, rows.schema, blocks=16, buckets=16)
    for n, part in enumerate(("event_id % 3 = 0", "event_id % 2 = 0", "event_id % 4 <> 1", "true")):
        ingest.absorb(store, n, rows.where(part))
        if n == 1:
            ingest.compact(store, 1)
    return store.read("known").select("event_id", "user_id", "event_type")
