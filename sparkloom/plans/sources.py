"""Source and sink queries: upserts, paging, adapters, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import eventlog
from sparkloom.plans.registry import query
from sparkloom.sources import arrivals, readers, sinks, versions
from sparkloom.sources.scratch import scratch
from sparkloom.tables import Tables


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_merge(t: Tables) -> DataFrame:
    existing = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal")
    changes = t.customer.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    again = changes.withColumn("c_acctbal", F.col("c_acctbal") - 5).withColumn("seq", F.lit(1)).unionByName(changes.withColumn("seq", F.lit(2)))
    return readers.upsert(existing, again, ["c_custkey"], "seq")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upsert_ignore(t: Tables) -> DataFrame:
    existing = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal")
    changes = t.customer.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("seq"))
    return readers.upsert(existing, changes, ["c_custkey"], "seq", merge=False)


@query("SELECT event_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-05', 40) ORDER BY ts, event_id LIMIT 100")
def page_by_range(t: Tables) -> DataFrame:
    """A page after a place, by range: the cost does not grow with the pages before it."""
    rows = t.events.select("event_id", "ts")
    return readers.page_after(rows, (F.lit("2024-01-05").cast("timestamp_ntz"), 40), 100, "ts", "event_id").select("event_id")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def inverted_abstract(t: Tables) -> DataFrame:
    """Texts as inverted indexes (word to positions) and back; words are split on white space, which comes back collapsed.
    A text's index is made and read where the text lies: neither texts nor words move."""
    plain = F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0B]+", " "))
    words = t.documents.where("text IS NOT NULL").select("doc_id", F.split(plain, " ").alias("w"))
    placed = words.select("doc_id", F.sort_array(F.transform("w", lambda w, p: F.struct(w.alias("w"), p.alias("p")))).alias("x"))
    word = lambda at: F.get("x", at)["w"]
    firsts = placed.select("doc_id", "x", F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: (i == 0) | (word(i) != word(i - 1))).alias("at"))
    size = lambda i, k: F.coalesce(F.get("at", k + 1), F.size("x")) - i
    entries = F.transform("at", lambda i, k: F.struct(word(i).alias("w"), F.transform(F.slice("x", i + 1, size(i, k)), lambda e: e["p"]).alias("ps")))
    index = firsts.select("doc_id", F.map_from_entries(entries).alias("m"))
    return index.select("doc_id", readers.unfolded_abstract(F.col("m")).alias("text"))


@query("SELECT 'd' || (event_id % 2) AS device, count(*) AS n, ceil(count(*) / 500.0)::BIGINT AS packets FROM events GROUP BY 1")
def sealed_packets(t: Tables) -> DataFrame:
    """The log in encrypted packets, opened again and counted."""
    key = sinks.derived_key("a passphrase that both devices know", b"0123456789abcdef")
    packets = sinks.packets(eventlog.log_of_events(t.events), key)
    opened = packets.select("device", F.size(F.from_json(sinks.opened(F.col("body"), key), "array<struct<id:string>>")).alias("n"))
    return opened.groupBy("device").agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("packets"))


@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1)")
def prepared_query(t: Tables) -> DataFrame:
    """A query after a preparation step, in a session that is thrown away."""
    return readers.prepared(t.spark, [("orders_prep", f"SELECT * FROM parquet.`{t.folder}/orders.parquet` WHERE o_totalprice > 1000")], "SELECT o_orderpriority, count(*) AS n FROM orders_prep GROUP BY o_orderpriority")


#: Which column of which table refers to which table's key.
REFERENCES = [
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
]


@query(" UNION ALL ".join(f"SELECT '{child}' AS child, '{field}' AS field, '{parent}' AS parent, count(*) AS n, count(*) FILTER (WHERE {field} NOT IN (SELECT {key} FROM {parent})) AS orphans FROM {child}" for child, field, parent, key in REFERENCES))
def foreign_keys(t: Tables) -> DataFrame:
    """References between tables, which views do not carry: declared, and held against the rows."""
    checked = []
    for child, field, parent, key in REFERENCES:
        keys = getattr(t, parent).select(F.col(key).alias(field), F.lit(True).alias("there")).distinct()
        counts = getattr(t, child).groupBy(field).agg(F.count("*").alias("k")).join(keys, field, "left")  # a row per value
        checked.append(counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("there").isNull() & F.col(field).isNotNull(), F.col("k"))), F.lit(0)).alias("orphans")).select(F.lit(child).alias("child"), F.lit(field).alias("field"), F.lit(parent).alias("parent"), "n", "orphans"))
    whole = checked[0]
    for one in checked[1:]:
        whole = whole.unionByName(one)
    return whole


@query("SELECT * FROM (VALUES ('function of the column', FALSE, FALSE), ('range predicate', TRUE, FALSE), ('small side', FALSE, TRUE), ('two columns', FALSE, FALSE)) v(case_name, range_pushed, broadcast)")
def plan_shapes(t: Tables) -> DataFrame:
    """What the optimizer makes of typical queries: a range reaches the scan, a function on the column does not,
    a small side is broadcast."""
    date = F.col("o_orderdate")
    cases = {
        "range predicate": t.orders.where((date >= F.lit("1996-01-01").cast("timestamp_ntz")) & (date < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey"),
        "function of the column": t.orders.where(F.year(date) == 1996).select("o_orderkey"),
        "two columns": t.lineitem.select("l_orderkey", "l_quantity"),
        "small side": t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"),  # 25 rows
    }
    rows = []
    for name, df in cases.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0] if "PushedFilters: [" in plan else ""
        rows.append((name, "LessThan(o_orderdate" in pushed, "BroadcastHashJoin" in plan))
    return t.spark.createDataFrame(rows, "case_name string, range_pushed boolean, broadcast boolean")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0 UNION ALL SELECT -1 - o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 5 = 0""")
def versioned_upsert(t: Tables) -> DataFrame:
    """Orders after three versions: written, then changed and deleted, then added to; the buckets touched alone are rewritten."""
    store = versions.Store(t.spark, scratch(t.spark, "store"))
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    store.replace({"orders": (orders, ["o_orderkey"])}, buckets=8)
    k = F.col("o_orderkey")
    changed = orders.where((k % 7 == 0) | (k % 11 == 0)).select(k, F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), (k % 7 != 0).alias("gone"))
    store.upsert("orders", changed, deleted="gone")
    store.upsert("orders", orders.where(k % 5 == 0).select((-1 - k).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice"))
    return store.read("orders")


@query("""SELECT 1::BIGINT AS version, o_orderstatus, count(*) AS n, count(DISTINCT l_orderkey) AS with_lines FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 2
UNION ALL SELECT 2, o_orderstatus, count(*), count(DISTINCT l_orderkey) FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0) ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 2""")
def versioned_tables(t: Tables) -> DataFrame:
    """Two tables that change together, each version read as a whole."""
    store = versions.Store(t.spark, scratch(t.spark, "store"))
    orders, lines = t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.select("l_orderkey").distinct()
    store.replace({"orders": (orders, ["o_orderkey"]), "lines": (lines, ["l_orderkey"])}, buckets=8)
    store.replace({"orders": (orders.where("o_orderkey % 2 = 0"), ["o_orderkey"]), "lines": (lines.where("l_orderkey % 2 = 0"), ["l_orderkey"])}, buckets=8)

    def of(version: int) -> DataFrame:
        both = store.read("orders", version).join(store.read("lines", version), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("l_orderkey").alias("with_lines")).select(F.lit(version).cast("bigint").alias("version"), "*")

    return of(1).unionByName(of(2))


@query("SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END * 600000 + epoch_us(ts) // 1000 AS arrived, event_type FROM events")
def arrival_reader(t: Tables) -> DataFrame:
    """Events as they arrive at a server, read in three visits: a seventh is visible only after rows with stamps up to
    five minutes later, a fiftieth is sent twice, and each visit goes page by page."""
    store = versions.Store(t.spark, scratch(t.spark, "arrivals"))
    k, ms = F.col("event_id").cast("bigint"), F.unix_millis(F.col("ts").cast("timestamp"))
    once = t.events.select(k.alias("id"), (ms + 600_000).alias("arrived"), "event_type")
    twice = once.where("id % 50 = 0").withColumn("arrived", F.col("arrived") + 600_000)
    log = once.unionByName(twice)
    first, last = log.agg(F.min("arrived"), F.max("arrived")).first()
    arrivals.begin(store, log)
    for visit in range(3 if first is not None else 0):
        now = first + (last - first) * (visit + 1) // 3 + (1 if visit == 2 else 0)
        delay = F.when((F.col("id") % 7 == 0) & F.lit(visit < 2), 299_000).otherwise(0)
        arrivals.follow(store, log.where(F.col("arrived") + delay <= now), now, rows=50_000)
    return store.read(arrivals.NAME)
