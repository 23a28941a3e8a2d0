"""Aggregates, windows, set operations and calendars: the rest of the relational workbench."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import dates
from sparkloom.plans.registry import query
from sparkloom.plans.relational import _DAY, day
from sparkloom.tables import Tables

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
RUNNING = (Window.unboundedPreceding, Window.currentRow)


def number(x: float) -> Column:
    """A DOUBLE literal: 100.0 would be a DECIMAL in SQL text."""
    return F.lit(x).cast("double")


# ------------------------------------------------------------------ aggregates


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def count_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def having_min(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_lines, sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) AS big_quantity,
min(CASE WHEN l_discount = 0 THEN l_extendedprice END) AS least_undiscounted FROM lineitem GROUP BY 1""")
def conditional_sums(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0)).alias("big_quantity"),
        F.min(F.when(F.col("l_discount") == 0, F.col("l_extendedprice"))).alias("least_undiscounted"),
    )


@query("""SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1""")
def pivot_type_by_nation(t: Tables) -> DataFrame:
    """Pivot with the values named, so that no extra job looks for them."""
    names = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
    wide = t.customer.groupBy("c_nationkey").pivot("c_mktsegment", names).count()
    return wide.select("c_nationkey", *(F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names))


@query("SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def count_distinct_fact(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year(day()).alias("year")).agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT p_type, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS parts FROM part WHERE p_size = 1 GROUP BY 1 HAVING count(*) > 1")
def listagg_duplicates(t: Tables) -> DataFrame:
    """An aggregated list in a fixed order."""
    g = t.part.where("p_size = 1").groupBy("p_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    return g.where("n > 1").select("p_type", "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("parts"))


@query(f"""WITH f AS (SELECT o_custkey, min({_DAY}) AS first, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(first, '%Y-%m') AS cohort, count(*) AS customers, sum(n)::BIGINT AS orders, max(n) AS most FROM f GROUP BY 1""")
def two_level_cohort(t: Tables) -> DataFrame:
    f = t.orders.groupBy("o_custkey").agg(F.min(day()).alias("first"), F.count("*").alias("n"))
    return f.groupBy(dates.month_label(F.col("first")).alias("cohort")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"), F.max("n").alias("most"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM lineitem GROUP BY 1, 2")
def pct_of_total(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(number(100) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # a few rows by then


@query("""WITH s AS (SELECT l_returnflag AS flag, avg(l_quantity) AS m, sqrt(greatest(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 0)) AS sd FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM lineitem JOIN s ON l_returnflag = flag WHERE abs(l_quantity - m) > 1.7 * sd""")
def outliers_2sigma(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    s = t.lineitem.groupBy("l_returnflag").agg(F.avg(q).alias("m"), F.sqrt(F.greatest(F.avg(q * q) - F.avg(q) * F.avg(q), number(0))).alias("sd"))
    return t.lineitem.join(F.broadcast(s), "l_returnflag").where(F.abs(q - F.col("m")) > 1.7 * F.col("sd")).select("l_orderkey", "l_linenumber")  # a row per flag


@query("""WITH r AS (SELECT c_mktsegment AS seg, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT seg, round(avg(v), 4) AS median FROM r WHERE k IN ((n + 1) // 2, (n + 2) // 2) GROUP BY 1""")
def median_by_rank(t: Tables) -> DataFrame:
    """The exact median; ``percentile`` counts equal values before the shuffle instead of sorting a group in one task."""
    return t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.round(F.percentile("c_acctbal", number(0.5)), 4).alias("median"))


@query("""WITH k AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1)
SELECT p_brand, count(*) AS lines, round(sum(1.0 / k), 6) AS weighted FROM lineitem JOIN k USING (l_orderkey) JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def weighted_bridge(t: Tables) -> DataFrame:
    """Lines share their order's weight of one."""
    li = t.lineitem.select("l_orderkey", "l_partkey")
    k = li.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    per = li.join(k, "l_orderkey").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum(number(1) / F.col("k")).alias("w"))
    return per.join(t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sum("n").alias("lines"), F.round(F.sum("w"), 6).alias("weighted"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, max(ts) AS at FROM events GROUP BY 1")
def latest_outcome_max_by(t: Tables) -> DataFrame:
    """The row of the latest time, with a partial aggregate before the shuffle."""
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def tally(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 6 AND min(o_totalprice) > 1000")
def having_two_keys(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("m")).where("n > 6 AND m > 1000").select("o_orderstatus", "o_custkey", "n")


# ------------------------------------------------------------------ windows


def _monthly(t: Tables) -> DataFrame:
    return t.orders.groupBy(dates.month_label(day()).alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_MONTHLY = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def row_number_topn(t: Tables) -> DataFrame:
    """Top three per customer: Spark cuts each task's groups to three before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("k")).where("k <= 3")


@query(f"SELECT o_custkey, arg_max(o_orderkey, ({_DAY}, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def row_number_latest(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(day(), F.col("o_orderkey"))).alias("o_orderkey"))


@query(f"SELECT o_custkey, o_orderkey, d FROM (SELECT o_custkey, o_orderkey, {_DAY} AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY {_DAY}, o_orderkey) AS k FROM orders) WHERE k = 3")
def nth_row(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", day().alias("d")).withColumn("k", F.row_number().over(w)).where("k = 3").drop("k")


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT *, rank() OVER w AS r, dense_rank() OVER w AS dr FROM n WINDOW w AS (PARTITION BY c_nationkey ORDER BY n DESC)""")
def rank_dense(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("n"))
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumns({"r": F.rank().over(w).cast("bigint"), "dr": F.dense_rank().over(w).cast("bigint")})


@query("SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr FROM supplier")
def percent_rank(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.round(F.percent_rank().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal")), 6).alias("pr"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def ntile4(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("bigint").alias("quartile"))


@query(f"""SELECT o_orderkey, date_diff('day', lag({_DAY}) OVER w, {_DAY})::INT AS since, date_diff('day', {_DAY}, lead({_DAY}) OVER w)::INT AS until
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead_days(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.datediff(day(), F.lag(day()).over(w)).alias("since"), F.datediff(F.lead(day()).over(w), day()).alias("until"))


@query("SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1")
def first_last_full(t: Tables) -> DataFrame:
    """First and last value of the whole frame, one row per customer: no row needs to be sorted for it."""
    at = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", at).alias("first_status"), F.max_by("o_orderstatus", at).alias("last_status"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last_value(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(*ALL)
    return t.orders.select("o_orderkey", F.first_value("o_orderkey").over(w).alias("first"), F.last_value("o_orderkey").over(w).alias("last"))


@query(f"WITH {_MONTHLY} SELECT month, n, (sum(n) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM m")
def running_sum(t: Tables) -> DataFrame:
    """A global running total, over a row per month."""
    return _monthly(t).select("month", "n", F.sum("n").over(Window.orderBy("month").rowsBetween(*RUNNING)).alias("running"))


@query(f"WITH {_MONTHLY} SELECT month, round(avg(n) OVER w, 4) AS mean3, (sum(n) OVER w)::BIGINT AS sum3 FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def moving_avg3(t: Tables) -> DataFrame:
    w = Window.orderBy("month").rowsBetween(-2, 0)
    return _monthly(t).select("month", F.round(F.avg("n").over(w), 4).alias("mean3"), F.sum("n").over(w).alias("sum3"))


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, round(100.0 * n / sum(n) OVER (PARTITION BY c_nationkey), 4) AS share FROM n""")
def share_of_partition(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.select("c_nationkey", "c_mktsegment", F.round(number(100) * F.col("n") / F.sum("n").over(Window.partitionBy("c_nationkey")), 4).alias("share"))


@query("""SELECT s_suppkey, s_nationkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS deviation FROM supplier""")
def partition_deviation(t: Tables) -> DataFrame:
    """Deviation from the partition's mean, the mean from a partial aggregate that is joined back."""
    mean = t.supplier.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"))
    return t.supplier.join(F.broadcast(mean), "s_nationkey").select("s_suppkey", "s_nationkey", F.round(F.col("s_acctbal") - F.col("m"), 4).alias("deviation"))  # a row per nation


@query("""WITH n AS (SELECT p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT p_brand, q, round(100.0 * sum(q) OVER (ORDER BY q DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(q) OVER (), 4) AS cumulative FROM n""")
def pareto(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    n = per.join(t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sum("q").alias("q"))
    run = F.sum("q").over(Window.orderBy(F.desc("q"), "p_brand").rowsBetween(*RUNNING))  # a row per brand by then
    return n.select("p_brand", "q", F.round(number(100) * run / F.sum("q").over(Window.partitionBy()), 4).alias("cumulative"))


@query(f"WITH {_MONTHLY} SELECT month, n - lag(n) OVER w AS delta, round(100.0 * (n - lag(n) OVER w) / lag(n) OVER w, 4) AS pct FROM m WINDOW w AS (ORDER BY month)")
def mom_delta(t: Tables) -> DataFrame:
    m = _monthly(t).withColumn("before", F.lag("n").over(Window.orderBy("month")))
    return m.select("month", (F.col("n") - F.col("before")).alias("delta"), F.round(number(100) * (F.col("n") - F.col("before")) / F.col("before"), 4).alias("pct"))


@query("""WITH m AS (SELECT c_mktsegment AS seg, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER w AS n1, lag(n, 2) OVER w AS n2 FROM m WINDOW w AS (PARTITION BY seg ORDER BY month)) SELECT seg, month, n FROM l WHERE n < n1 AND n1 < n2""")
def two_declines(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), dates.month_label(day()).alias("month")).agg(F.count("*").alias("k"))
    m = per.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg")), "c_custkey").groupBy("seg", "month").agg(F.sum("k").alias("n"))
    w = Window.partitionBy("seg").orderBy("month")
    return m.withColumns({"n1": F.lag("n").over(w), "n2": F.lag("n", 2).over(w)}).where("n < n1 AND n1 < n2").select("seg", "month", "n")


@query(f"""WITH o AS (SELECT o_custkey, {_DAY} AS d, o_orderkey FROM orders),
f AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER w, d) <= 60 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY d, o_orderkey)),
g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT o_custkey, island::BIGINT AS island, min(d) AS since, max(d) AS until, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1""")
def gaps_islands(t: Tables) -> DataFrame:
    """Stretches of orders at most 60 days apart."""
    w = Window.partitionBy("o_custkey").orderBy("d", "o_orderkey")
    o = t.orders.select("o_custkey", day().alias("d"), "o_orderkey")
    f = o.withColumn("new", F.when(F.datediff("d", F.lag("d").over(w)) <= 60, 0).otherwise(1))
    g = f.withColumn("island", F.sum("new").over(w.rowsBetween(*RUNNING)))
    return g.groupBy("o_custkey", "island").agg(F.min("d").alias("since"), F.max("d").alias("until"), F.count("*").alias("n")).where("n > 1")


@query("""SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (
SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def session_windows(t: Tables) -> DataFrame:
    """Sessions of events at most six hours apart, by Spark's session window (its bound is inclusive)."""
    s = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT DISTINCT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS finished, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def filtered_window_count(t: Tables) -> DataFrame:
    """A filtered count over a partition, one row each: an aggregate says it without a sort."""
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("n"))


# ------------------------------------------------------------------ set operations


@query("""SELECT 'customers without orders' AS check_name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'negative balances', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'lines without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders of no value', count(*) FROM orders WHERE o_totalprice <= 0""")
def union_quality_dashboard(t: Tables) -> DataFrame:
    def line(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))

    no_orders = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    no_part = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    lines = [line("customers without orders", no_orders), line("negative balances", t.customer.where("c_acctbal < 0")), line("lines without part", no_part), line("orders of no value", t.orders.where("o_totalprice <= 0"))]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").subtract(t.lineitem.where("l_quantity > 40").select("l_partkey"))


@query("SELECT l_suppkey FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def multiset_except(t: Tables) -> DataFrame:
    def of(flag: str) -> DataFrame:
        return t.lineitem.where(F.col("l_returnflag") == flag).select("l_suppkey")

    return of("R").exceptAll(of("A"))


@query("""SELECT 'customer.c_nationkey' AS field, count(DISTINCT c_nationkey) AS n FROM customer UNION ALL SELECT 'customer.c_mktsegment', count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'orders.o_custkey', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'part.p_brand', count(DISTINCT p_brand) FROM part""")
def cardinality_profile(t: Tables) -> DataFrame:
    fields = [("customer", "c_nationkey"), ("customer", "c_mktsegment"), ("orders", "o_custkey"), ("part", "p_brand")]
    parts = [getattr(t, a).agg(F.lit(f"{a}.{b}").alias("field"), F.count_distinct(b).alias("n")) for a, b in fields]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(f"""SELECT 'orders' AS source, max({_DAY}) AS latest, date_diff('day', max({_DAY}), DATE '2030-01-01')::INT AS age FROM orders
UNION ALL SELECT 'lineitem', max(CAST(l_shipdate AS DATE)), date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2030-01-01')::INT FROM lineitem
UNION ALL SELECT 'events', max(CAST(ts AS DATE)), date_diff('day', max(CAST(ts AS DATE)), DATE '2030-01-01')::INT FROM events""")
def freshness_profile(t: Tables) -> DataFrame:
    def line(name: str, rows: DataFrame, column: str) -> DataFrame:
        return rows.agg(F.lit(name).alias("source"), F.max(day(column)).alias("latest"), F.datediff(F.lit("2030-01-01").cast("date"), F.max(day(column))).alias("age"))

    return line("orders", t.orders, "o_orderdate").unionByName(line("lineitem", t.lineitem, "l_shipdate")).unionByName(line("events", t.events, "ts"))


# ------------------------------------------------------------------ series and calendars


@query("SELECT n::BIGINT AS n, (n * n)::BIGINT AS square FROM range(1, 101) r(n)")
def number_series(t: Tables) -> DataFrame:
    return t.spark.range(1, 101).select(F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("square"))


@query(f"""WITH d AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-08-30', INTERVAL 1 DAY))::DATE AS day)
SELECT day, count(o_orderkey) AS n FROM d LEFT JOIN orders ON {_DAY} = day GROUP BY 1""")
def calendar_days(t: Tables) -> DataFrame:
    first, last = (F.lit(x).cast("date") for x in ("1996-01-01", "1996-08-30"))
    spine = t.spark.range(1).select(F.explode(dates.day_spine(first, last)).alias("day"))
    per = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1996-08-31'").groupBy(day().alias("day")).agg(F.count("*").alias("n"))
    return spine.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT d.day FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-08-30', INTERVAL 1 DAY))::DATE AS day) d WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {_DAY} = d.day AND o_totalprice > 300000)")
def days_without(t: Tables) -> DataFrame:
    spine = t.spark.range(1).select(F.explode(dates.day_spine(F.lit("1996-01-01").cast("date"), F.lit("1996-08-30").cast("date"))).alias("day"))
    return spine.join(t.orders.where("o_totalprice > 300000").select(day().alias("day")), "day", "left_anti")


@query(f"""WITH b AS (SELECT min({_DAY}) AS a, max({_DAY}) AS z FROM orders), s AS (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH))::DATE AS month FROM b)
SELECT month, count(o_orderkey) AS n, last_day(month) AS month_end FROM s LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = month AND o_orderstatus = 'P' GROUP BY 1, 3""")
def month_spine(t: Tables) -> DataFrame:
    bounds = t.orders.agg(F.min(day()).alias("a"), F.max(day()).alias("z"))
    spine = bounds.select(F.explode(dates.month_spine(F.col("a"), F.col("z"))).alias("month"))
    per = t.orders.where("o_orderstatus = 'P'").groupBy(F.trunc(day(), "month").alias("month")).agg(F.count("*").alias("n"))
    return spine.join(per, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), F.last_day("month").alias("month_end"))


@query(f"SELECT o_orderkey, ({_DAY} + k::INT) AS day FROM orders, LATERAL (SELECT unnest(range(0, o_orderkey % 4 + 1)) AS k) x WHERE o_orderstatus = 'P'")
def expand_days(t: Tables) -> DataFrame:
    """A row per day of each order's span."""
    return t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.explode(F.sequence(day(), F.date_add(day(), F.pmod("o_orderkey", F.lit(4)).cast("int")))).alias("day"))


@query(f"""WITH b AS (SELECT min({_DAY}) AS a, max({_DAY}) AS z FROM orders), s AS (SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', z), INTERVAL 1 MONTH))::DATE AS month FROM b),
f AS (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT month, seg, coalesce(n, 0) AS n, coalesce(customers, 0) AS customers FROM s CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN f USING (month, seg)""")
def periodic_snapshot(t: Tables) -> DataFrame:
    """A row per month and segment, also where nothing happened."""
    bounds = t.orders.agg(F.min(day()).alias("a"), F.max(day()).alias("z"))
    spine = bounds.select(F.explode(dates.month_spine(F.col("a"), F.col("z"))).alias("month"))
    segments = t.customer.select(F.col("c_mktsegment").alias("seg")).distinct()
    facts = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.trunc(day(), "month").alias("month")).join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg")), "c_custkey")
    facts = facts.groupBy("month", "seg").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("customers"))
    return spine.crossJoin(segments).join(facts, ["month", "seg"], "left").select("month", "seg", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("customers", F.lit(0)).alias("customers"))  # months by segments


# ------------------------------------------------------------------ modelling and quality


@query(f"""SELECT DISTINCT {_DAY} AS day, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, strftime(o_orderdate, '%W')::INT AS week, (month(o_orderdate) + 2)::INT // 3 AS quarter, (dayofweek(o_orderdate) IN (0, 6)) AS weekend FROM orders""")
def date_dimension(t: Tables) -> DataFrame:
    d = t.orders.select(day().alias("day")).distinct()
    return d.select("day", F.year("day").alias("year"), F.month("day").alias("month"), dates.monday_week(F.col("day")).alias("week"), F.floor((F.month("day") + 2) / 3).cast("int").alias("quarter"), F.dayofweek("day").isin(1, 7).alias("weekend"))


@query(f"""SELECT o_custkey, o_orderstatus AS status, {_DAY} AS valid_from, coalesce(lead({_DAY}) OVER w, DATE '9999-12-31') AS valid_to, lead({_DAY}) OVER w IS NULL AS is_current
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def scd2_view(t: Tables) -> DataFrame:
    """Versions with their validity."""
    following = F.lead(day()).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_custkey", F.col("o_orderstatus").alias("status"), day().alias("valid_from"), F.coalesce(following, F.lit("9999-12-31").cast("date")).alias("valid_to"), following.isNull().alias("is_current"))


@query("SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus, big) AS junk_key, l_returnflag, l_linestatus, big, n FROM (SELECT l_returnflag, l_linestatus, l_quantity > 25 AS big, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)")
def junk_dimension(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).alias("big")).agg(F.count("*").alias("n"))
    return n.withColumn("junk_key", F.row_number().over(Window.orderBy("l_returnflag", "l_linestatus", "big")).cast("bigint"))  # a few combinations


@query("""SELECT o_orderkey, min(CAST(l_shipdate AS DATE)) AS first_ship, max(CAST(l_shipdate AS DATE)) AS last_ship, min(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) AS first_return, count(*) AS lines
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 4""")
def accumulating_snapshot(t: Tables) -> DataFrame:
    d = day("l_shipdate")
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(d).alias("first_ship"), F.max(d).alias("last_ship"), F.min(F.when(F.col("l_returnflag") == "R", d)).alias("first_return"), F.count("*").alias("lines"))
    return per.where("lines >= 4").join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")


@query("SELECT 'lineitem' AS child, count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'labels', count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)")
def orphan_check(t: Tables) -> DataFrame:
    def line(name: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        return child.select(key).join(parent, key, "left_anti").agg(F.lit(name).alias("child"), F.count("*").alias("orphans"))

    return line("lineitem", t.lineitem, t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").unionByName(line("labels", t.labels, t.documents.select("doc_id"), "doc_id"))


@query("SELECT count(*) AS n, count(text) AS with_text, count(l.quality) AS labelled, round(100.0 * count(l.quality) / count(*), 4) AS pct_labelled FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def completeness_profile(t: Tables) -> DataFrame:
    l = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.select("doc_id", F.col("text").isNotNull().alias("has")).join(l, "doc_id", "left").agg(
        F.count("*").alias("n"), F.count_if("has").alias("with_text"), F.count("quality").alias("labelled"), F.round(number(100) * F.count("quality") / F.count("*"), 4).alias("pct_labelled")
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.08 AND l_tax > 0.07 AND l_quantity < 5")
def logical_anomaly(t: Tables) -> DataFrame:
    return t.lineitem.where("l_discount > 0.08D AND l_tax > 0.07D AND l_quantity < 5").select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) < {_DAY}")
def temporal_coherence(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), day().alias("ordered"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey").where(day("l_shipdate") < F.col("ordered")).select("l_orderkey", "l_linenumber")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def materialised_agg(t: Tables) -> DataFrame:
    """A summary that can be written as a table once and read from then on (see sources.sinks)."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    return per.join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("k").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT count(DISTINCT o_custkey)::DOUBLE / count(*) AS selectivity FROM orders")
def selectivity(t: Tables) -> DataFrame:
    return t.orders.agg((F.count_distinct("o_custkey") / F.count("*")).alias("selectivity"))
