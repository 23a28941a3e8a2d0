"""Scans, filters, scalar functions, joins: the relational workbench on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import dates, text, urls
from sparkloom.plans.registry import query
from sparkloom.tables import Tables

_DAY = "CAST(o_orderdate AS DATE)"


def day(name: str = "o_orderdate"):
    return F.col(name).cast("date")


# ------------------------------------------------------------------ filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' AND o_totalprice BETWEEN 1000 AND 50000")
def filter_eq_range(t: Tables) -> DataFrame:
    """Equality, date range and BETWEEN, as range predicates that reach the scan."""
    date = F.col("o_orderdate")
    span = (date >= F.lit("1996-01-01").cast("timestamp_ntz")) & (date < F.lit("1997-01-01").cast("timestamp_ntz"))
    return t.orders.where((F.col("o_orderstatus") == "O") & span & F.col("o_totalprice").between(1000, 50000)).select("o_orderkey", "o_totalprice")


@query("SELECT d.doc_id, (l.quality IS NULL)::INT AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL")
def filter_null(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.where(F.col("quality").isNull() | F.col("toxic").isNotNull()).select("doc_id", F.col("quality").isNull().cast("int").alias("unlabelled"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def filter_in(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey")


@query("SELECT count(*) AS n FROM part WHERE p_type ILIKE '%a%' OR p_name ILIKE 'P%'")
def ilike_count(t: Tables) -> DataFrame:
    """LIKE without regard to case."""
    return t.part.where(F.col("p_type").ilike("%a%") | F.col("p_name").ilike("P%")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 100000 THEN 'medium' ELSE 'large' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done, count(*) AS n FROM orders GROUP BY 1, 2")
def case_label(t: Tables) -> DataFrame:
    band = F.when(F.col("o_totalprice") < 1000, "small").when(F.col("o_totalprice") < 100000, "medium").otherwise("large")
    return t.orders.groupBy(band.alias("band"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_total_order(t: Tables) -> DataFrame:
    """A total order under LIMIT, so that the k rows are always the same."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 1000 * l_quantity")
def filter_arithmetic(t: Tables) -> DataFrame:
    """Column against column."""
    return t.lineitem.where(F.col("l_extendedprice") * (1 - F.col("l_discount")) > 1000 * F.col("l_quantity")).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey IN (1, 2, 3)")
def filter_dynamic(t: Tables) -> DataFrame:
    """A WHERE clause put together from a list of conditions."""
    wanted = [F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0, F.col("c_nationkey").isin(1, 2, 3)]
    keep = F.lit(True)
    for condition in wanted:
        keep &= condition
    return t.customer.where(keep).select("c_custkey")


@query("SELECT count(*) FILTER (WHERE o_totalprice > 100000) AS dear, sum((o_orderstatus = 'F')::INT)::BIGINT AS finished FROM orders")
def boolean_sums(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_totalprice") > 100000).alias("dear"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT s_suppkey, coalesce(nullif(s_nationkey, 0), -1) AS nation, s_acctbal / nullif(s_nationkey, 0) AS per_nation FROM supplier")
def nullif_coalesce(t: Tables) -> DataFrame:
    nation = F.nullif("s_nationkey", F.lit(0))
    return t.supplier.select("s_suppkey", F.coalesce(nation, F.lit(-1)).alias("nation"), F.try_divide("s_acctbal", nation).alias("per_nation"))


# ------------------------------------------------------------------ scalar functions


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number, substr(c_name, 1, 4) AS head FROM customer")
def substr_cast(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.regexp_extract("c_name", "[0-9]+", 0).try_cast("bigint").alias("number"), F.substring("c_name", 1, 4).alias("head"))


@query("SELECT DISTINCT upper(trim(p_type)) AS kind, lower(p_brand) AS brand, length(p_type) AS size FROM part")
def upper_trim(t: Tables) -> DataFrame:
    return t.part.select(F.upper(F.trim("p_type")).alias("kind"), F.lower("p_brand").alias("brand"), F.length("p_type").cast("bigint").alias("size")).distinct()


@query("SELECT o_orderkey, 'order ' || o_orderkey || ' (' || o_orderstatus || ') ' || strftime(o_orderdate, '%Y-%m') AS label FROM orders")
def concat_label(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" ("), "o_orderstatus", F.lit(") "), dates.month_label(F.col("o_orderdate"))).alias("label"))


@query(f"SELECT o_orderkey, {_DAY} + CAST(o_orderkey % 30 AS INT) AS due, CAST({_DAY} + INTERVAL 1 MONTH AS DATE) AS next_month FROM orders")
def date_add_n(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_add(day(), F.pmod("o_orderkey", F.lit(30)).cast("int")).alias("due"), F.add_months(day(), 1).alias("next_month"))


@query(f"SELECT o_orderkey, last_day({_DAY}) AS month_end FROM orders WHERE {_DAY} = last_day({_DAY})")
def month_end(t: Tables) -> DataFrame:
    return t.orders.where(day() == F.last_day(day())).select("o_orderkey", F.last_day(day()).alias("month_end"))


@query("SELECT 'T' || (month(o_orderdate) + 2) // 3 AS quarter, count(*) AS n FROM orders GROUP BY 1")
def quarter(t: Tables) -> DataFrame:
    return t.orders.groupBy(dates.quarter_label(day()).alias("quarter")).agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate)::INT AS year, strftime(o_orderdate, '%W')::INT AS week, count(*) AS n FROM orders GROUP BY 1, 2")
def week_monday00(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year(day()).alias("year"), dates.monday_week(day()).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT isoyear(o_orderdate)::INT AS year, weekofyear(o_orderdate)::INT AS week, count(*) AS n FROM orders GROUP BY 1, 2")
def week_iso(t: Tables) -> DataFrame:
    """The ISO week, under its own name."""
    return t.orders.groupBy(F.extract(F.lit("YEAROFWEEK"), day()).alias("year"), F.weekofyear(day()).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%w') AS weekday, count(*) AS n FROM orders GROUP BY 1")
def weekday0(t: Tables) -> DataFrame:
    return t.orders.groupBy(dates.weekday0(day()).alias("weekday")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(trunc(date_diff('day', {_DAY}, DATE '2000-01-01') / 365.25) AS INT) AS age, count(*) AS n FROM orders GROUP BY 1")
def age_years(t: Tables) -> DataFrame:
    return t.orders.groupBy(dates.age_years(day(), F.lit("2000-01-01").cast("date")).alias("age")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN a < 2 THEN '0-1' WHEN a < 4 THEN '2-3' WHEN a < 6 THEN '4-5' ELSE '6+' END AS band, count(*) AS n FROM (SELECT date_diff('day', {_DAY}, DATE '2000-01-01') / 365.25 AS a FROM orders) GROUP BY 1")
def age_bands(t: Tables) -> DataFrame:
    age = F.datediff(F.lit("2000-01-01").cast("date"), day()) / 365.25
    return t.orders.groupBy(F.when(age < 2, "0-1").when(age < 4, "2-3").when(age < 6, "4-5").otherwise("6+").alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS doc FROM part""")
def json_build(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("doc"))


@query("SELECT o_custkey, '[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']' AS orders FROM orders GROUP BY 1")
def json_array_agg(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list("o_orderkey"))).alias("orders"))


@query("""SELECT o_custkey, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS by_status
FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def json_object_agg(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderstatus", "n"))))).alias("by_status"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, j.key AS field, json_extract_string(props, '$.' || j.key) AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) j")
def json_explode(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


@query("SELECT doc_id, 'RAS-' || substr(sha1('doc:' || doc_id), 1, 16) AS code, sha256(text) AS sha FROM documents")
def hash_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.hashed_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("code"), F.sha2("text", 256).alias("sha"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM documents")
def title_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.title_key(F.substring_index("text", "\n", 1)).alias("title_key"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS site FROM h""")
def url_host(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.site(F.col("url")).alias("site"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 200) AS head FROM documents),
p AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') + 1 END AS blank FROM h)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN blank >= 100 THEN rtrim(substr(head, 1, blank - 1)) || '…' ELSE head || '…' END AS excerpt FROM p""")
def excerpt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT count(*) AS n FROM documents WHERE list_contains(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+'), 'que')")
def whole_word_count(t: Tables) -> DataFrame:
    """Whole words in any script."""
    return t.documents.where(text.has_word(text.folded(F.col("text")), "que")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ joins


@query("SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner_3way(t: Tables) -> DataFrame:
    """Counts per customer first, so that the join to customers moves one row per customer."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    placed = per.join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return placed.groupBy("n_name").agg(F.sum("n").alias("orders"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left_count(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
def join_left_anti(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey WHERE o.o_custkey = c.c_custkey AND l_returnflag = 'R')")
def join_not_exists_nested(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    buyers = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(returned, "o_orderkey", "left_semi")
    return t.customer.select("c_custkey").join(buyers, "c_custkey", "left_anti")


@query("SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 45)")
def join_left_semi(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").join(t.lineitem.where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l_returnflag = 'R' AND l_quantity > 49) THEN 'yes' ELSE 'no' END AS big_returns FROM supplier s")
def exists_flag(t: Tables) -> DataFrame:
    keys = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return t.supplier.select("s_suppkey").join(keys.withColumn("hit", F.lit(True)), "s_suppkey", "left").select("s_suppkey", F.when(F.col("hit"), "yes").otherwise("no").alias("big_returns"))


@query("SELECT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000) AS dear_buyer, count(*) AS n FROM customer c GROUP BY 1")
def exists_group_key(t: Tables) -> DataFrame:
    keys = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return t.customer.select("c_custkey").join(keys, "c_custkey", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("dear_buyer")).agg(F.count("*").alias("n"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS nation FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500")
def self_join_pairs(t: Tables) -> DataFrame:
    """Pairs within a nation whose balances are close: the balance's bucket is part of the key, so that
    a hot nation is not compared with itself as a whole; each row looks into its own and the next bucket."""
    s = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal", F.floor(F.col("s_acctbal") / 500).alias("bucket"))
    other = s.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey"), F.col("s_acctbal").alias("v"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), F.col("bucket").alias("home"))
    once = (F.col("home") > F.col("bucket")) | (F.col("s_suppkey") < F.col("k"))
    pairs = s.join(other, ["s_nationkey", "bucket"]).where(once & (F.col("s_suppkey") != F.col("k")) & (F.abs(F.col("s_acctbal") - F.col("v")) < 500))
    return pairs.select(F.least("s_suppkey", "k").alias("a"), F.greatest("s_suppkey", "k").alias("b"), F.col("s_nationkey").alias("nation"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, {_DAY} AS d FROM orders)
SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS again, date_diff('day', a.d, b.d)::INT AS days FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.d > a.d AND date_diff('day', a.d, b.d) <= 7""")
def self_join_within_days(t: Tables) -> DataFrame:
    """Equi keys are customer and week; the later side looks back into its own and the previous week."""
    o = t.orders.select("o_custkey", "o_orderkey", day().alias("d"), F.floor(F.datediff(day(), F.lit("1970-01-01").cast("date")) / 7).alias("week"))
    later = o.select("o_custkey", F.col("o_orderkey").alias("again"), F.col("d").alias("e"), F.explode(F.array(F.col("week"), F.col("week") - 1)).alias("week"))
    days = F.datediff("e", "d")
    return o.join(later, ["o_custkey", "week"]).where((days > 0) & (days <= 7)).select("o_custkey", F.col("o_orderkey").alias("first"), "again", days.alias("days"))


@query("""SELECT b.lo::INT AS lo, count(p_partkey) AS n FROM (SELECT unnest(range(0, 60, 10)) AS lo) b LEFT JOIN part ON p_size >= b.lo AND p_size < b.lo + 10 GROUP BY 1""")
def range_bucket_join(t: Tables) -> DataFrame:
    """A range join as an equi-join on the bucket."""
    spine = t.spark.range(0, 60, 10).select(F.col("id").cast("int").alias("lo"))
    per = t.part.groupBy((F.floor(F.col("p_size") / 10) * 10).cast("int").alias("lo")).agg(F.count("p_partkey").alias("n"))
    return spine.join(per, "lo", "left").select("lo", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, CASE WHEN s.s_nationkey IS NULL THEN 'customers' WHEN c.c_nationkey IS NULL THEN 'suppliers' ELSE 'both' END AS side
FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 3 = 0) c FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier) s ON c.c_nationkey = s.s_nationkey""")
def full_outer_presence(t: Tables) -> DataFrame:
    c = t.customer.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("c")).distinct()
    s = t.supplier.select(F.col("s_nationkey").alias("s")).distinct()
    side = F.when(F.col("s").isNull(), "customers").when(F.col("c").isNull(), "suppliers").otherwise("both")
    return c.join(s, F.col("c") == F.col("s"), "full").select(F.coalesce("c", "s").alias("nation"), side.alias("side"))


@query("""SELECT n_name, seg AS segment, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = seg AND c_acctbal > 9000) AS covered
FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)""")
def cross_coverage_matrix(t: Tables) -> DataFrame:
    """Every nation with every segment: both sides have a few fixed rows."""
    seg = t.customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    hit = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).distinct().withColumn("hit", F.lit(True))
    return t.nation.select("n_nationkey", "n_name").crossJoin(seg).join(hit, ["n_nationkey", "segment"], "left").select("n_name", "segment", F.coalesce("hit", F.lit(False)).alias("covered"))


@query("SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY 1")
def scalar_subquery_pct(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.select("o_orderstatus", "n", F.round(F.lit(100.0).cast("double") * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("pct"))  # a row per status


@query(f"SELECT c_custkey, (SELECT max({_DAY}) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer")
def correlated_latest(t: Tables) -> DataFrame:
    latest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(day()).alias("latest"))
    return t.customer.select("c_custkey").join(latest, "c_custkey", "left")


@query("""SELECT n_name, a.n AS customers, coalesce(b.n, 0) AS suppliers FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a ON a.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON b.k = n_nationkey""")
def derived_table_join(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    return t.nation.join(a, "n_nationkey").join(b, "n_nationkey", "left").select("n_name", "customers", F.coalesce("s", F.lit(0)).alias("suppliers"))
