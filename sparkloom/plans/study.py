"""Study and news queries, on sessions and articles that events and documents stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import dates
from sparkloom.operators import ordering, study
from sparkloom.plans.registry import query
from sparkloom.tables import Tables

_KINDS = {"click": "mattina", "view": "lettura", "purchase": "artefatto", "signup": "paper", "error": "ripasso"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " END"
_PLAN = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in study.PLANNED.items()) + " END"
RAW = f"raw AS (SELECT event_id, user_id, ts AS start, {_CASE} AS kind, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + (event_id * 7919) % 14000000 - 100000 AS b FROM events)"
CLOSED = f"""{RAW}, m AS (SELECT *, floor((b - a) / 60000.0 + 0.5)::INT AS mins FROM raw),
closed AS (SELECT *, b > a AND mins >= 5 AS valid, CASE WHEN b > a AND mins >= 5 THEN CASE WHEN mins > 180 THEN {_PLAN} ELSE mins END END AS minutes,
CASE WHEN NOT (b > a AND mins >= 5) THEN 'not recorded' WHEN mins > 180 THEN 'left running' WHEN mins > 2 * {_PLAN} THEN 'over twice the plan' END AS note FROM m)"""


def sessions(t: Tables) -> DataFrame:
    """Sessions: an event starts one, its kind is by event type, its length by event id."""
    kind = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))[F.col("event_type")]
    ts = F.col("ts").cast("timestamp")
    a = F.unix_millis(ts)
    rows = t.events.select("event_id", "user_id", ts.alias("start"), kind.alias("kind"), a.alias("a"), (a + F.pmod(F.col("event_id") * 7919, F.lit(14000000)) - 100000).alias("b"))
    return rows.withColumn("c", study.closed(F.col("a"), F.col("b"), F.col("kind"))).select("event_id", "user_id", "start", "kind", "c.valid", "c.minutes", "c.note")


@query(f"WITH {CLOSED} SELECT event_id, valid, minutes, note FROM closed")
def close_session(t: Tables) -> DataFrame:
    return sessions(t).select("event_id", "valid", "minutes", "note")


_WEEK = f"{CLOSED}, ok AS (SELECT user_id, kind, minutes, date_trunc('week', start)::DATE AS week FROM closed WHERE valid)"


@query(f"""WITH {_WEEK}, w AS (SELECT user_id, week, sum(minutes)::BIGINT AS minutes, {', '.join(f"coalesce(sum(minutes) FILTER (WHERE kind = '{k}'), 0)::BIGINT AS {k}" for k in study.PLANNED)} FROM ok GROUP BY 1, 2)
SELECT *, CASE WHEN minutes >= 480 THEN 'surge' WHEN minutes >= 300 THEN 'base' ELSE 'sopravvivenza' END AS level, greatest(0, 300 - minutes) AS missing, minutes < 120 AS below FROM w""")
def weekly_summary(t: Tables) -> DataFrame:
    return study.weekly(sessions(t).where("valid"))


@query(f"""WITH {_WEEK}, w AS (SELECT user_id, week, sum(minutes) AS m FROM ok GROUP BY 1, 2), s AS (SELECT user_id, k, DATE '2024-02-26' - 7 * k::INT AS week FROM (SELECT DISTINCT user_id FROM ok), (SELECT unnest(range(1, 13)) AS k)),
j AS (SELECT user_id, k, coalesce(m, 0) >= 120 AS fine FROM s LEFT JOIN w USING (user_id, week)) SELECT user_id, (coalesce(min(k) FILTER (WHERE fine), 13) - 1)::INT AS weeks_below FROM j GROUP BY 1""")
def weeks_below_streak(t: Tables) -> DataFrame:
    return study.weeks_below(sessions(t).where("valid"), "2024-02-28")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 ELSE greatest(1, floor((1 + value) * CASE event_id % 4 WHEN 1 THEN 1.2 WHEN 2 THEN 2.2 ELSE 3.4 END + 0.5)::INT) END AS days FROM events""")
def review_schedule(t: Tables) -> DataFrame:
    return t.events.select("event_id", study.reviewed(F.lit(1.0).cast("double") + F.col("value"), F.pmod("event_id", F.lit(4))).cast("int").alias("days"))


@query("""WITH r AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) + CASE event_id % 4 WHEN 0 THEN 0 ELSE 1 + (event_id % 9)::INT END AS due FROM events),
l AS (SELECT user_id, event_id % 50 AS card, arg_max(due, (ts, event_id)) AS due FROM r GROUP BY 1, 2) SELECT user_id, card, due FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due, card) AS k FROM l WHERE due <= DATE '2024-01-20') WHERE k <= 30""")
def due_cards(t: Tables) -> DataFrame:
    """Cards whose latest review set them for now or earlier, thirty per person."""
    due = F.date_add(F.col("ts").cast("date"), F.when(F.pmod("event_id", F.lit(4)) == 0, 0).otherwise(1 + F.pmod("event_id", F.lit(9)).cast("int")))
    latest = t.events.groupBy("user_id", F.pmod("event_id", F.lit(50)).alias("card")).agg(F.max_by(due, F.struct("ts", "event_id")).alias("due"))
    w = Window.partitionBy("user_id").orderBy("due", "card")
    return latest.where("due <= DATE '2024-01-20'").withColumn("k", F.row_number().over(w)).where("k <= 30").select("user_id", "card", "due")


@query("""WITH g AS (SELECT user_id, list(event_id % 4 ORDER BY ts, event_id) AS grades FROM events GROUP BY 1) SELECT user_id, len(grades) AS n, grades[-1] AS last_grade FROM g""")
def review_history(t: Tables) -> DataFrame:
    """Each person's grades in order; the fold over them is study.review_history (tested apart)."""
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("x"))
    grades = F.transform("x", lambda e: F.pmod(e["event_id"], F.lit(4)))
    return g.select("user_id", F.size("x").cast("bigint").alias("n"), F.element_at(grades, -1).alias("last_grade"))


@query("""WITH g AS (SELECT user_id, event_id % 50 AS card, list(event_id % 4 ORDER BY ts, event_id) AS grades FROM events GROUP BY 1, 2)
SELECT user_id, card, list_reduce(grades, lambda days, g: CASE g WHEN 0 THEN 0 ELSE greatest(1, floor(greatest(days, 1) * CASE g WHEN 1 THEN 1.2 WHEN 2 THEN 2.2 ELSE 3.4 END::DOUBLE + 0.5)::BIGINT) END, 1::BIGINT)::INTEGER AS days FROM g""")
def review_fold(t: Tables) -> DataFrame:
    """Days to the next review of each card, folded over its grades in order."""
    g = t.events.groupBy("user_id", F.pmod("event_id", F.lit(50)).alias("card")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("x"))  # one card's reviews
    return g.select("user_id", "card", study.review_history(F.transform("x", lambda e: F.pmod(e["event_id"], F.lit(4)))).alias("days"))


MATERIAL = """a AS (SELECT lang AS topic, count(*) AS texts FROM documents GROUP BY 1), b AS (SELECT lang AS topic, count(*) AS labelled, count(*) FILTER (WHERE quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1),
material AS (SELECT topic, coalesce(texts, 0) AS texts, coalesce(labelled, 0) AS labelled, coalesce(good, 0) AS good FROM a FULL JOIN b USING (topic))"""


def material(t: Tables) -> DataFrame:
    a = t.documents.groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("texts"))
    b = t.documents.select("doc_id", F.col("lang").alias("topic")).join(t.labels, "doc_id").groupBy("topic").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    return a.join(b, "topic", "full").select("topic", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("texts", "labelled", "good")))


@query(f"WITH {MATERIAL} SELECT * FROM material")
def material_by_topic(t: Tables) -> DataFrame:
    """Counts of several kinds of material joined on the topic, zero where there is none."""
    return material(t)


UNITS = f"""{MATERIAL}, r AS (SELECT *, CASE WHEN texts > 0 THEN least(labelled / ceil(texts * 80 / 100.0), 1.0) END AS r1, CASE WHEN labelled > 0 THEN least(good / ceil(labelled * 80 / 100.0), 1.0) END AS r2 FROM material),
units AS (SELECT topic, round(coalesce((coalesce(r1, 0) + coalesce(r2, 0)) / nullif((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT, 0), 0), 6)::DOUBLE AS progress,
CASE WHEN r1 IS NULL AND r2 IS NULL THEN 'senza_verifiche' WHEN coalesce(r1, 1) >= 1 AND coalesce(r2, 1) >= 1 THEN 'completa' WHEN labelled + good > 0 THEN 'in_corso' ELSE 'da_iniziare' END AS state FROM r)"""


def units(t: Tables) -> DataFrame:
    m = material(t).select("topic", F.col("labelled").alias("a_done"), F.col("texts").alias("a_total"), F.col("good").alias("b_done"), F.col("labelled").alias("b_total"))
    return study.units(m, ["a", "b"]).select("topic", "progress", "state")


@query(f"WITH {UNITS} SELECT * FROM units")
def unit_progress(t: Tables) -> DataFrame:
    return units(t)


@query(f"WITH {UNITS} SELECT topic, CASE WHEN state <> 'senza_verifiche' THEN row_number() OVER (PARTITION BY state = 'senza_verifiche' ORDER BY topic) END AS position FROM units")
def unit_order(t: Tables) -> DataFrame:
    """Numbers only units that have checks (a few dozen units)."""
    bare = F.col("state") == "senza_verifiche"
    return units(t).select("topic", F.when(~bare, F.row_number().over(Window.partitionBy(bare).orderBy("topic")).cast("bigint")).alias("position"))


@query(f"WITH {UNITS} SELECT min(topic) AS topic FROM units WHERE state NOT IN ('completa', 'senza_verifiche')")
def next_step(t: Tables) -> DataFrame:
    return units(t).where(~F.col("state").isin("completa", "senza_verifiche")).agg(F.min("topic").alias("topic"))


NEWS = """born AS (SELECT event_id, min(ts) AS at FROM events GROUP BY 1),
news AS (SELECT doc_id, lang AS area, source, TIMESTAMP '2024-01-01' + to_days((doc_id % 40)::INT) + to_hours((doc_id % 24)::INT) AS published, TIMESTAMP '2024-01-10' + to_days((doc_id % 25)::INT) AS collected FROM documents),
dated AS (SELECT *, CASE WHEN published <= collected THEN published ELSE collected END::DATE AS day FROM news)"""


def news(t: Tables) -> DataFrame:
    def at(start: str, days: int, hours: int = 1):
        return F.lit(start).cast("timestamp") + F.make_dt_interval(days=F.pmod("doc_id", F.lit(days)).cast("int"), hours=F.pmod("doc_id", F.lit(hours)).cast("int"))

    rows = t.documents.select("doc_id", F.col("lang").alias("area"), "source", at("2024-01-01", 40, 24).alias("published"), at("2024-01-10", 25).alias("collected"))
    return rows.withColumn("day", study.news_day(F.col("published"), F.col("collected")))


@query(f"WITH {NEWS} SELECT doc_id, day, row_number() OVER (PARTITION BY area ORDER BY day DESC, collected DESC, born.at NULLS FIRST, doc_id) AS place FROM dated LEFT JOIN born ON born.event_id = dated.doc_id")
def news_rank(t: Tables) -> DataFrame:
    """Day, then run, then birth in the log, then id, within an area."""
    born = t.events.groupBy(F.col("event_id").alias("doc_id")).agg(F.min("ts").alias("at"))
    w = Window.partitionBy("area").orderBy(F.desc("day"), F.desc("collected"), F.asc_nulls_first("at"), "doc_id")
    return news(t).join(born, "doc_id", "left").select("doc_id", "day", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"WITH {NEWS} SELECT area, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY day DESC, collected DESC, doc_id) AS k FROM dated) WHERE k <= 4")
def news_top4(t: Tables) -> DataFrame:
    w = Window.partitionBy("area").orderBy(F.desc("day"), F.desc("collected"), "doc_id")
    return news(t).withColumn("k", F.row_number().over(w)).where("k <= 4").select("area", "doc_id")


@query(f"""WITH {NEWS}, n AS (SELECT greatest(0, date_diff('day', day, DATE '2024-02-03')) AS ago FROM dated)
SELECT CASE WHEN ago = 0 THEN 'oggi' WHEN ago = 1 THEN 'ieri' WHEN ago < 7 THEN 'questa settimana' ELSE 'prima' END AS span, count(*) AS n FROM n GROUP BY 1""")
def news_day_groups(t: Tables) -> DataFrame:
    return news(t).groupBy(study.day_group(F.col("day"), "2024-02-03").alias("span")).agg(F.count("*").alias("n"))


@query(f"WITH {NEWS} SELECT coalesce(nullif(area, 'de'), 'esplorazione') AS category, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS unread FROM dated GROUP BY 1")
def category_counts(t: Tables) -> DataFrame:
    """Articles and unread ones per area; an area the plan does not have is exploration."""
    area = F.when(F.col("area").isin("en", "fr", "es"), F.col("area")).otherwise("esplorazione")
    return news(t).groupBy(area.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.pmod("doc_id", F.lit(2)) == 0).alias("unread"))


@query("""SELECT page_id, upto FROM (SELECT page_id, sum(length(html)) OVER (PARTITION BY page_id % 5 ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM pages) WHERE upto <= 60000""")
def download_queue(t: Tables) -> DataFrame:
    """Newest files first, as many as a budget of bytes allows, per device."""
    p = t.pages.select("page_id", F.length("html").alias("size"), F.pmod("page_id", F.lit(5)).alias("device"))
    return study.within_budget(p, 60_000, "device", F.desc("page_id")).select("page_id", "upto")


@query("""SELECT page_id, upto FROM (SELECT page_id, (sum(length(html)) OVER (ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM pages) WHERE upto <= 400000""")
def download_order(t: Tables) -> DataFrame:
    """Newest files first, as many as one budget of bytes allows for all devices: a running sum over one order."""
    p = t.pages.select("page_id", F.length("html").cast("bigint").alias("size"))
    return study.within_whole_budget(p, 400_000, F.desc("page_id")).select("page_id", "upto")


@query("SELECT o_orderkey, (sum(round(o_totalprice * 100)::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM orders")
def turnover_to_date(t: Tables) -> DataFrame:
    """Cents of turnover up to each order, over all orders by date."""
    o = t.orders.select("o_orderdate", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return ordering.running_total(o, [F.col("o_orderdate"), F.col("o_orderkey")], "cents", "upto").select("o_orderkey", "upto")


@query("SELECT d.doc_id FROM documents d WHERE d.n_chars >= 1000 AND EXISTS (SELECT 1 FROM pages p WHERE sha1('v:' || p.page_id) = sha1('v:' || d.doc_id)) AND d.doc_id % 2 = 0")
def cleanup_set(t: Tables) -> DataFrame:
    """Read articles with a long text whose volume can go: a semi-join on a hashed key."""
    def code(x: str):
        return F.sha1(F.concat(F.lit("v:"), F.col(x).cast("string")).cast("binary")).alias("code")

    d = t.documents.where("n_chars >= 1000 AND doc_id % 2 = 0").select("doc_id", code("doc_id"))
    return d.join(t.pages.select(code("page_id")), "code", "left_semi").select("doc_id")


@query("SELECT source, max(CAST(regexp_extract(source, '[0-9]+') AS INT)) AS build, count(*) AS n FROM documents GROUP BY 1 ORDER BY build DESC, source LIMIT 1")
def release_selection(t: Tables) -> DataFrame:
    """The highest build number, read tolerantly."""
    build = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    return t.documents.groupBy("source").agg(F.max(build).alias("build"), F.count("*").alias("n")).orderBy(F.desc("build"), "source").limit(1)


@query("""SELECT event_id, CASE WHEN slot > ts THEN slot ELSE slot + INTERVAL 7 DAY END AS next_at FROM (SELECT event_id, ts, date_trunc('day', ts) + to_days(((2 - (isodow(ts) - 1) + 7) % 7)::INT) + INTERVAL 18 HOUR AS slot FROM events)""")
def next_reminder(t: Tables) -> DataFrame:
    """The next Wednesday at six in the evening after each event."""
    return t.events.select("event_id", study.next_occurrence(F.col("ts"), 2, 18).cast("timestamp_ntz").alias("next_at"))


@query("""WITH l AS (SELECT user_id, event_id % 40 AS exercise, arg_max(event_type, (ts, event_id)) AS outcome FROM events GROUP BY 1, 2)
SELECT user_id, exercise FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY exercise % 4, exercise) AS k FROM l WHERE outcome <> 'purchase') WHERE k <= 40""")
def unsolved_exercises(t: Tables) -> DataFrame:
    """Exercises whose latest outcome is not a success, by level."""
    latest = t.events.groupBy("user_id", F.pmod("event_id", F.lit(40)).alias("exercise")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"))
    w = Window.partitionBy("user_id").orderBy(F.pmod("exercise", F.lit(4)), "exercise")
    return latest.where("outcome <> 'purchase'").withColumn("k", F.row_number().over(w)).where("k <= 40").select("user_id", "exercise")


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS people, count(*) FILTER (WHERE event_type = 'purchase') AS solved, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS recent FROM events")
def dashboard_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("people"), F.count_if(F.col("event_type") == "purchase").alias("solved"), F.count_if(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).alias("recent"))


@query("SELECT doc_id, source, (text IS NOT NULL AND text <> '') AS has_text FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 2 = 1")
def article_list(t: Tables) -> DataFrame:
    """A list says whether there is a text, but does not carry it."""
    return t.documents.where(F.col("lang").isin("en", "fr") & (F.pmod("doc_id", F.lit(2)) == 1)).select("doc_id", "source", (F.col("text").isNotNull() & (F.col("text") != "")).alias("has_text"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (CASE WHEN turn % 3 = 0 THEN NULL ELSE turn END) NULLS LAST, turn) AS place FROM conversations")
def annotations_nulls_last(t: Tables) -> DataFrame:
    page = F.when(F.pmod("turn", F.lit(3)) != 0, F.col("turn"))
    return t.conversations.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last(page), "turn")).cast("bigint").alias("place"))


@query("SELECT year(o_orderdate)::INT AS year, 'T' || (month(o_orderdate) + 2) // 3 AS quarter, count(*) AS n, round(sum(o_totalprice), 2) AS cost FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def artefacts_by_quarter(t: Tables) -> DataFrame:
    """Finished work per quarter, with what it cost."""
    d = F.col("o_orderdate").cast("date")
    return t.orders.where("o_orderstatus = 'F'").groupBy(F.year(d).alias("year"), dates.quarter_label(d).alias("quarter")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query(f"WITH {CLOSED} SELECT user_id, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY start DESC, event_id) AS k FROM closed WHERE valid) WHERE k <= 3")
def recent_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "kind").orderBy(F.desc("start"), "event_id")
    return sessions(t).where("valid").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "kind", "event_id")


@query("SELECT conv_id, min(turn) AS first_turn, count(*) AS n, max(length(text)) AS longest FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) > 1")
def note_list(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.max(F.length("text")).cast("bigint").alias("longest")).where("n > 1")


@query("SELECT item_id, length(text) AS n FROM benchmark WHERE length(text) > 100 ORDER BY item_id LIMIT 20")
def manual_uploads(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.length("text").cast("bigint").alias("n")).where("n > 100").orderBy("item_id").limit(20)


@query("""SELECT c.conv_id, max(c.turn) FILTER (WHERE length(c.text) > 200) IS NOT NULL AS solved, arg_max(c.turn, (length(c.text) > 200, c.turn)) AS note_id FROM conversations c GROUP BY 1""")
def scenario_solved(t: Tables) -> DataFrame:
    """Scenarios whose note is more than its template: here a template is a text of at most 200 characters."""
    exercises = t.conversations.select(F.col("conv_id").alias("id"), F.lit("template").alias("template")).distinct()
    body = F.when(F.length("text") > 200, F.col("text")).otherwise("template")
    notes = t.conversations.select(F.col("conv_id").alias("exercise_id"), F.col("turn").alias("note_id"), body.alias("body"), F.lpad(F.col("turn").cast("string"), 12, "0").alias("hlc"))
    return study.scenarios(exercises, notes).select(F.col("id").alias("conv_id"), "solved", "note_id")


@query("SELECT count(*) AS n FROM events WHERE event_id % 3 = 0")
def unsent_count(t: Tables) -> DataFrame:
    return t.events.where("event_id % 3 = 0").agg(F.count("*").alias("n"))
