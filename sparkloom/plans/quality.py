"""Text extraction, source quality, set-based procedures, result comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import dates, html, text, urls
from sparkloom.operators import audit, compare
from sparkloom.plans.registry import query
from sparkloom.tables import Tables, spread

# ------------------------------------------------------------------ text


@query()
def html_text(t: Tables) -> DataFrame:
    """Readable text of each page; tests hold it against known pages."""
    return spread(t.pages).select("page_id", html.html_text("html").alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_bare(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.bare(F.col("html")).alias("text"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref="([^"]*)"', 1)) AS link FROM pages""")
def html_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(html), 'creativecommons\\.org/licenses/|\\bcc[ -]by\\b') THEN 'cc' WHEN contains(lower(html), 'open government licence') THEN 'ogl'
WHEN regexp_matches(lower(html), 'rel="?license') THEN 'declared' WHEN regexp_matches(lower(html), '©|&copy;|copyright|all rights reserved') THEN 'copyright' END AS licence,
regexp_matches(lower(html), 'for paid subscribers|subscribe to continue|subscribe to keep reading|become a paid subscriber|members only|sign in to read|premium content') AS walled FROM pages""")
def licence_detection(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.licence(F.col("html")).alias("licence"), html.paywalled(F.col("html")).alias("walled"))


@query(r"SELECT conv_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\s+', ' ', 'g')) AS text FROM conversations GROUP BY 1")
def transcript_text(t: Tables) -> DataFrame:
    """Conversations written as WebVTT and read back as prose.  Markup is escaped and empty lines go, as no cue can hold
    them; between cues is a pause, so that what is said twice stays."""
    said = F.regexp_replace(F.trim(F.regexp_replace("text", r"[ \t\r\f]*\n[ \t\n\r\f]*|\r[ \t\n\r\f]*", "\n")), "^\n|\n$", "")
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        said = F.replace(said, F.lit(char), F.lit(reference))
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull(), "turn", said.alias("said")))).alias("x"))

    def time(at: Column) -> Column:
        return F.concat_ws(":", *(F.format_string("%02d", x) for x in (F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)))

    turns = turns.select("conv_id", F.filter("x.said", lambda s: s.isNotNull()).alias("x"))
    cues = F.transform("x", lambda s, i: F.concat(time(i * 2), F.lit(".000 --> "), time(i * 2 + 1), F.lit(".000\n"), s, F.lit("\n")))
    return turns.select("conv_id", F.when(F.size("x") > 0, html.transcript_text(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n")))).alias("text"))


@query(r"""SELECT source, 'D' || doc_id AS title, 'https://example.org/' || doc_id AS link, DATE '2024-01-01' AS day, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS text_sha256 FROM documents""")
def feed_items(t: Tables) -> DataFrame:
    """Documents, with their whole texts, written as one RSS feed per source and language and read back."""
    body = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<item><title>D"), F.col("doc_id").cast("string"), F.lit("</title><link>https://example.org/"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>"), body, F.lit("</description></item>"))
    feeds = t.documents.select("source", "lang", F.col("doc_id"), entry.alias("e")).groupBy("source", "lang", F.floor(F.col("doc_id") / 1000).alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "e"))).alias("x"))
    read = feeds.select("source", F.explode(html.feed_items(F.concat(F.lit("<rss><channel>"), F.array_join("x.e", ""), F.lit("</channel></rss>")))).alias("i"))
    return read.select("source", "i.title", "i.link", dates.feed_date(F.col("i.date")).alias("day"), F.sha2("i.text", 256).alias("text_sha256"))


@query("""WITH e AS (SELECT doc_id, (doc_id % 5)::INT AS form, DATE '2024-01-01' + (doc_id % 300)::INT AS d FROM documents)
SELECT doc_id, CASE WHEN form = 4 THEN NULL ELSE d END AS day FROM e""")
def feed_dates(t: Tables) -> DataFrame:
    """Dates in the forms that feeds use, read back; what is not a date is null."""
    d = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(300)).cast("int"))
    form = F.pmod("doc_id", F.lit(5))
    written = (
        F.when(form == 0, F.concat(F.date_format(d, "EEE"), F.lit(", "), F.date_format(d, "dd MMM yyyy"), F.lit(" 10:00:00 GMT")))
        .when(form == 1, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T08:30:00Z")))
        .when(form == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:30:00-00:15")))
        .when(form == 3, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.lit("soon"))
    )
    return t.documents.select("doc_id", dates.feed_date(written).alias("day"))


# ------------------------------------------------------------------ sources

#: Every seventh source's feed is broken; those of src5 have articles that can't be read.
AUDIT = """i AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, DATE '2024-06-01' - (doc_id % 500)::INT AS day, n_chars >= 800 AS useful, n_chars AS summary_chars,
trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g')) AS title_key, contains(lower(text), 'licen') OR source <> 'src3' AS licensed, source <> 'src4' AS same_site, doc_id % 11 = 0 AS walled, doc_id % 4 = 1 AS is_pdf, source NOT IN ('src5', 'src6') AS reachable FROM documents WHERE source <> 'src7'),
g AS (SELECT source, count(*) AS n, date_diff('day', max(day), DATE '2024-06-15')::INT AS days, max(day) = arg_min(day, nth) AS ordered, count(*) FILTER (WHERE useful) AS useful,
list_sort(list(summary_chars))[len(list(summary_chars)) // 2 + 1] AS median_chars, count(DISTINCT title_key) AS distinct_titles, max(licensed) AS licensed, max(same_site) AS same_site, count(*) FILTER (WHERE walled AND nth <= 3) AS walled, count(*) FILTER (WHERE is_pdf) AS n_pdf, count(*) FILTER (WHERE reachable AND nth <= 3) AS reachable FROM i WHERE nth <= 10 GROUP BY 1),
a AS (SELECT *, concat_ws('; ', CASE WHEN days > 365 THEN 'p0 muerto' END, CASE WHEN NOT ordered THEN 'p2 orden' END, CASE WHEN useful < 4 THEN 'p3 utiles' END, CASE WHEN distinct_titles < 0.8 * n THEN 'p6 duplicados' END,
CASE WHEN NOT licensed THEN 'p7 sin licencia' END, CASE WHEN NOT same_site THEN 'p8 canal' END, CASE WHEN walled > 1 THEN 'p9 muro' END, CASE WHEN reachable = 0 AND median_chars < 500 THEN 'p9 sin texto accesible' END) AS why FROM g),
audit AS (SELECT *, CASE WHEN why = '' THEN 'ACEPTADA' ELSE why END AS reason, CASE WHEN source < 'src3' THEN 'solo metadati' ELSE 'cc' END AS licence FROM a
UNION ALL BY NAME SELECT DISTINCT source, 'p1 roto (HTTP 404)' AS reason, CASE WHEN source < 'src3' THEN 'solo metadati' ELSE 'cc' END AS licence FROM documents WHERE source = 'src7')"""


def audited(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    source = F.col("source")
    items = t.documents.select(
        "source",
        F.row_number().over(w).alias("nth"),
        F.date_sub(F.lit("2024-06-01").cast("date"), F.pmod("doc_id", F.lit(500)).cast("int")).alias("day"),
        (F.col("n_chars") >= 800).alias("useful"),
        F.col("n_chars").alias("summary_chars"),
        text.title_key(F.substring_index("text", "\n", 1)).alias("title_key"),
        (F.lower("text").contains("licen") | (source != "src3")).alias("licensed"),
        (source != "src4").alias("same_site"),
        (F.pmod("doc_id", F.lit(11)) == 0).alias("walled"),
        (F.pmod("doc_id", F.lit(4)) == 1).alias("is_pdf"),
        (~source.isin("src5", "src6")).alias("reachable"),
    )
    down = source == "src7"
    broken = t.documents.where(down).select("source", F.lit("HTTP 404").alias("problem")).distinct()
    licence = F.when(source < "src3", audit.METADATA_ONLY).otherwise("cc")
    return audit.criteria(items.where(~down), "2024-06-15", broken).withColumn("licence", licence)


@query(f"WITH {AUDIT} SELECT source, days, ordered, useful, median_chars, distinct_titles, walled, n_pdf, reachable, reason FROM audit")
def source_criteria(t: Tables) -> DataFrame:
    """The criteria p0 to p9: a row per source.  The window sends a task's first ten items per source at most."""
    return audited(t).select("source", "days", "ordered", "useful", "median_chars", "distinct_titles", "walled", "n_pdf", "reachable", "reason")


@query(f"WITH {AUDIT} SELECT (regexp_extract(source, '[0-9]+')::INT % 4)::INT AS topic, count(*) FILTER (WHERE reason = 'ACEPTADA') AS accepted, count(*) AS candidates, count(*) FILTER (WHERE reason <> 'ACEPTADA') AS to_review FROM audit GROUP BY 1")
def source_health(t: Tables) -> DataFrame:
    topic = F.pmod(F.regexp_extract("source", "[0-9]+", 0).cast("int"), F.lit(4))
    return audit.health(audited(t).withColumn("topic", topic), "topic")


@query(f"WITH {AUDIT} SELECT why, count(*) AS n FROM (SELECT unnest(string_split(reason, '; ')) AS why FROM audit WHERE reason <> 'ACEPTADA') GROUP BY 1")
def rejection_tally(t: Tables) -> DataFrame:
    return audit.tally(audited(t))


@query(f"""WITH {AUDIT}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE contains(reason, 'sin texto accesible')) AS network, count(*) FILTER (WHERE reason = 'ACEPTADA') AS accepted,
count(*) FILTER (WHERE reason = 'ACEPTADA' AND licence = 'cc') AS accepted_site FROM audit) SELECT *, network >= 0.4 * n OR accepted < 15 * 0.5 OR accepted_site < 12 * 0.5 AS open FROM c""")
def breaker(t: Tables) -> DataFrame:
    return audit.breaker(audited(t), previous=15, previous_site=12)


@query(f"WITH {AUDIT} SELECT topic FROM (SELECT regexp_extract(source, '[0-9]+')::INT % 20 AS topic, reason FROM audit) GROUP BY 1 HAVING count(*) FILTER (WHERE reason = 'ACEPTADA') = 0")
def topics_without_sources(t: Tables) -> DataFrame:
    topic = F.pmod(F.regexp_extract("source", "[0-9]+", 0).cast("int"), F.lit(20))
    return audit.health(audited(t).withColumn("topic", topic), "topic").where("accepted = 0").select("topic")


@query("""WITH b AS (SELECT user_id AS source, (user_id % 3)::INT AS failures FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)), n AS (SELECT user_id AS source, bool_or(event_type = 'error' AND event_id % 2 = 0) AS transient FROM events WHERE user_id % 3 <> 0 GROUP BY 1),
j AS (SELECT source, CASE WHEN transient THEN coalesce(failures, 0) + 1 WHEN transient IS NULL THEN coalesce(failures, 0) ELSE 0 END::INT AS failures FROM b FULL JOIN n USING (source)) SELECT source, failures, failures >= 3 AS down FROM j""")
def failure_counter(t: Tables) -> DataFrame:
    before = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("source"), F.pmod("user_id", F.lit(3)).cast("int").alias("failures")).distinct()
    now = t.events.where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("source")).agg(F.bool_or((F.col("event_type") == "error") & (F.pmod("event_id", F.lit(2)) == 0)).alias("transient"))
    return audit.failures(before, now)


@query(r"""WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT host, count(*) AS mentions FROM h WHERE host NOT LIKE '%.org' GROUP BY 1""")
def candidate_ranking(t: Tables) -> DataFrame:
    """How often each unknown host is mentioned, without blocked ones."""
    h = t.pages.select(urls.host(F.col("url")).alias("host"))
    return h.where(~F.col("host").like("%.org")).groupBy("host").agg(F.count("*").alias("mentions"))


@query(r"""WITH p AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, page_id FROM pages WHERE page_id % 6 >= 4)
SELECT url, host, 0.3::DOUBLE AS weight, FALSE AS active FROM p WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""")
def source_proposals(t: Tables) -> DataFrame:
    candidates = t.pages.select("url", urls.host(F.col("url")).alias("host"), F.pmod("page_id", F.lit(6)).alias("useful"))
    return audit.proposed(t.pages.where("page_id % 5 = 0").select("url"), candidates, ["blocked.example"])


_SOURCES = "s AS (SELECT 'f' || s_suppkey AS url, s_acctbal > 0 AS active, CASE WHEN s_suppkey % 2 = 0 THEN 'cc' END AS licence FROM supplier)"
_CHANGES = """c AS (SELECT 'f' || s_suppkey AS url, CASE WHEN s_suppkey % 7 = 0 THEN 'f' || (s_suppkey - 1) WHEN s_suppkey % 5 = 0 THEN 'g' || s_suppkey END AS new_url, CASE WHEN s_suppkey % 4 = 0 THEN FALSE END AS active,
CASE WHEN s_suppkey % 6 = 0 THEN 'ogl' END AS licence FROM supplier WHERE s_suppkey % 3 <> 0)"""


@query(f"""WITH {_SOURCES}, {_CHANGES}, j AS (SELECT s.*, c.new_url, c.active AS new_active, c.licence AS new_licence, c.new_url IS NOT NULL AND c.new_url IN (SELECT url FROM s) AS blocked FROM s LEFT JOIN c ON c.url = s.url)
SELECT CASE WHEN NOT blocked THEN coalesce(new_url, url) ELSE url END AS url, CASE WHEN blocked THEN FALSE ELSE coalesce(new_active, active) END AS active, coalesce(new_licence, licence) AS licence FROM j""")
def apply_changes(t: Tables) -> DataFrame:
    """Renames, switches and licences of a change set in one pass."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), k.cast("string"))
    sources = t.supplier.select(name.alias("url"), (F.col("s_acctbal") > 0).alias("active"), F.when(k % 2 == 0, "cc").alias("licence"))
    renamed = F.when(k % 7 == 0, F.concat(F.lit("f"), (k - 1).cast("string"))).when(k % 5 == 0, F.concat(F.lit("g"), k.cast("string")))
    changes = t.supplier.where("s_suppkey % 3 <> 0").select(k.alias("seq"), name.alias("url"), renamed.alias("new_url"), F.when(k % 4 == 0, False).alias("active"), F.when(k % 6 == 0, "ogl").alias("licence"))
    return audit.applied(sources, changes)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'template' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def install_plan(t: Tables) -> DataFrame:
    """Adds a template's rows whose key is not there: running it again adds nothing."""
    existing = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    template = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("template").alias("c_mktsegment"))
    once = audit.installed(existing, template, ["c_custkey"])
    return audit.installed(once, template, ["c_custkey"])


# ------------------------------------------------------------------ comparison


@query("""SELECT 'needs a view' AS case_name, 'identico' AS verdict UNION ALL SELECT 'bad preparation', 'errore_preparazione' UNION ALL SELECT 'bad reference', 'errore_riferimento' UNION ALL SELECT 'bad answer', 'errore_sql'""")
def judged_texts(t: Tables) -> DataFrame:
    """The rungs of the verdict ladder that come before results are compared."""
    own = t.spark.newSession()
    for name in ("nation", "region"):
        own.read.parquet(f"{t.folder}/{name}.parquet").createOrReplaceTempView(name)
    good, made = "SELECT n_name FROM few ORDER BY n_name", [("few", "SELECT * FROM nation WHERE n_regionkey = 1")]
    cases = {"needs a view": (good, good, made), "bad preparation": (good, good, [("few", "SELECT * FROM nowhere")]), "bad reference": ("SELECT nothing FROM nation", good, made), "bad answer": (good, "SELEC 1", made)}
    rows = [(name, compare.judged_sql(own, a, b, True, prep)[0].value) for name, (a, b, prep) in cases.items()]
    return t.spark.createDataFrame(rows, "case_name string, verdict string")


@query("SELECT 'empty' AS name, 'no rows' AS problem UNION ALL SELECT 'broken', 'does not run'")
def corpus_validation(t: Tables) -> DataFrame:
    """Reference statements that do not run or give nothing; the good ones are not named."""
    own = t.spark.newSession()
    own.read.parquet(f"{t.folder}/nation.parquet").createOrReplaceTempView("nation")
    statements = {"good": "SELECT n_name FROM nation ORDER BY 1", "empty": "SELECT n_name FROM nation WHERE n_name = ''", "broken": "SELECT nothing FROM nation"}
    found = compare.validated(own, statements)
    rows = [(r.name, r.problem.split(":")[0]) for r in found.collect()]  # a row per statement of an authored list
    return t.spark.createDataFrame(rows, "name string, problem string")


@query("SELECT doc_id, doc_id % 4 IN (0, 1, 2) AS ordered FROM documents")
def order_heuristic(t: Tables) -> DataFrame:
    """Which tasks ask for an order, by their words or a LIMIT that is not within a string."""
    k = F.pmod("doc_id", F.lit(4))
    prompt = F.when(k == 0, "Elenca i nomi in ordine decrescente").when(k == 1, "Le prime 5 strutture").otherwise("Quante visite ci sono?")
    return t.documents.select("doc_id", compare.asks_for_order(prompt, F.when(k == 2, "SELECT 1 Limit 3").otherwise("SELECT 'limit' AS x")).alias("ordered"))


@query("""SELECT * FROM (VALUES ('changed', 'valori_diversi'), ('columns', 'colonne_diverse'), ('fewer', 'righe_diverse'), ('reordered', 'identico_a_meno_dell_ordine'), ('reordered, order asked for', 'ordine_diverso'), ('same', 'identico'), ('text ten, number ten', 'identico')) v(case_name, verdict)""")
def compare_verdicts(t: Tables) -> DataFrame:
    """The verdict ladder on one query and variants of it."""
    base = t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey")
    back = t.nation.select("n_nationkey", "n_name").orderBy(F.desc("n_nationkey"))
    changed = base.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "?").otherwise(F.col("n_name")))
    cases = {
        "same": (base, base.toDF("a", "b"), True),
        "reordered": (base, back, False),
        "reordered, order asked for": (base, back, True),
        "fewer": (base, base.limit(20), False),
        "columns": (base, base.select("n_name"), False),
        "changed": (base, changed, False),
        "text ten, number ten": (base, base.withColumn("n_nationkey", F.col("n_nationkey").cast("string")), True),
    }
    rows = [(name, compare.judged(a, b, ordered).value) for name, (a, b, ordered) in cases.items()]
    return t.spark.createDataFrame(rows, "case_name string, verdict string")


@query("SELECT l_returnflag AS flag, n AS n_expected, n - 1 AS n_got FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def compare_multiset(t: Tables) -> DataFrame:
    """Keys of which two results hold different numbers: here one row of each flag is missing."""
    flags = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber")
    first = flags.groupBy("l_returnflag").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("x")).select("l_returnflag", "x.*")
    fewer = flags.join(F.broadcast(first), ["l_returnflag", "l_orderkey", "l_linenumber"], "left_anti").select("l_returnflag")  # a row per flag
    return compare.multiset_difference(flags.select("l_returnflag"), fewer).select(F.get("key", F.lit(0)).alias("flag"), "n_expected", "n_got")


@query("""WITH a AS (SELECT 'f' || s_suppkey AS url, CASE WHEN s_suppkey % 10 = 0 THEN 'sitemap:' || s_suppkey WHEN s_suppkey % 7 = 0 THEN 'g' || s_suppkey END AS new_url,
CASE s_suppkey % 3 WHEN 0 THEN 'ACEPTADA' WHEN 1 THEN 'TRANSITORIO p9' ELSE 'p3 utiles' END AS reason, CASE WHEN s_suppkey % 4 = 0 THEN 'cc' END AS licence, s_suppkey % 5 <> 0 AS measured FROM supplier),
c AS (SELECT url, new_url, CASE WHEN new_url LIKE 'sitemap:%' THEN 'sitemap' END AS method, CASE WHEN reason NOT LIKE 'TRANSITORIO%' THEN reason = 'ACEPTADA' END AS active, CASE WHEN reason NOT LIKE 'TRANSITORIO%' AND measured THEN coalesce(licence, '') END AS licence FROM a)
SELECT * FROM c WHERE new_url IS NOT NULL OR active IS NOT NULL OR licence IS NOT NULL""")
def change_set(t: Tables) -> DataFrame:
    """The changes that an audit asks for."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    rows = t.supplier.select(
        F.concat(F.lit("f"), key).alias("url"),
        F.when(k % 10 == 0, F.concat(F.lit("sitemap:"), key)).when(k % 7 == 0, F.concat(F.lit("g"), key)).alias("new_url"),
        F.when(k % 3 == 0, audit.ACCEPTED).when(k % 3 == 1, "TRANSITORIO p9").otherwise("p3 utiles").alias("reason"),
        F.when(k % 4 == 0, "cc").alias("licence"),
        (k % 5 != 0).alias("measured"),
    )
    return audit.change_set(rows)


@query("SELECT source, count(*) FILTER (WHERE doc_id % 4 < 2) >= 0.5 * count(*) AS is_podcast FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 10 GROUP BY 1")
def podcast_rule(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    media = F.when(F.pmod("doc_id", F.lit(4)) < 2, " Audio/mpeg").otherwise("text/html")
    return audit.podcasts(t.documents.select("source", F.row_number().over(w).alias("nth"), media.alias("media_type")))


@query("""SELECT 'd' || doc_id AS id, 'answer too short' AS error FROM documents WHERE length(text) < 40 UNION ALL SELECT 'd' || doc_id, 'no source' FROM documents WHERE doc_id % 50 = 7
UNION ALL SELECT 'c' || conv_id, 'fewer than four criteria' FROM conversations GROUP BY conv_id HAVING count(*) < 4 UNION ALL SELECT s_name, 'weight out of range' FROM supplier WHERE s_acctbal / 5000 NOT BETWEEN 0 AND 1""")
def content_validation(t: Tables) -> DataFrame:
    """What is wrong with study content, as (id, error)."""
    cards = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("answer"), F.when(F.pmod("doc_id", F.lit(50)) != 7, F.col("source")).alias("source"), F.lit("p. 1").alias("reference"))
    rubrics = t.conversations.groupBy("conv_id").agg(F.collect_list("turn").alias("criteria")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "criteria")
    sources = t.supplier.select(F.col("s_name").alias("name"), F.lit("rss").alias("method"), (F.col("s_acctbal") / 5000).alias("weight"))
    return audit.content_errors(cards, rubrics, sources)
