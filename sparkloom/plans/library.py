"""Archive records, full texts, codes, exchange rules, page heads, the catalogue of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import codes, dates, html, sqlite, text, vocabulary
from sparkloom.operators import catalogue as c
from sparkloom.operators import titles
from sparkloom.plans.catalogue import items
from sparkloom.plans.registry import query
from sparkloom.sources import archives, readers, scouting
from sparkloom.streaming import projection
from sparkloom.tables import NAMES, Tables

# ------------------------------------------------------------------ archives


def _body(archive: str, d: DataFrame) -> Column:
    """A document's record as that archive would return it."""
    n, title, day = F.col("doc_id").cast("string"), F.concat(F.lit("Paper "), F.col("doc_id").cast("string"), F.lit(" on "), F.col("lang")).alias("title"), F.lit("2024-05-06")
    at = lambda prefix: F.concat(F.lit(prefix), n)
    whole = F.col("text").alias("t")
    records = {
        "arxiv": F.struct(title, at("http://arxiv.example/abs/").alias("id"), at("http://arxiv.example/pdf/").alias("pdf"), F.array("source").alias("authors"), F.concat(day, F.lit("T00:00:00Z")).alias("published"), whole.alias("summary")),
        "doaj": F.struct(day.alias("created_date"), F.struct(title, F.array(F.struct(F.lit("fulltext").alias("type"), F.concat(at("https://j.example/"), F.lit(".pdf")).alias("url"))).alias("link"), whole.alias("abstract")).alias("bibjson")),
        "europepmc": F.struct(n.alias("id"), title, day.alias("firstPublicationDate"), F.concat(F.col("source"), F.lit(" A, "), F.col("source"), F.lit(" B")).alias("authorString"), whole.alias("abstractText")),
        "zenodo": F.struct(F.struct(F.lit("public").alias("record")).alias("access"), F.struct(at("https://z.example/").alias("html")).alias("links"), F.struct(title, day.alias("publication_date")).alias("metadata")),
        "doab": F.struct(title.alias("name"), n.alias("handle"), F.array(F.struct(F.lit("dc.date.issued").alias("key"), day.alias("value"))).alias("metadata")),
        "gutenberg": F.struct(F.col("doc_id").alias("id"), title),
        "standard_ebooks": F.struct(title, at("https://s.example/").alias("url"), F.concat(day, F.lit("T00:00:00Z")).alias("updated")),
    }
    return F.to_json(records[archive])


@query("""WITH d AS (SELECT doc_id, doc_id % 7 AS k, doc_id::VARCHAR AS n, lang, length(substr(coalesce(text, ''), 1, 4000)) AS size FROM documents)
SELECT ['arxiv', 'doaj', 'europepmc', 'zenodo', 'doab', 'gutenberg', 'standard_ebooks'][k + 1] AS source, 'paper ' || n || ' on ' || lang AS key,
CASE k WHEN 0 THEN 'http://arxiv.example/abs/' || n WHEN 1 THEN 'https://j.example/' || n || '.pdf' WHEN 2 THEN 'https://europepmc.org/article/MED/' || n WHEN 3 THEN 'https://z.example/' || n
WHEN 4 THEN 'https://directory.doabooks.org/handle/' || n WHEN 5 THEN 'https://www.gutenberg.org/ebooks/' || n ELSE 'https://s.example/' || n END AS url,
CASE WHEN k = 4 THEN DATE '2024-01-01' WHEN k <> 5 THEN DATE '2024-05-06' END AS day, CASE k WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_authors, CASE WHEN k <= 2 THEN size ELSE 0 END AS n_abstract FROM d""")
def archive_items(t: Tables) -> DataFrame:
    """Documents written as the records of seven archives, each read by its own adapter into one catalogue."""
    frames = []
    for k, archive in enumerate(archives.ADAPTERS):
        d = t.documents.where(F.pmod("doc_id", F.lit(len(archives.ADAPTERS))) == k)
        frames.append(archives.read(d.select(_body(archive, d).alias("body")), archive))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole.select("source", "key", "url", "day", F.size("authors").alias("n_authors"), F.length("abstract").alias("n_abstract"))


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS via, CASE WHEN doc_id % 4 = 0 THEN 'solo scheda' ELSE ['copia aperta', 'prestito digitale', 'vista integrale'][doc_id % 3 + 1] END AS access,
CASE WHEN doc_id % 4 = 0 THEN 'u/a/' ELSE 'u/b/' END || doc_id AS url, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE [5, 3, 4][doc_id % 3 + 1] END AS quality FROM documents""")
def full_text_locator(t: Tables) -> DataFrame:
    """The best access to each title among three answers: one poor, one that may have no address, one about another title."""
    n = F.col("doc_id").cast("string")
    wanted = t.documents.select(F.col("doc_id").alias("key"), F.concat(F.lit("Élan vital "), n).alias("title"))

    def answer(via: str, access: Column, url: Column, title: Column) -> DataFrame:
        return t.documents.select(F.col("doc_id").alias("key"), F.lit(via).alias("via"), access.alias("access"), url.alias("url"), title.alias("title"))

    k = F.pmod("doc_id", F.lit(3))
    some = F.when(k == 0, "copia aperta").when(k == 1, "prestito digitale").otherwise("vista integrale")
    answers = answer("a", F.lit("solo scheda"), F.concat(F.lit("u/a/"), n), F.concat(F.lit("elan vital "), n))
    answers = answers.unionByName(answer("b", some, F.when(F.pmod("doc_id", F.lit(4)) != 0, F.concat(F.lit("u/b/"), n)), F.concat(F.lit("ELAN  Vital "), n)))
    answers = answers.unionByName(answer("c", F.lit("copia aperta"), F.concat(F.lit("u/c/"), n), F.concat(F.lit("another one "), n)))
    return archives.located(wanted, answers).select("key", "via", "access", "url", "quality")


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 2 = 0 AS free, doc_id::VARCHAR AS n FROM documents)
SELECT doc_id AS key, ['unpaywall', 'openalex', 'openlibrary', 'hathitrust', 'doab'][k + 1] AS via, CASE k WHEN 2 THEN CASE WHEN free THEN 'pubblico dominio' ELSE 'prestito digitale' END WHEN 3 THEN CASE WHEN free THEN 'vista integrale' ELSE 'solo scheda' END WHEN 4 THEN 'libro ad accesso aperto' ELSE 'copia aperta' END AS access,
CASE k WHEN 0 THEN CASE WHEN free THEN 'p/' || n END WHEN 1 THEN CASE WHEN free THEN 'o/' || n END WHEN 2 THEN 'https://openlibrary.org/works/' || n WHEN 3 THEN CASE WHEN free THEN 'h/' ELSE 'g/' END || n ELSE 'https://directory.doabooks.org/handle/' || n END AS url FROM d""")
def service_answers(t: Tables) -> DataFrame:
    """Stored answers of five look-up services, read into one table of ways to a text."""
    n, title, free = F.col("doc_id").cast("string"), F.lit("T"), F.pmod("doc_id", F.lit(2)) == 0
    at = lambda prefix: F.concat(F.lit(prefix), n)
    items_ = F.array(F.struct(at("g/").alias("itemURL"), F.lit("Limited").alias("usRightsString")), F.struct(at("h/").alias("itemURL"), F.when(free, "Full view").otherwise("Limited").alias("usRightsString")))
    bodies = {
        "unpaywall": F.struct(title.alias("title"), free.alias("is_oa"), F.struct(at("w/").alias("url"), at("p/").alias("url_for_pdf")).alias("best_oa_location")),
        "openalex": F.struct(title.alias("display_name"), F.struct(free.alias("is_oa"), at("o/").alias("oa_url")).alias("open_access")),
        "openlibrary": F.struct(title.alias("title"), at("/works/").alias("key"), F.when(free, "public").otherwise("borrowable").alias("ebook_access")),
        "hathitrust": F.struct(title.alias("title"), items_.alias("items")),
        "doab": F.struct(title.alias("name"), n.alias("handle")),
    }
    whole = None
    for k, service in enumerate(archives.LOOK_UPS):
        own = t.documents.where(F.pmod("doc_id", F.lit(len(bodies))) == k).select(F.col("doc_id").alias("key"), F.to_json(bodies[service]).alias("body"))
        found = archives.answered(own, service).select("key", "via", "access", "url")
        whole = found if whole is None else whole.unionByName(found)
    return whole


@query("""WITH f AS (SELECT page_id % 5 AS k, page_id % 40 AS h, page_id FROM pages),
m AS (SELECT CASE WHEN k = 0 THEN 'news' WHEN k = 1 THEN 'relief' WHEN k = 2 THEN 'pod' WHEN k = 3 THEN 'code' ELSE 'list' END || h || '.example' AS host, CASE k WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE page_id END AS weight, 'title ' || page_id AS title FROM f)
SELECT host, arg_max(title, (weight, title)) AS title, count(*) AS mentions, sum(weight)::BIGINT AS weight FROM m WHERE host NOT IN ('news0.example', 'pod2.example') GROUP BY 1""")
def scouted_hosts(t: Tables) -> DataFrame:
    """Hosts that five discovery services name, but for those that are known."""
    n, h = F.col("page_id").cast("string"), F.pmod("page_id", F.lit(40)).cast("string")
    title = F.concat(F.lit("Title "), n)
    at = lambda name: F.concat(F.lit(f"https://www.{name}"), h, F.lit(".example/x"))
    rows = {
        "news": F.struct(F.array(F.struct(title.alias("title"), at("news").alias("url"), F.col("page_id").alias("points")), F.struct(title.alias("title"), F.lit(None).cast("string").alias("url"), F.lit(9).cast("long").alias("points"))).alias("hits")),
        "relief": F.struct(F.array(F.struct(F.struct(title.alias("name"), at("relief").alias("homepage")).alias("fields"))).alias("data")),
        "podcasts": F.struct(F.array(F.struct(title.alias("collectionName"), at("pod").alias("feedUrl"), F.col("page_id").alias("trackCount"))).alias("results")),
        "repositories": F.struct(F.array(F.struct(title.alias("full_name"), at("code").alias("homepage"), F.col("page_id").alias("stargazers_count"))).alias("items")),
    }
    page = lambda k: t.pages.where(F.pmod("page_id", F.lit(5)) == k)
    found = scouting.curated(page(4).select(F.concat(F.lit("# List\n[badge](https://badge.example)\n- ["), title, F.lit("]("), at("list"), F.lit(") - good\n* [within](#here)\n")).alias("body")))
    for k, (service, body) in enumerate(rows.items()):
        found = found.unionByName(scouting.candidates(page(k).select(F.to_json(body).alias("body")), service))
    known = t.spark.createDataFrame([("news0.example",), ("pod2.example",)], "host string")
    return scouting.ranked(found, known)


@query("SELECT user_id, event_id FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def owner_rows(t: Tables) -> DataFrame:
    """What one owner may see of a table."""
    first = t.events.agg(F.min("user_id")).first()[0]
    return readers.owned({"events": t.events}, first if first is not None else -1)["events"].select("user_id", "event_id")


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN ts >= make_date(year(ts), 3, 31) - dayofweek(make_date(year(ts), 3, 31))::INT + INTERVAL 1 HOUR
AND ts < make_date(year(ts), 10, 31) - dayofweek(make_date(year(ts), 10, 31))::INT + INTERVAL 1 HOUR THEN 2 ELSE 1 END AS shift FROM events)
SELECT event_id, hour(ts + to_hours(shift)) = 7 AS runs FROM e""")
def run_gate(t: Tables) -> DataFrame:
    """Whether a run that starts at that time of the universal clock is the one meant for seven o'clock in Rome."""
    return t.events.select("event_id", dates.is_hour(F.col("ts").cast("timestamp"), "Europe/Rome", 7).alias("runs"))


@query("SELECT page_id AS key, '/files/annual-report-' || page_id || '.pdf' AS url, CASE WHEN page_id >= 1000 THEN 3 ELSE 2 END AS hits FROM pages")
def pdf_link_finder(t: Tables) -> DataFrame:
    """The link that is the document itself, among a file of the same host name and a page of the same name."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit('<a href="https://annual-report.example/x.pdf">x</a> <a class=b href=\'/files/annual-report-'), n, F.lit(".pdf'>get it</a> <a href=/annual-report.html>page</a>"))
    pages = t.pages.select(F.col("page_id").alias("key"), F.concat(F.lit("Annual report "), n).alias("title"), "url", F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))
    return archives.pdf_links(pages)


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'Data + Society' WHEN 2 THEN 'Skeptic [Audio]' WHEN 3 THEN source WHEN 4 THEN 'Europe PMC' ELSE '' END AS name FROM documents""")
def source_names(t: Tables) -> DataFrame:
    k = F.pmod("doc_id", F.lit(6))
    written = F.when(k == 0, "arxiv[health]+doaj").when(k == 1, "rss[Data + Society]+crossref").when(k == 2, " rss[Skeptic [Audio]]").when(k == 3, F.concat("source", F.lit("+arxiv"))).when(k == 4, "europepmc")
    return t.documents.select("doc_id", text.source_name(written).alias("name"))


# ------------------------------------------------------------------ codes, clocks, exchange


@query(f"""WITH d AS (SELECT doc_id, list_transform(range(8), lambda i: (doc_id >> (35 - 5 * i)::INT) & 31) AS x FROM documents)
SELECT doc_id, list_aggregate(list_transform(x, lambda v: substr('{codes.ALPHABET}', (v + 1)::INT, 1)), 'string_agg', '') || substr('{codes.ALPHABET}', ((list_sum(x) + 8) % 32 + 1)::INT, 1) AS code, doc_id AS read_back FROM d""")
def base32_codes(t: Tables) -> DataFrame:
    """Ids of five bytes as codes with a check digit, and read back from how people type them."""
    d = t.documents.select("doc_id", codes.code(F.unhex(F.lpad(F.hex("doc_id"), 10, "0"))).alias("code"))
    typed = F.lower(F.regexp_replace("code", "^(...)", "$1-"))
    return d.select("doc_id", "code", F.conv(F.hex(codes.bytes_of(typed)), 16, 10).cast("long").alias("read_back"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, '' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1)
SELECT user_id, n || ':' || printf('%x', list_reduce(list_prepend(0::BIGINT, list_transform(string_split(ids, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (31 * h + x) % 4294967296)) AS fingerprint FROM s""")
def ordered_fingerprints(t: Tables) -> DataFrame:
    """A digest of each user's event ids that depends on their order, put together from days."""
    rows = t.events.select("user_id", "ts", "event_id", F.col("event_id").cast("string").alias("id"))
    return codes.ordered_fingerprints(rows, ["user_id"], ["ts", "event_id"], F.to_date("ts"))


@query("""WITH e AS (SELECT event_id, 1700000000000 + event_id AS server, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1700000000000 + event_id - 900000 WHEN 2 THEN 1700000000000 + event_id - 5 ELSE 1700000000000 + event_id + 1001 END AS arrived, event_id % 5 = 0 AS finished FROM events)
SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 0 ELSE least(30.0, power(2.0, event_id % 8 - 1)) END::DOUBLE AS backoff, CASE WHEN (event_id % 3) * (event_id % 40) = 0 AND event_id % 11 <> 0 AND event_id % 300 < 60 THEN 'allineati' WHEN event_id % 11 = 0 OR (event_id % 3) * (event_id % 40) >= 25 OR event_id % 300 >= 240 THEN 'marcata' ELSE 'leggera' END AS level,
CASE WHEN arrived > server + 1000 THEN event_id WHEN finished OR arrived IS NULL THEN server - 600000 ELSE least(arrived, server - 600000) END AS next FROM e""")
def exchange_rules(t: Tables) -> DataFrame:
    """After an exchange: minutes to wait, how far the logs are apart, where to read on."""
    n, k, k3 = F.col("event_id"), F.pmod("event_id", F.lit(4)), F.pmod("event_id", F.lit(3))
    server = F.lit(1_700_000_000_000) + n
    arrived = F.when(k == 1, server - 900_000).when(k == 2, server - 5).when(k == 3, server + 1001)
    return t.events.select("event_id", projection.backoff_minutes(F.pmod(n, F.lit(8))).alias("backoff"), projection.divergence(k3 * F.pmod(n, F.lit(40)), F.when(F.pmod(n, F.lit(11)) != 0, F.pmod(n, F.lit(300)))).alias("level"), projection.next_cursor(server, arrived, F.pmod(n, F.lit(5)) == 0, n).alias("next"))


@query()
def title_similarity(t: Tables) -> DataFrame:
    """Matching-block ratio of each title and the same without its first word (no SQL says it; tests know values)."""
    i = items(t).select("idx", "title", F.regexp_replace("title", r"^\S+\s*", "").alias("rest"))
    return i.select("idx", F.round(text.similarity("title", "rest"), 6).alias("ratio"))


@query()
def similar_titles(t: Tables) -> DataFrame:
    """Classes of titles (the smallest idx of equal ones) whose ratio of matching blocks is 0.95 or more; no SQL says it, a
    test compares all pairs."""
    found = titles.similar(titles.classes(items(t).select(F.col("idx").alias("id"), "title")))
    return found.select(F.col("first").alias("idx"), F.col("second").alias("like"), F.round("ratio", 6).alias("ratio"))


@query("""WITH e AS (SELECT event_id, event_id % 41 AS pending, CASE WHEN event_id % 9 <> 0 THEN (event_id * 7919) % 2000000 END AS since, CASE WHEN event_id % 5 = 0 THEN event_id % 7 ELSE 0 END AS failures, event_id % 6 = 0 AS low, event_id % 10 <> 0 AS able FROM events)
SELECT event_id, CASE WHEN NOT able OR low AND pending < 25 OR failures > 0 AND since < least(30, power(2, failures - 1)) * 60000 THEN NULL WHEN since IS NULL THEN 'urgent' WHEN since < 90000 THEN NULL WHEN pending >= 25 THEN 'urgent' WHEN since >= 900000 THEN 'normal' END AS exchange FROM e""")
def exchange_policy(t: Tables) -> DataFrame:
    """When two devices exchange their logs."""
    n = F.col("event_id")
    mod = lambda k: F.pmod(n, F.lit(k))
    since = F.when(mod(9) != 0, F.pmod(n * 7919, F.lit(2_000_000)))
    decision = projection.exchange(mod(41), since, F.when(mod(5) == 0, mod(7)).otherwise(0), mod(6) == 0, mod(10) != 0)
    return t.events.select("event_id", decision.alias("exchange"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE epoch_ms(date_trunc('second', ts)) + CASE WHEN event_id % 5 = 1 THEN 120 ELSE 0 END END AS ms FROM events")
def server_times(t: Tables) -> DataFrame:
    """Times as servers write them, in milliseconds: HTTP dates, instants with fractions and zones."""
    at, k = F.col("ts").cast("timestamp"), F.pmod("event_id", F.lit(5))
    written = (
        F.when(k == 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".12Z")))
        .when(k == 2, F.date_format(at + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'+01:30'"))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss'+00'"))
        .otherwise(F.lit("a while ago"))
    )
    return t.events.select("event_id", dates.instant_ms(written).alias("ms"))


# ------------------------------------------------------------------ pages


@query("SELECT page_id, sha256(coalesce(html, '')) AS sha256 FROM pages")
def decoded_pages(t: Tables) -> DataFrame:
    """Pages stored in three encodings, told apart by their marks, decoded."""
    k, body = F.pmod("page_id", F.lit(3)), F.coalesce("html", F.lit(""))
    stored = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "UTF-8"))).when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(body, "UTF-16BE"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode(body, "UTF-16LE")))
    return t.pages.select("page_id", F.sha2(html.decoded_text(stored).cast("binary"), 256).alias("sha256"))


@query("SELECT page_id, 'https://host.example/c/' || page_id AS canonical, 'https://social.example/@u' || page_id || ' https://host.example/me' AS profiles FROM pages")
def page_declarations(t: Tables) -> DataFrame:
    """What a page's head says of itself: its own address, its owner's profiles."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit("<head><link href='/c/"), n, F.lit("' rel='canonical'><a class=\"x\" rel=\"nofollow me\" href=\"https://social.example/@u"), n, F.lit("\">me</a><link rel='me' href='../me'></head>"))
    url = F.lit("https://host.example/a/b")
    return t.pages.select("page_id", html.canonical(head, url).alias("canonical"), F.array_join(html.profiles(head, url), " ").alias("profiles"))


@query("""SELECT 'src' || k AS source, is_map, loc, lastmod, day FROM (SELECT page_id % 5 AS k, FALSE AS is_map, 'https://www.host' || page_id % 5 || '.example/2024/03/p' || page_id AS loc, CASE WHEN page_id % 2 = 0 THEN '2024-04-01' ELSE '' END AS lastmod, '2024-03-01' AS day FROM pages WHERE page_id % 7 <> 0
UNION ALL SELECT DISTINCT page_id % 5, TRUE, 'https://www.host' || page_id % 5 || '.example/post-sitemap.xml', '', '' FROM pages)""")
def sitemap_addresses(t: Tables) -> DataFrame:
    """Addresses and sub-maps of one sitemap per source; those of other sites and of taxonomies go."""
    k, n = F.pmod("page_id", F.lit(5)).cast("string"), F.col("page_id").cast("string")
    site = F.concat(F.lit("https://host"), k, F.lit(".example"))
    own = F.concat(F.lit("https://www.host"), k, F.lit(".example/2024/03/p"), n)
    loc = F.when(F.pmod("page_id", F.lit(7)) == 0, F.concat(F.lit("https://other.example/2024/03/"), n)).otherwise(own)
    row = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), F.when(F.pmod("page_id", F.lit(2)) == 0, "<lastmod>2024-04-01</lastmod>").otherwise(""), F.lit("</url>"))
    maps = t.pages.select(F.concat(F.lit("src"), k).alias("source"), site.alias("site"), row.alias("row"), F.floor(F.col("page_id") / 10_000).alias("file"))
    bodies = maps.groupBy("source", "site", "file").agg(F.array_join(F.collect_list("row"), "").alias("rows"))
    index = F.concat(F.lit("<sitemap><loc>https://www.host"), F.substring("source", 4, 1), F.lit(".example/post-sitemap.xml</loc></sitemap><sitemap><loc>https://x.example/tag-sitemap.xml</loc></sitemap>"))
    return readers.sitemaps(bodies.select("source", "site", F.concat(F.lit("<urlset>"), "rows", index, F.lit("</urlset>")).alias("body"))).distinct()


@query("SELECT doc_id, 'A first line of the office at work' || chr(10) || chr(10) || 'number ' || doc_id AS text FROM documents")
def printed_pages(t: Tables) -> DataFrame:
    """Paragraphs of a printed page: ligatures, a hyphen at a line's end, lines put together."""
    page = F.concat(F.lit("A \ufb01rst line of\nthe of-\n\ufb01ce at\nwork\n \n"), F.lit("num\xadber "), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", html.page_paragraphs(page).alias("text"))


# ------------------------------------------------------------------ a vocabulary in its real size

TERMS = 800
_WORDS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_BOTH = "list_distinct(list_concat({0}, list_transform(range(1, greatest(len({0}), 1)), lambda i: {0}[i] || ' ' || {0}[i + 1])))"


def wide_vocabulary(t: Tables) -> DataFrame:
    """(topic, term, strong): words and word pairs of the benchmark's items, the first ``TERMS`` by name, dealt out to 22 topics."""
    words = t.benchmark.select(F.filter(F.split(text.folded(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    terms = words.select(F.explode(F.concat("w", pairs)).alias("term")).where("length(term) >= 4").distinct().orderBy(F.md5("term"), "term").limit(TERMS)
    topic = F.concat(F.lit("t"), F.pmod(F.length("term") * 7, F.lit(22)).cast("string"))
    return terms.select(topic.alias("topic"), "term", (F.pmod(F.length("term"), F.lit(2)) == 0).alias("strong"))


@query(f"""WITH b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark), v AS (SELECT DISTINCT unnest({_BOTH.format("w")}) AS term FROM b),
terms AS (SELECT 't' || (length(term) * 7) % 22 AS topic, term, length(term) % 2 = 0 AS strong FROM v WHERE length(term) >= 4 ORDER BY md5(term), term LIMIT {TERMS}),
raw AS (SELECT doc_id AS idx, string_split(text, chr(10))[1] AS title, text FROM documents), s AS (SELECT idx, {_WORDS.format("title")} AS tw, {_WORDS.format("substr(text, length(title) + 2, 4000)")} AS aw FROM raw),
hits AS (SELECT idx, unnest({_BOTH.format("tw")}) AS term, 1.5::DOUBLE AS f FROM s UNION ALL SELECT idx, unnest({_BOTH.format("aw")}), 1.0 FROM s),
best AS (SELECT idx, topic, term, strong, max(f) AS f FROM hits JOIN terms USING (term) GROUP BY ALL)
SELECT idx, topic, round(sum(CASE WHEN strong THEN f ELSE 0.4 * f END), 3)::DOUBLE AS score, round(coalesce(sum(f) FILTER (WHERE strong), 0), 3)::DOUBLE AS strong FROM best GROUP BY 1, 2""")
def topic_scores_wide(t: Tables) -> DataFrame:
    """Topic scores by a vocabulary of 800 words and word pairs."""
    return c.topic_scores(items(t), wide_vocabulary(t), [])


_RUNS = "list_distinct(flatten(list_transform(range(1, 7), lambda n: list_transform(range(1, greatest(len({0}) - n + 2, 1)), lambda i: array_to_string({0}[i:i + n - 1], ' ')))))"


def long_vocabulary(t: Tables) -> DataFrame:
    """(topic, term, strong): runs of one to six words of the benchmark's items and of some documents' first words, a third of them by name."""
    runs = t.benchmark.select(F.explode(vocabulary.runs(F.coalesce("text", F.lit("")), range(1, 7))).alias("term"))
    heads = t.documents.where("doc_id % 13 = 0").select(F.explode(vocabulary.runs(F.substring(F.coalesce("text", F.lit("")), 1, 200), range(1, 7))).alias("term"))
    terms = runs.union(heads).distinct().where("conv(substr(md5(term), 1, 4), 16, 10) % 3 = 0")
    return terms.select(F.concat(F.lit("t"), F.pmod(F.length("term") * 7, F.lit(22)).cast("string")).alias("topic"), "term", (F.pmod(F.length("term"), F.lit(2)) == 0).alias("strong"))


@query(f"""WITH b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark UNION ALL SELECT {_WORDS.format("substr(text, 1, 200)")} FROM documents WHERE doc_id % 13 = 0),
v AS (SELECT DISTINCT unnest({_RUNS.format("w")}) AS term FROM b),
terms AS (SELECT 't' || (length(term) * 7) % 22 AS topic, term, length(term) % 2 = 0 AS strong FROM v WHERE ('0x' || substr(md5(term), 1, 4))::BIGINT % 3 = 0),
raw AS (SELECT doc_id AS idx, string_split(text, chr(10))[1] AS title, text FROM documents), s AS (SELECT idx, {_WORDS.format("title")} AS tw, {_WORDS.format("substr(text, length(title) + 2)")} AS aw FROM raw),
hits AS (SELECT idx, unnest({_RUNS.format("tw")}) AS term, 1.5::DOUBLE AS f FROM s UNION ALL SELECT idx, unnest({_RUNS.format("aw")}), 1.0 FROM s),
best AS (SELECT idx, topic, term, strong, max(f) AS f FROM hits JOIN terms USING (term) GROUP BY ALL)
SELECT idx, topic, round(sum(CASE WHEN strong THEN f ELSE 0.4 * f END), 3)::DOUBLE AS score, round(coalesce(sum(f) FILTER (WHERE strong), 0), 3)::DOUBLE AS strong FROM best GROUP BY 1, 2""")
def topic_scores_long(t: Tables) -> DataFrame:
    """Topic scores of whole texts by terms of one to six words, those within others included."""
    return c.topic_scores(items(t, None), long_vocabulary(t), [])


# ------------------------------------------------------------------ the catalogue of tables


def _own_session(t: Tables):
    own = t.spark.newSession()
    for name in NAMES:
        own.read.parquet(f"{t.folder}/{name}.parquet").createOrReplaceTempView(name)
    return own


@query(f"SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ({', '.join(repr(n) for n in NAMES)})")
def catalog_tables(t: Tables) -> DataFrame:
    """The tables that there are, as SQLite's own table of them has it."""
    rows = sqlite.query(_own_session(t), "SELECT name FROM sqlite_master WHERE type = 'table'").collect()  # a row per table
    return t.spark.createDataFrame([(r.name,) for r in rows if r.name in NAMES], "name string")


@query(f"SELECT table_name, (ordinal_position - 1)::INT AS cid, column_name AS name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in NAMES)})")
def table_columns(t: Tables) -> DataFrame:
    """Each table's columns in order, by PRAGMA table_info."""
    own = _own_session(t)
    rows = [(name, r.cid, r.name) for name in NAMES for r in sqlite.query(own, f"PRAGMA table_info({name})").collect()]  # a row per column
    return t.spark.createDataFrame(rows, "table_name string, cid int, name string")


@query("""SELECT * FROM (VALUES ('anti join', 'join', TRUE), ('constant folded', 'filter left', FALSE), ('count distinct', 'two aggregates', TRUE), ('equality', 'pushed', TRUE), ('function of the column', 'pushed', FALSE),
('join and group', 'join', TRUE), ('left join and group', 'outer join', TRUE), ('order and limit', 'top k without a sort', TRUE), ('prefix', 'pushed', TRUE), ('range', 'pushed', TRUE), ('range for a function', 'pushed', TRUE), ('scalar subquery', 'subquery', TRUE), ('two conditions', 'both pushed', TRUE)) v(case_name, shape, holds)""")
def explained_shapes(t: Tables) -> DataFrame:
    """What the plans of thirteen statements have, read from EXPLAIN QUERY PLAN."""
    own = _own_session(t)
    cases = {
        "equality": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7", "pushed", lambda p: "EqualTo(o_custkey,7)" in p),
        "range": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 500 AND o_totalprice < 900", "pushed", lambda p: "LessThan(o_totalprice" in p),
        "two conditions": ("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'", "both pushed", lambda p: "EqualTo(o_custkey,7)" in p and "EqualTo(o_orderstatus,F)" in p),
        "function of the column": ("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996", "pushed", lambda p: "EqualTo(o_orderdate" in p or "LessThan(o_orderdate" in p),
        "range for a function": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'", "pushed", lambda p: "LessThan(o_orderdate" in p),
        "prefix": ("SELECT p_partkey FROM part WHERE startswith(p_type, 'STANDARD')", "pushed", lambda p: "StringStartsWith(p_type,STANDARD)" in p),
        "count distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) FROM orders GROUP BY 1", "two aggregates", lambda p: p.count("HashAggregate") >= 3),
        "join and group": ("SELECT c_mktsegment, count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", "join", lambda p: "Join" in p),
        "left join and group": ("SELECT c_custkey, count(o_orderkey) FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", "outer join", lambda p: "LeftOuter" in p or "RightOuter" in p),
        "anti join": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "join", lambda p: "LeftAnti" in p),
        "scalar subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", "subquery", lambda p: "ubquery" in p),
        "order and limit": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", "top k without a sort", lambda p: "TakeOrderedAndProject" in p),
        "constant folded": ("SELECT o_orderkey FROM orders WHERE 1 = 1", "filter left", lambda p: "\nFilter" in f"\n{p}"),
    }
    rows = []
    for name, (sql, shape, test) in cases.items():
        plan = "\n".join(r.detail for r in sqlite.query(own, f"EXPLAIN QUERY PLAN {sql}").collect())  # a row per step
        rows.append((name, shape, bool(test(plan))))
    return t.spark.createDataFrame(rows, "case_name string, shape string, holds boolean")
