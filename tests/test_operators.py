"""Operators on small hand-made frames: the change log, comparison, classification, study, audit."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import dates, hlc, html, text, urls, vocabulary
from sparkloom.operators import audit, catalogue, compare, eventlog, ordering, study
from sparkloom.sources import readers, sinks
from sparkloom.streaming import projection

LOG = "id string, hlc string, device string, entity string, entity_id string, kind string, payload string"


def event(n, entity, kind, payload, device="a"):
    clock = f"{n:012x}-0000-{device}"
    return (f"{clock}:{entity}", clock, device, "note", entity, kind, payload)


EVENTS = [
    event(1, "x", "crea", '{"title": "one", "body": "b"}'),
    event(2, "x", "aggiorna", '{"title": "two"}', "b"),
    event(3, "x", "elimina", "{}"),
    event(4, "x", "aggiorna", '{"title": "three", "tag": null}', "b"),
    event(5, "y", "crea", "{}"),
    event(6, "z", "crea", "not json"),
    event(7, "w", "crea", '{"n": true, "deep": {"a": [1]}}'),
    event(8, "w", "elimina", "{}", "b"),
    event(9, "v", "crea", '{"n": true, "title": "v", "extra": 1}'),
    event(10, "v", "aggiorna", "null"),
    event(11, "v", "aggiorna", "[1, 2]"),
]


def states(df):
    return {r.entity_id: r.fields for r in df.collect()}


def test_projection_folds_deletes_and_revivals(spark):
    got = states(eventlog.projected(spark.createDataFrame(EVENTS, LOG)))
    assert got == {"x": {"title": "three", "tag": None}, "y": {}, "v": {"n": "true", "title": "v", "extra": "1"}}


def test_projection_ignores_input_order_and_repeats(spark):
    base = states(eventlog.projected(spark.createDataFrame(EVENTS, LOG)))
    for seed in range(3):
        shuffled = EVENTS * 2
        random.Random(seed).shuffle(shuffled)
        assert states(eventlog.projected(spark.createDataFrame(shuffled, LOG))) == base


def test_merge_commutes(spark):
    a, b = (spark.createDataFrame(EVENTS[s], LOG) for s in (slice(0, 7), slice(4, None)))
    one = a.unionByName(eventlog.merge_new(a, b))
    two = b.unionByName(eventlog.merge_new(b, a))
    assert eventlog.fingerprint(one).first() == eventlog.fingerprint(two).first()
    assert states(eventlog.projected(one)) == states(eventlog.projected(two))
    assert eventlog.merge_counts(a, b).first().asDict() == {"n_received": 7, "n_new": 4, "n_duplicate": 3}


def test_conflicts_name_winner_and_loser(spark):
    got = {(r.entity_id, r.field, r.winner, r.loser) for r in eventlog.conflicts(spark.createDataFrame(EVENTS, LOG)).collect()}
    assert got == {("x", "title", "b", "a")}


def test_materialise_types_and_incomplete(spark):
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("title", T.StringType())])
    whole, lacking = eventlog.materialised(eventlog.projected(spark.createDataFrame(EVENTS, LOG)), schema, ["title"])
    assert [(r.entity_id, r.n, r.title) for r in whole.orderBy("entity_id").collect()] == [("v", 1, "v"), ("x", None, "three")]
    assert [r.entity_id for r in lacking.collect()] == ["y"]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert eventlog.projected(empty).count() == 0 and eventlog.conflicts(empty).count() == 0
    assert eventlog.fingerprint(empty).first().n == 0


def test_stream_batches_equal_one_batch(spark, tmp_path):
    folder = str(tmp_path)
    for n, part in enumerate([EVENTS[6:], EVENTS[:4], EVENTS[2:8]]):
        projection.absorb(spark.createDataFrame(part, LOG), n, folder)
    projection.absorb(spark.createDataFrame(EVENTS[2:8], LOG), 2, folder)  # run again after a failure
    assert states(projection.state(spark, folder, 2)) == states(eventlog.projected(spark.createDataFrame(EVENTS, LOG)))


def test_cursor_rules(spark):
    cases = [(10_000_000, None, True, 5, 9_400_000), (10_000_000, 9_000_000, False, 5, 9_000_000), (10_000_000, 9_999_999, False, 5, 9_400_000), (0, 1, True, 5, 5), (1_000, 10_000, True, 5, 5), (None, 1, True, None, None)]
    df = spark.createDataFrame(cases, "server long, last long, finished boolean, old long, expected long")
    got = df.select(projection.next_cursor(F.col("server"), F.col("last"), F.col("finished"), F.col("old")).alias("n"), "expected").collect()
    assert all(r.n == r.expected for r in got)


def test_clock():
    c = hlc.Clock("a")
    assert c.tick(100) == f"{100:012x}-0000-a" and c.tick(100) == f"{100:012x}-0001-a" and c.tick(50) == f"{100:012x}-0002-a"
    assert c.absorb(f"{500:012x}-0007-b", 120) == f"{500:012x}-0008-a" and c.drift == 380
    c.counter = 0xFFFF
    assert c.tick(10) == f"{501:012x}-0000-a"
    assert c.absorb(f"{400:012x}-0001-b", 900) == f"{900:012x}-0000-a"
    assert c.absorb("not a clock", 5000) == c.absorb("", 5000) == f"{900:012x}-0000-a"


def test_clock_parsing(spark):
    df = spark.createDataFrame([("0000000003e8-000a-dev",), ("junk",), (None,)], "h string")
    got = [r.p and tuple(r.p) for r in df.select(hlc.parsed(F.col("h")).alias("p")).collect()]
    assert got == [(1000, 10, "dev"), None, None]


@pytest.mark.parametrize(
    "answer, ordered, verdict",
    [
        ("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL ORDER BY 1", True, compare.Verdict.SAME),
        ("SELECT 1.0D AS z, 'x' AS y UNION ALL SELECT 2, NULL ORDER BY 1", True, compare.Verdict.SAME),
        ("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL ORDER BY 1 DESC", True, compare.Verdict.ORDER),
        ("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL ORDER BY 1 DESC", False, compare.Verdict.SAME_BUT_ORDER),
        ("SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, '' ORDER BY 1", True, compare.Verdict.VALUES),
        ("SELECT 1 AS a, 'x' AS b", True, compare.Verdict.ROWS),
        ("SELECT 1 AS a UNION ALL SELECT 2", True, compare.Verdict.COLUMNS),
        ("SELECT nothing FROM nowhere", True, compare.Verdict.ERROR),
    ],
)
def test_verdicts(spark, answer, ordered, verdict):
    assert compare.judged_sql(spark, "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, NULL ORDER BY 1", answer, ordered)[0] == verdict


def test_verdict_on_floats_and_separators(spark):
    assert compare.judged(spark.sql("SELECT 0.1D + 0.2D AS x"), spark.sql("SELECT 0.3D AS x")) == compare.Verdict.SAME
    assert compare.judged(spark.sql("SELECT 'a\u001fb' AS x, 'c' AS y"), spark.sql("SELECT 'a' AS x, 'b\u001fc' AS y")) == compare.Verdict.VALUES


ITEM = "idx long, key string, title string, abstract string, concepts array<string>, source string, day date, has_pdf boolean, is_book boolean"


def item(idx, key="k", title="t", abstract="", concepts=(), source="s", pdf=False):
    return (idx, key, title, abstract, list(concepts), source, datetime.date(2024, 5, 1), pdf, False)


def test_topic_scores(spark):
    items = spark.createDataFrame([item(1, title="With care", abstract="with the press"), item(2, title="", abstract="", concepts=["fr"]), item(3, title="withheld", abstract=None)], ITEM)
    got = {(r.idx, r.topic): (r.score, r.strong) for r in catalogue.topic_scores(items, catalogue.vocabulary(spark)).collect()}
    assert got == {(1, "english"): (1.9, 1.5), (2, "french"): (1.2, 1.2)}


def test_terms_of_two_words(spark):
    words = catalogue.vocabulary(spark, [("health", "public health", "strong")])
    items = spark.createDataFrame([item(1, title="Public Health now"), item(2, title="public", abstract="health"), item(3, title="x", abstract="on public health")], ITEM)
    assert {(r.idx, r.score) for r in catalogue.topic_scores(items, words, []).collect()} == {(1, 1.5), (3, 1.0)}


@pytest.mark.parametrize("most", [100, 2])
def test_terms_of_any_length(spark, most):
    rows = [("a", "digital health intervention", "strong"), ("b", "digital health", "strong"), ("c", "health", "weak"), ("d", "health intervention in rural areas today", "strong"), ("e", "post-mortem", "strong"), ("f", "x x", "strong"), ("g", "--", "strong"), ("b", "HEALTH", "weak")]
    items = spark.createDataFrame([item(1, title="A Digital  Health: intervention", abstract="in rural areas"), item(2, title="Post mortem", abstract="digital health intervention in rural areas today"), item(3, title="x x x", abstract=None), item(4, title=None, abstract="digital. Health"), item(5, title="digital", abstract="intervention")], ITEM)
    got = {(r.idx, r.topic): (r.score, r.strong) for r in catalogue.topic_scores(items, catalogue.vocabulary(spark, rows), [], most).collect()}
    assert got == {(1, "a"): (1.5, 1.5), (1, "b"): (2.1, 1.5), (1, "c"): (0.6, 0.0), (2, "a"): (1.0, 1.0), (2, "b"): (1.4, 1.0), (2, "c"): (0.4, 0.0), (2, "d"): (1.0, 1.0), (2, "e"): (1.5, 1.5), (3, "f"): (1.5, 1.5), (4, "b"): (1.4, 1.0), (4, "c"): (0.4, 0.0)}


def test_automaton_finds_what_every_place_shows():
    draw = random.Random(8)
    terms = sorted({tuple(draw.choice("abc") for _ in range(draw.randrange(1, 7))) for _ in range(60)})
    automaton = vocabulary.Automaton(terms)
    for n in range(0, 60, 3):
        words = [draw.choice("abcd") for _ in range(n)]
        assert automaton.found(words) == {k for k, t in enumerate(terms) if any(tuple(words[i : i + len(t)]) == t for i in range(n))}


def test_best_copy_and_sources(spark):
    items = spark.createDataFrame([item(1, abstract="long text", source="a"), item(2, abstract="x", pdf=True, source="b"), item(3, abstract="y", pdf=True, source="c"), item(4, key="other", source="d")], ITEM)
    got = {r.key: (r.idx, r.sources, r.n_dropped) for r in catalogue.best_copies(items).collect()}
    assert got == {"k": (2, "b+a+c", 2), "other": (4, "d", 0)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Crème, brûlée! 12",), ("",), (None,)], "t string")
    got = df.select(text.folded(F.col("t")).alias("f"), text.title_key(F.col("t")).alias("k"), text.normalised("t").alias("n"), text.has_word(F.col("t"), "ia").alias("w")).collect()
    assert tuple(got[0]) == ("creme, brulee! 12", "cr me br l e 12", "creme, brulee! 12", False)
    assert got[1].k == "" and got[2].k is None
    words = spark.createDataFrame([("xøia",), ("la ia.",), ("IA",)], "t string").select(text.has_word(F.lower("t"), "ia").alias("w")).collect()
    assert [r.w for r in words] == [False, True, True]


def test_dates(spark):
    forms = ["Tue, 02 Jan 2024 23:30:00 -0500", "2 Jan 2024 10:00 GMT", "2024-01-02T10:00:00+02:00", "2024-01", "2024", "2024-13-01", "", None]
    got = [str(r.d) for r in spark.createDataFrame([(f,) for f in forms], "t string").select(dates.feed_date(F.col("t")).alias("d")).collect()]
    assert got == ["2024-01-03", "2024-01-02", "2024-01-02", "2024-01-01", "2024-01-01", "None", "None", "None"]


def test_urls(spark):
    df = spark.createDataFrame([("https://www.a.b.example.com:80/x?y",), ("http://u@blog.site.co.uk/",), ("nothing",)], "u string")
    got = [tuple(r) for r in df.select(urls.host(F.col("u")), urls.site(F.col("u"))).collect()]
    assert got == [("a.b.example.com", "example.com"), ("blog.site.co.uk", "site.co.uk"), (None, None)]


@pytest.mark.parametrize(
    "page, text",
    [
        # a page's own article, whatever else is longer
        ("<body><div>" + "menu " * 90 + "</div><article><h2>Title <b>bold</b></h2><p>First<p>Second</article></body>", "# Title bold\n\nFirst\n\nSecond"),
        ("<article> <nav>only links</nav> </article><main>the main part</main>", "the main part"),  # an empty article does not count
        ("<article>one</article><article>two two two</article>", "one"),
        # the fullest div, the deeper of two with the same text
        (f"<div>{'a ' * 150}</div><div><div id=x>{'b ' * 160}</div></div>", ("b " * 160).strip()),
        (f"<body>lead<div>{'c ' * 90}</div></body>", "lead\n\n" + ("c " * 90).strip()),  # too short a div: the body
        # what is no text
        ("<body>a<script>if (1 < 2) x</script><form>f<p>g</form>b<svg><p>s</svg><footer>z</footer></body>", "ab"),
        ("<body><nav>never closed<p>gone</body>", ""),
        ("<nav>x<div>y</nav>z</div>", "z"),
        # blocks, breaks and headings
        ("<ul><li>one<li>two</ul>x<br>y<hr>z", "one\n\ntwo\n\nx\n\ny\n\nz"),
        ("t<h1>\n</h1>u<h3>a<br>b</h3>v", "t\n\nu\n\n# a b\n\nv"),
        ("a &amp; b&nbsp;c &#" + "9" * 9000 + ";", "a & b c \ufffd"),
        ("", ""),
        (None, ""),
        ("</p></div>stray", "stray"),
    ],
)
def test_html_text_of_known_pages(page, text):
    assert html.text_of(page) == text


def test_html_text_of_deep_pages():
    deep = html.MOST_DEPTH + 300
    assert html.text_of("<div>" * deep + "deep" + "</div>" * deep + "<p>after") == "deep\n\nafter"
    assert html.text_of("<b>" * deep + "<script>x</script>") == "x"  # beyond the levels that are kept apart


def test_transcripts_by_place():
    srt = "1\n00:00:01,000 --> 00:00:02,000\n42\n2\n00:00:02,000 --> 00:00:03,000\nNOTE this down\n\n3\n00:00:03,000 --> 00:00:04,000\nNOTE this down\n1999"
    assert html.prose_of(srt) == "42 NOTE this down 1999"
    vtt = "\ufeffWEBVTT - a talk\nKind: captions\n\nNOTE\nby hand\n\nSTYLE\n::cue {}\n\nintro\n00:00.000 --> 00:01.000 align:start\n<v Ann>Hello &amp; <c>welcome</c>\n\n00:01.000 --> 00:02.000\nHello & welcome\nto you"
    assert html.prose_of(vtt.replace("\n", "\r\n")) == "Hello & welcome to you"
    assert html.prose_of('[{"body": "a"}, {"body": "a"}, {"text": "b"}, 3]') == "a b"
    assert html.prose_of("[1] not JSON") == "[1] not JSON" and html.prose_of('{"x": 1}') == ""


def test_paragraphs_of_printed_pages():
    page = "The \ufb01rst line of this page is long and goes\non over the next one, which is as long, and\nends here.\nAnother paragraph starts on the next line of\nthe page and has a hyphen-\nated word, and \ufb05yle.\n\n\nLast\x07 one"
    assert html.paragraphs_of(page) == "The first line of this page is long and goes on over the next one, which is as long, and ends here.\n\nAnother paragraph starts on the next line of the page and has a hyphenated word, and style.\n\nLast one"
    assert html.paragraphs_of(None) == html.paragraphs_of(" \n\n") == ""


def test_links_in_any_quotes(spark):
    page = """<a class=x href="/a b">1</a><A HREF='/c"d'>2</A><a href=/e>3</a><a name=q>4</a><a title="x" href = "/f">5</a><area href="/no"> <a """
    assert spark.createDataFrame([(page,)], "p string").select(html.links(F.col("p"))).first()[0] == ["/a b", '/c"d', "/e", "/f"]


def test_projects_of_topics():
    def unit(slug, area="x", open=True, checks=True):
        return {"slug": slug, "area": area, "open": open, "checks": checks}

    plan = [unit("a", open=False), unit("b"), unit("c", open=False), unit("d"), unit("e", area="y"), unit("f", area=None, open=False), unit("g", open=False, checks=False)]
    assert study.assigned(plan, []) == {} and study.assigned(plan, ["g", "none"]) == {}
    assert study.assigned(plan, ["b", "b", "e"]) == {"b": "b", "e": "e"}
    assert study.assigned(plan, ["a", "c"]) == {"a": "b", "c": "d"}
    assert study.assigned(plan, ["c", "a"], {"c": "b"}) == {"c": "b", "a": "d"}  # what it had comes before plan order
    assert study.assigned(plan, ["a", "d", "b"]) == {"a": "a", "d": "d", "b": "b"}  # nothing left for a
    assert study.assigned(plan, ["f"], {"f": "b"}) == {"f": "f"}  # no area, no other unit
    assert study.assigned(plan, ["a"], {"a": "e"}) == {"a": "b"}  # another area's unit is not taken up again
    # b is back on its own unit and worked on d before: others take d last
    more = [*plan[:4], unit("h")]
    assert study.assigned(more, ["a", "b"], {"b": "d"}) == {"a": "h", "b": "b"}
    assert study.assigned(more, ["a", "b", "c"], {"b": "d"}) == {"a": "h", "b": "b", "c": "d"}


def test_html_text():
    page = "<html><head><title>no</title></head><body><nav>menu</nav><article><h1>Head <b>line</b></h1><p>One<p>Two &amp; three<script>x()</script></article><footer>f</footer></body>"
    assert html.text_of(page) == "# Head line\n\nOne\n\nTwo & three"
    assert html.text_of("<body>plain</body>") == "plain" and html.text_of(None) == ""
    assert html.text_of("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert html.text_of(f"<body><div>short</div><div>{'long ' * 60}</div></body>").startswith("long")


def test_sitemaps_canonical_links_and_profiles(spark):
    pages = "<?xml version='1.0'?><urlset><url><loc> https://a.org/2024/05/x </loc></url><url><loc>https://a.org/y?a=1&amp;b=2</loc><lastmod>2024-06-01</lastmod></url><url><lastmod>2024-07-01T10:00:00Z</lastmod><loc>https://b.net/z</loc></url><url><loc>https://a.org/2024/05/x</loc></url></urlset>"
    assert [(p["loc"], p["lastmod"], p["day"]) for p in html.places_of(pages)] == [("https://b.net/z", "2024-07-01T10:00:00Z", ""), ("https://a.org/y?a=1&b=2", "2024-06-01", ""), ("https://a.org/2024/05/x", "", "2024-05-01")]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.org/{n}.xml</loc></sitemap>" for n in ("tag-sitemap", "post-sitemap", "other")) + "</sitemapindex>"
    assert [(p["is_map"], p["loc"]) for p in html.places_of(index)] == [(True, "https://a.org/post-sitemap.xml")]
    assert [p["loc"] for p in html.places_of(index.replace("post-", "misc-"))] == ["https://a.org/misc-sitemap.xml", "https://a.org/other.xml"]
    assert html.places_of(None) == [] and html.places_of("<rss/>") == []
    got = readers.sitemaps(spark.createDataFrame([("s", "https://www.a.org/", pages), ("s", "https://a.org", index)], "source string, site string, body string")).collect()
    assert sorted((r.is_map, r.loc) for r in got) == [(False, "https://a.org/2024/05/x"), (False, "https://a.org/y?a=1&b=2"), (True, "https://a.org/post-sitemap.xml")]
    page = "<link rel='me' href='/@me'><a href=\"https://www.youtube.com/@who\">v</a><a rel=\"nofollow me\" href=\"https://m.social/@x\">m</a><a href=\"/home\">h</a><a rel=me>n</a><link rel=\"canonical\" href=\"/own?a=1&amp;b=2\">"
    r = spark.createDataFrame([(page, "https://a.org/p"), (None, None)], "h string, u string").select(html.canonical("h", "u").alias("c"), html.profiles("h", "u").alias("p")).collect()
    assert r[0].c == "https://a.org/own?a=1&b=2" and r[0].p == ["https://a.org/@me", "https://www.youtube.com/@who", "https://m.social/@x"]
    assert r[1].c == "" and r[1].p == []
    assert html.canonical_of('<meta property="og:url" content="https://o.org/">', "https://a.org") == "https://o.org/"


def test_feed_items_bring_back_whole_texts(spark, data):
    import hashlib

    from sparkloom import plans

    texts = {f"D{r.doc_id}": " ".join((r.text or "").split()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.title: r.text_sha256 for r in plans.queries()["feed_items"](spark, data).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()} and max(map(len, texts.values())) > 200


def test_every_text_comes_back_from_its_inverted_index(spark, data):
    from sparkloom import plans

    texts = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect()}
    got = plans.queries()["inverted_abstract"](spark, data).collect()
    assert len(got) == len(texts) and all(" ".join(r.text.split()) == texts[r.doc_id] for r in got)


def test_transcripts_and_feeds():
    assert html.prose_of("WEBVTT\n\n1\n00:00.000 --> 00:01.000\nHello\n\n00:01.000 --> 00:02.000\nHello\nthere") == "Hello there"
    assert html.prose_of('{"segments": [{"text": " a"}, {"text": "b"}]}') == "a b" and html.prose_of(None) == ""
    rss = "<rss><channel><item><title>A & B&nbsp;c</title><link>u</link><description>short</description><pubDate>d</pubDate></item></channel></rss>"
    assert html.items_of(rss) == [{"title": "A & B c", "link": "u", "date": "d", "text": "short", "author": "", "media": ""}]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="alternate" href="h"/><updated>x</updated></entry></feed>'
    assert html.items_of(atom)[0]["link"] == "h" and html.items_of("<broken") == [] and html.items_of(None) == []
    assert html.decoded("é".encode("latin-1") + b"<meta charset=latin-1>").startswith("é")
    assert html.paragraphs_of("eﬃ-\ncient\nline\n\nnext") == "efficient line\n\nnext"


def test_study(spark):
    rows = [(0, 240_000, "paper"), (0, 1_800_000, "paper"), (0, 200 * 60_000, "mattina"), (0, 100 * 60_000, "mattina"), (5, 1, "paper")]
    got = [tuple(r.c) for r in spark.createDataFrame(rows, "a long, b long, k string").select(study.closed(F.col("a"), F.col("b"), F.col("k")).alias("c")).collect()]
    assert got == [(False, None, "not recorded"), (True, 30, None), (True, 30, "left running"), (True, 100, "over twice the plan"), (False, None, "not recorded")]
    assert [spark.range(1).select(study.review_history(F.array(*map(F.lit, g))).alias("d")).first().d for g in ([2], [2, 3], [3, 0], [1, 1])] == [2, 7, 0, 1]


def test_assignment_of_units():
    units = [{"slug": s, "area": a, "open": o, "checks": True} for s, a, o in (("base", "sql", False), ("join", "sql", True), ("agg", "sql", True), ("epi", "health", False))]
    assert study.assigned(units, ["base", "join"]) == {"base": "agg", "join": "join"}
    assert study.assigned(units, ["base"], {"base": "agg"}) == {"base": "agg"}
    assert study.assigned(units, ["epi", "none"]) == {"epi": "epi"}


def test_changes(spark):
    sources = spark.createDataFrame([("a", True, None), ("b", True, "cc"), ("c", False, None)], "url string, active boolean, licence string")
    changes = spark.createDataFrame([(1, "a", "b", None, None), (2, "b", None, False, "ogl"), (3, "c", "d", True, None), (4, "nowhere", "e", True, None)], "seq long, url string, new_url string, active boolean, licence string")
    assert {tuple(r) for r in audit.applied(sources, changes).collect()} == {("a", False, None), ("b", False, "ogl"), ("d", True, None)}
    again = audit.installed(sources, spark.createDataFrame([("z", True, None), ("z", True, None), ("a", True, None)], sources.schema), ["url"])
    assert sorted(r.url for r in again.collect()) == ["a", "b", "c", "z"]


def test_adapters(spark):
    row = '{"title": ["A  title"], "DOI": "10.1/X", "issued": {"date-parts": [[2024, 3]]}, "author": [{"given": "G", "family": "F"}], "abstract": "<p>Hi &amp; ho</p>", "URL": "u", "type": "t", "publisher": "p"}'
    schema = "title array<string>, DOI string, issued struct<`date-parts`: array<array<int>>>, author array<struct<given: string, family: string>>, abstract string, URL string, type string, publisher string"
    got = readers.crossref(spark.createDataFrame([(row,)], "j string").select(F.from_json("j", schema).alias("r"))).first()
    assert (got.key, got.title, str(got.day), got.authors, got.abstract) == ("10.1/x", "A title", "2024-03-01", ["G F"], "Hi & ho")
    fed = readers.feeds(spark.createDataFrame([("s", "<rss><channel><item><title>One Two</title><link>l</link><pubDate>2024-05-06</pubDate></item></channel></rss>")], "source string, body string")).first()
    assert (fed.key, fed.url, str(fed.day)) == ("one two", "l", "2024-05-06")


def test_packets_refuse_tampering(spark):
    key, other = F.lit("0123456789abcdef").cast("binary"), F.lit("fedcba9876543210").cast("binary")
    sealed = sinks.packets(spark.createDataFrame(EVENTS, LOG), key, 4)
    assert sealed.agg(F.sum("n")).first()[0] == len(EVENTS)
    assert sealed.where(sinks.opened(F.col("body"), key).isNull()).count() == 0
    assert sealed.where(sinks.opened(F.col("body"), other).isNotNull()).count() == 0


def test_written_summaries(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sinks.materialise(df, f"{tmp_path}/m", "k").count() == 2
    sinks.audit([df, df.withColumn("w", F.lit(1))], f"{tmp_path}/a")
    assert spark.read.option("header", True).csv(f"{tmp_path}/a").columns == ["k", "v", "w"]


def test_practice_tables_have_to_be_whole(spark, data):
    assert set(readers.practice(spark, data, ["region", "nation"], {"nation": ["n_name"]})) == {"region", "nation"}
    with pytest.raises(ValueError, match="nation.nothing"):
        readers.practice(spark, data, ["nation"], {"nation": ["n_name", "nothing"]})
    with pytest.raises(Exception):
        readers.practice(spark, data, ["nowhere"])
    with pytest.raises(ValueError, match="user_id"):
        readers.owned({"nation": spark.read.parquet(f"{data}/nation.parquet")}, 1)


def test_a_cut_selection_is_refused(spark):
    def pages(*sizes):
        return spark.createDataFrame([(k, list(range(10 * k, 10 * k + n))) for k, n in enumerate(sizes)], "page int, rows array<int>")

    assert sorted(r.row for r in readers.whole_selection(pages(3, 3, 2, 0), 3).collect()) == [0, 1, 2, 10, 11, 12, 20, 21]
    assert readers.whole_selection(pages(0), 3).count() == 0
    for cut in (pages(3, 3), pages(3, 2, 3, 0)):
        with pytest.raises(ValueError):
            readers.whole_selection(cut, 3)


def test_catalogue_is_replaced_as_a_whole(spark, tmp_path):
    import os

    rows = [("a", datetime.date(2024, 1, 2)), ("a", datetime.date(2024, 1, 1)), (None, None)]
    for n in (3, 2):
        sinks.catalogue(spark.createDataFrame(rows[:n], "source string, day date"), f"{tmp_path}/c")
        assert spark.read.json(f"{tmp_path}/c/items").count() == n and os.listdir(tmp_path) == ["c"]
    assert [r.value for r in spark.read.text(f"{tmp_path}/c/report").collect()] == ["| source | items | latest |", "|-|-|-|", "| a | 2 | 2024-01-02 |"]


def test_derived_keys(spark):
    import hashlib

    key = spark.range(1).select(sinks.derived_key("p", b"s", 1000)).first()[0]
    assert bytes(key) == hashlib.pbkdf2_hmac("sha256", b"p", b"s", 1000, 32)


def test_order_within_keys(spark):
    draw = random.Random(4)
    rows = [(f"k{draw.randrange(3)}", draw.randrange(1000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    expected, before = {}, {}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        for n, (t, i) in enumerate(own):
            expected[i], before[i] = n, own[n - 1][1] if n else None
    by = F.floor(F.col("t") / 50)
    assert {r.i: r.n for r in ordering.numbered(df, ["k"], ["t", "i"], by, "n").collect()} == expected
    assert {r.i: r.p and r.p.i for r in ordering.with_previous(df, ["k"], ["t", "i"], by, ["i"], "p").collect()} == before


def test_ordered_fingerprints(spark):
    from sparkloom.functions import codes

    rows = [("a", k, f"ë{k * 7919 % 1013}") for k in range(60)] + [("b", 1, "x")]
    got = codes.ordered_fingerprints(spark.createDataFrame(rows, "k string, t long, id string"), ["k"], ["t"], F.floor(F.col("t") / 9)).collect()
    assert {r.k: r.fingerprint for r in got} == {key: codes.fingerprint([i for k, _, i in rows if k == key]) for key in "ab"}


def test_readable_source_names(spark):
    names = {"rss[Data + Society]+arxiv": "Data + Society", "rss[Data Skeptic [Audio]]": "Data Skeptic [Audio]", "arxiv[ia]": "arXiv", "doab+doaj": "DOAB", " mine ": "mine", "": "", None: ""}
    df = spark.createDataFrame([(k,) for k in names], "s string").select("s", text.source_name(F.col("s")).alias("n"))
    assert {r.s: r.n for r in df.collect()} == names


def test_marks_are_stripped_in_any_script(spark):
    df = spark.createDataFrame([("ČŐŞŁ ñ é e\u0301 ώ й ế ß",)], "s string")
    assert df.select(text.folded(F.col("s"))).first()[0] == "cosł n e e ω и e ß"


def test_small_tables_are_dealt_out(spark, data, monkeypatch):
    from sparkloom import tables

    df = spark.read.parquet(f"{data}/events.parquet")
    wide = tables.spread(df)
    assert wide.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and wide.count() == df.count()
    monkeypatch.setattr(tables, "SMALL", 10)
    assert tables.spread(df) is df


def test_tables_change_together_under_one_writer(spark, tmp_path):
    import os

    df = spark.range(3)
    for n in (3, 2):
        sinks.transaction({"a": df.limit(n), "b": df.limit(1)}, f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t/a").count() == n and os.listdir(tmp_path) == ["t"]
    with sinks.writer(spark, f"{tmp_path}/t"):
        with pytest.raises(TimeoutError):
            with sinks.writer(spark, f"{tmp_path}/t", 2, 0.01):
                pass
    with sinks.writer(spark, f"{tmp_path}/t", 1):
        assert sorted(os.listdir(tmp_path))[-1] == "t.lock"
    assert os.listdir(tmp_path) == ["t"]


def test_sitemaps_read_event_by_event():
    inner = "<url><image:image><image:loc>https://a.org/pic.png</image:loc></image:image><loc>\n https://a.org/2024/02/30/x </loc></url>"
    assert [(p["loc"], p["day"]) for p in html.places_of(f"<urlset>{inner}</urlset>")] == [("https://a.org/2024/02/30/x", "2024-02-01")]
    cut = "<s:urlset><s:url><s:loc><![CDATA[https://a.org/a?b=1&c=2]]></s:loc><s:lastmod>2024-01-02</s:lastmod></s:url><s:url><s:loc>https://a.org/b"
    assert [(p["loc"], p["lastmod"]) for p in html.places_of(cut)] == [("https://a.org/a?b=1&c=2", "2024-01-02"), ("https://a.org/b", "")]
    days = {"https://a.org/2023-11-05/t": "2023-11-05", "https://a.org/2023/11/t": "2023-11-01", "https://a.org/2023/13/t": "", "https://a.org/1999/01/02": "", "https://a.org/id-2024-05": "2024-05-01", "https://a.org/20240501": ""}
    assert {a: html.day_of(a) for a in days} == days
    kinds = {"https://a.org/news-sitemap1.xml": {"pieces"}, "https://a.org/categories.xml": {"other"}, "https://a.org/post-tags.xml": {"pieces", "other"}, "https://a.org/blog/s.xml": set()}
    assert {a: html.listed_in(a) for a in kinds} == kinds


def test_null_keys_are_keys_in_buckets(spark):
    from sparkloom.operators import ordering

    rows = [(None, k, k % 3) for k in range(9)] + [("a", k, -k) for k in range(9)] + [("a", None, 50)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    bucket = F.floor(F.col("at") / 2)
    assert sorted((r.key or "", -1 if r.at is None else r.at, r.nth) for r in ordering.numbered(df, ["key"], ["at"], bucket, "nth").collect()) == [("", k, k) for k in range(9)] + [("a", k - 1, k) for k in range(10)]
    got = {(r.key, r.at): (r.m, r.s) for r in ordering.running_sum(ordering.running_max(df, ["key"], ["at"], bucket, "v", "m"), ["key"], ["at"], bucket, F.col("v"), "s").collect()}
    assert [got[None, k] for k in (0, 1, 2, 8)] == [(0, 0), (1, 1), (2, 3), (2, 9)] and got["a", 8] == (50, 14) and got["a", None] == (50, 50)
    before = {(r.key, r.at): r.p and r.p.at for r in ordering.with_previous(df.where("at IS NOT NULL"), ["key"], ["at"], bucket, ["at"], "p").collect()}
    assert all(before[key, k] == (k - 1 if k else None) for key in (None, "a") for k in range(9))


def test_clock_fold_equals_the_clock_step_by_step(spark):
    import random

    from sparkloom.functions import hlc
    from sparkloom.operators import clocks

    draw, rows = random.Random(2), []
    for device in ("a", "b", None):
        rows += [(device, k, draw.randrange(50), draw.choice([None, None, "?", f"{draw.randrange(60):012x}-{draw.choice([0, 7, 65535]):04x}-z"])) for k in range(300)]
    got = {(r.device, r.nth): r.hlc for r in clocks.restamped(spark.createDataFrame(rows, "device string, nth long, now long, other string"), F.floor(F.col("nth") / 16)).collect()}
    assert len(got) == 900
    for device in ("a", "b"):
        clock = hlc.Clock(device)
        for _, k, now, other in (r for r in rows if r[0] == device):
            assert got[device, k] == (clock.tick(now) if other is None else clock.absorb(other, now))


@pytest.mark.parametrize("most", [None, 0, 60, 10**9])
def test_running_total_over_one_order(spark, most):
    draw = random.Random(6)
    rows = [(k, draw.choice([0, 1, 2, 40, None])) for k in range(500)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r.k: r.upto for r in ordering.running_total(df, [F.desc("k")], "v", "upto", most).collect()}
    want, upto = {}, 0
    for k, v in sorted(rows, reverse=True):
        upto += v or 0
        if most is None or upto <= most:
            want[k] = upto
    assert got == want
    assert ordering.running_total(df.limit(0), [F.col("k")], "v", "upto", most).count() == 0


def test_broken_feeds_give_their_items():
    def item(n, inner=""):
        return f"<item><title>T{n}</title><link>u{n}</link>{inner}<pubDate>d{n}</pubDate></item>"

    def read(feed):
        return [(i["title"], i["link"], i["date"]) for i in html.items_of(feed)]

    whole = [(f"T{n}", f"u{n}", f"d{n}") for n in range(3)]
    head, tail = "<rss><channel><title>Feed</title>", "</channel></rss>"
    assert read(head + "".join(map(item, range(3))) + tail) == whole
    assert read(head + "".join(map(item, range(3)))) == whole  # cut after an item
    assert read(head + item(0) + item(1) + "<item><title>T2</title><link>u2</link><pubDate>d2") == whole  # cut within one
    assert read(head + item(0) + item(1, "<description><b>bold</description>") + item(2) + tail) == whole  # crossed tags
    assert read(head + item(0) + "<item><title>T1<link>u1</link><pubDate>d1</pubDate></item>" + item(2) + tail) == whole  # unclosed field
    assert read(head + item(0) + "<item><title>T1</title><link>u1</link><pubDate>d1</pubDate>" + item(2) + tail) == whole  # unclosed item
    assert read(head + item(0) + "</b></item></p>" + item(1) + item(2) + "</wrong>" + tail) == whole  # ends of nothing
    assert read(head + item(0) + item(1, "<x a=1 b>text</x>") + item(2) + tail) == whole  # attributes without quotes
    cut = "<feed><entry><title><![CDATA[A <b> & c]]></title><link href='h'/><author><name>N</name></author><updated>2024</updated><content>text<br>more</content>"
    assert html.items_of(cut) == [{"title": "A <b> & c", "link": "h", "date": "2024", "text": "textmore", "author": "N", "media": ""}]
    assert html.items_of("<broken") == [] and html.items_of("no feed < at all") == []
