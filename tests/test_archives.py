"""Stored archive records, access ranking, link finding and codes."""

import json

import pytest

from sparkloom.functions import codes
from sparkloom.sources import archives, scouting

RECORDS = {
    "arxiv": ({"title": " A  paper ", "summary": "s", "published": "2024-05-06T00:00:00Z", "id": "u", "pdf": "p", "authors": ["x", "y"], "categories": ["c"]}, ("a paper", "u", "p", "2024-05-06", ["x", "y"])),
    "doaj": ({"created_date": "2024-05-06T01:00:00Z", "bibjson": {"title": "T", "link": [{"type": "fulltext", "url": "x.PDF"}], "identifier": [{"type": "doi", "id": "10.1/A"}], "author": [{"name": "n"}]}}, ("10.1/a", "x.PDF", "x.PDF", "2024-05-06", ["n"])),
    "europepmc": ({"id": "7", "pmcid": "PMC7", "title": "T", "firstPublicationDate": "2024-05-06", "authorString": "A B, C D, "}, ("t", "https://europepmc.org/article/MED/7", "https://europepmc.org/articles/PMC7?pdf=render", "2024-05-06", ["A B", "C D"])),
    "zenodo": ({"access": {"record": "public"}, "links": {"html": "h"}, "files": [{"key": "a.csv", "links": {"self": "1"}}, {"key": "b.PDF", "links": {"self": "2"}}], "metadata": {"title": "T", "publication_date": "2024-05-06", "creators": [{"name": "n"}], "description": "<p>d</p>"}}, ("t", "h", "2", "2024-05-06", ["n"])),
    "doab": ({"name": "B", "handle": "20/1", "metadata": [{"key": "dc.date.issued", "value": "2019-01"}, {"key": "dc.contributor.author", "value": "n"}]}, ("b", "https://directory.doabooks.org/handle/20/1", None, "2019-01-01", ["n"])),
    "gutenberg": ({"id": 5, "title": "G", "authors": [{"name": "n"}], "formats": {"application/epub+zip": "e"}}, ("g", "https://www.gutenberg.org/ebooks/5", "e", None, ["n"])),
    "standard_ebooks": ({"title": "S", "updated": "2024-05-06T00:00:00Z", "url": "u", "authors": ["n"]}, ("s", "u", None, "2024-05-06", ["n"])),
}


@pytest.mark.parametrize("name", RECORDS)
def test_adapter(spark, name):
    record, expected = RECORDS[name]
    rows = archives.read(spark.createDataFrame([(json.dumps(record),), ("{}",), ("junk",), (None,)], "body string"), name).collect()
    assert [(r.key, r.url, r.url_pdf, r.day and str(r.day), r.authors) for r in rows] == [expected] and rows[0].source == name


def test_adapters_share_a_schema(spark):
    empty = spark.createDataFrame([], "body string")
    assert len({archives.read(empty, n).schema.simpleString() for n in archives.ADAPTERS}) == 1


def test_best_access(spark):
    wanted = spark.createDataFrame([(1, "Élan vital"), (2, "Other")], "key long, title string")
    answers = spark.createDataFrame([(1, "a", "solo scheda", "u1", "elan vital"), (1, "b", "copia aperta", "u2", "ELAN  vital"), (1, "c", "copia aperta", "u3", "something else"), (2, "d", "copia aperta", None, "Other")], "key long, via string, access string, url string, title string")
    assert [tuple(r) for r in archives.located(wanted, answers).orderBy("key").collect()] == [(1, "Élan vital", "b", "copia aperta", "u2", 5), (2, "Other", None, None, None, None)]


def test_pdf_links(spark):
    page = '<a href="https://owasp.org/strategy.pdf">Plan</a> <a href="/files/top-ten-language-models.pdf">here</a> <a href="/top-ten-language-models.html">page</a>'
    df = spark.createDataFrame([(1, "Top ten for language models", "u", page), (2, "Owasp strategy of language", "u", '<a href="https://owasp.org/a.pdf">x</a>')], "key long, title string, url string, html string")
    assert [tuple(r) for r in archives.pdf_links(df).collect()] == [(1, "/files/top-ten-language-models.pdf", 2)]


def test_codes():
    for data in (b"\x00", b"hello", bytes(range(32))):
        assert codes.decoded(codes.encoded(data)) == data
    code = codes.encoded(b"hello")
    assert codes.decoded(f"{code[:3]}-{code[3:]}".lower()) == b"hello"
    with pytest.raises(ValueError):
        codes.decoded(code[:-1] + ("0" if code[-1] != "0" else "1"))
    assert codes.fingerprint(["ab", "c"]) == "2:17862" and codes.fingerprint([]) == "0:0"


def test_look_ups_without_access(spark):
    rows = spark.createDataFrame([(1, '{"title": "T", "is_oa": false, "best_oa_location": {"url": "u"}}'), (2, '{"title": "T", "is_oa": true, "best_oa_location": {"url": "u"}}'), (3, "junk"), (4, None)], "key long, body string")
    assert [tuple(r) for r in archives.answered(rows, "unpaywall").orderBy("key").collect()] == [(1, "unpaywall", "copia aperta", None, "T"), (2, "unpaywall", "copia aperta", "u", "T")]
    rows = spark.createDataFrame([(1, '{"title": "T", "items": []}'), (2, '{"title": "T"}')], "key long, body string")
    assert [(r.access, r.url) for r in archives.answered(rows, "hathitrust").collect()] == [("solo scheda", None)] * 2


def test_scouting_reads_what_there_is(spark):
    bodies = spark.createDataFrame([("{}",), ("junk",), (None,), ('{"hits": []}',), ('{"hits": [{"title": "a", "url": "ftp://x"}, {"title": "b", "url": "https://y.example", "points": null}]}',)], "body string")
    assert [tuple(r) for r in scouting.candidates(bodies, "news").collect()] == [("news", "b", "https://y.example", None)]
    page = spark.createDataFrame([("- [One](https://a.example/x) text\n  * [Two](http://b.example)\n[no](https://c.example)\n- [in](#x)\n- plain https://d.example",)], "body string")
    assert [(r.title, r.url) for r in scouting.curated(page).collect()] == [("One", "https://a.example/x"), ("Two", "http://b.example")]
