"""Stored responses of open archives as catalogue items: one JSON record per row, one projection per archive.

Every adapter takes ``records(body)``, a record's JSON as text, and returns the catalogue schema,
so their results are put together with ``unionByName``.  Records without a title go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import html
from sparkloom.functions.text import normalised
from sparkloom.sources.readers import item

SCHEMAS = {
    "arxiv": "title string, summary string, published string, doi string, id string, pdf string, authors array<string>, categories array<string>",
    "doaj": "created_date string, bibjson struct<title: string, year: string, month: string, abstract: string, keywords: array<string>, author: array<struct<name: string>>, link: array<struct<type: string, url: string>>, identifier: array<struct<type: string, id: string>>, journal: struct<title: string, license: array<struct<type: string>>>>",
    "europepmc": "id string, source string, pmcid string, title string, doi string, firstPublicationDate string, authorString string, abstractText string, journalTitle string",
    "zenodo": "access struct<record: string>, links struct<html: string>, files array<struct<key: string, links: struct<self: string>>>, metadata struct<title: string, doi: string, access_right: string, publication_date: string, description: string, keywords: array<string>, creators: array<struct<name: string>>, license: struct<id: string>>",
    "doab": "name string, handle string, metadata array<struct<key: string, value: string>>",
    "gutenberg": "id long, title string, authors array<struct<name: string>>, subjects array<string>, formats map<string,string>",
    "standard_ebooks": "title string, summary string, updated string, url string, authors array<string>",
}


def _day(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date")


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), 0)


def _arxiv(r: Column) -> dict[str, Column]:
    return {"title": r["title"], "url": F.coalesce(r["id"], r["pdf"]), "url_pdf": r["pdf"], "doi": r["doi"], "day": _day(r["published"]), "authors": r["authors"], "abstract": r["summary"], "concepts": r["categories"], "kind": F.lit("preprint"), "publisher": F.lit("arXiv")}


def _doaj(r: Column) -> dict[str, Column]:
    b = r["bibjson"]
    page = _first(b["link"], lambda x: x["type"] == "fulltext")["url"]
    day = F.coalesce(_day(r["created_date"]), F.concat(b["year"], F.lit("-"), F.lpad(F.coalesce(b["month"], F.lit("1")), 2, "0"), F.lit("-01")).try_cast("date"))
    return {"title": b["title"], "url": page, "url_pdf": F.when(F.lower(page).endswith(".pdf"), page), "doi": _first(b["identifier"], lambda x: x["type"] == "doi")["id"], "day": day, "authors": F.transform(b["author"], lambda a: a["name"]), "abstract": b["abstract"], "concepts": b["keywords"], "licence": F.get(b["journal"]["license"], 0)["type"], "publisher": b["journal"]["title"], "kind": F.lit("articolo")}


def _europepmc(r: Column) -> dict[str, Column]:
    url = F.concat(F.lit("https://europepmc.org/article/"), F.coalesce(r["source"], F.lit("MED")), F.lit("/"), r["id"])
    pdf = F.concat(F.lit("https://europepmc.org/articles/"), r["pmcid"], F.lit("?pdf=render"))
    names = F.filter(F.transform(F.split(r["authorString"], ","), lambda a: F.trim(a)), lambda a: a != "")
    return {"title": r["title"], "url": url, "url_pdf": pdf, "doi": r["doi"], "day": _day(r["firstPublicationDate"]), "authors": names, "abstract": r["abstractText"], "publisher": r["journalTitle"], "kind": F.lit("articolo"), "licence": F.lit("open access")}


def _zenodo(r: Column) -> dict[str, Column]:
    m = r["metadata"]
    is_open = (r["access"]["record"] == "public") | (m["access_right"] == "open")
    pdf = _first(r["files"], lambda f: F.lower(f["key"]).endswith(".pdf"))["links"]["self"]
    return {"title": F.when(is_open, m["title"]), "url": r["links"]["html"], "url_pdf": pdf, "doi": m["doi"], "day": _day(m["publication_date"]), "authors": F.transform(m["creators"], lambda a: a["name"]), "abstract": html.bare(F.coalesce(m["description"], F.lit(""))), "concepts": m["keywords"], "licence": m["license"]["id"], "kind": F.lit("rapporto"), "publisher": F.lit("Zenodo")}


def _doab(r: Column) -> dict[str, Column]:
    def of(key: str) -> Column:
        return _first(r["metadata"], lambda m: m["key"] == key)["value"]

    def listed(key: str) -> Column:
        return F.array_compact(F.array(of(key)))

    year = F.concat(F.substring(of("dc.date.issued"), 1, 4), F.lit("-01-01")).try_cast("date")
    url = F.coalesce(of("dc.identifier.uri"), F.concat(F.lit("https://directory.doabooks.org/handle/"), r["handle"]))
    return {"title": F.coalesce(r["name"], of("dc.title")), "url": url, "day": year, "authors": listed("dc.contributor.author"), "abstract": of("dc.description.abstract"), "concepts": listed("dc.subject"), "licence": F.coalesce(of("dc.rights"), F.lit("open access")), "publisher": F.coalesce(of("publisher"), of("dc.publisher")), "kind": F.lit("libro")}


def _gutenberg(r: Column) -> dict[str, Column]:
    def form(part: str) -> Column:
        return F.get(F.filter(F.map_entries(r["formats"]), lambda e: e["key"].contains(part)), 0)["value"]

    return {"title": r["title"], "url": F.concat(F.lit("https://www.gutenberg.org/ebooks/"), r["id"].cast("string")), "url_pdf": F.coalesce(form("pdf"), form("epub")), "authors": F.transform(r["authors"], lambda a: a["name"]), "concepts": F.slice(r["subjects"], 1, 8), "licence": F.lit("public domain"), "kind": F.lit("libro"), "publisher": F.lit("Project Gutenberg")}


def _standard_ebooks(r: Column) -> dict[str, Column]:
    return {"title": r["title"], "url": r["url"], "day": _day(r["updated"]), "authors": r["authors"], "abstract": r["summary"], "licence": F.lit("public domain"), "kind": F.lit("libro"), "publisher": F.lit("Standard Ebooks")}


ADAPTERS = {"arxiv": _arxiv, "doaj": _doaj, "europepmc": _europepmc, "zenodo": _zenodo, "doab": _doab, "gutenberg": _gutenberg, "standard_ebooks": _standard_ebooks}


def read(records: DataFrame, archive: str) -> DataFrame:
    """Catalogue items of one archive's stored records."""
    parsed = records.select(F.from_json("body", SCHEMAS[archive]).alias("r"))
    columns = ADAPTERS[archive](F.col("r"))
    return parsed.select(*item(**columns, source=F.lit(archive))).where(F.coalesce("title", F.lit("")) != "")


#: Ways to a full text, by how much of it they give.
QUALITY = {"copia aperta": 5, "libro ad accesso aperto": 5, "pubblico dominio": 5, "vista integrale": 4, "prestito digitale": 3, "testo online": 3, "solo scheda": 1, "biblioteca": 0}


#: Answers of services that are asked for one title: schema, and access, address and title of an answer.
LOOK_UPS = {
    "unpaywall": "title string, is_oa boolean, best_oa_location struct<url: string, url_for_pdf: string>",
    "openalex": "display_name string, open_access struct<is_oa: boolean, oa_url: string>",
    "openlibrary": "title string, key string, ebook_access string",
    "hathitrust": "title string, items array<struct<itemURL: string, usRightsString: string>>",
    "doab": "name string, handle string",
}


def answered(records: DataFrame, service: str) -> DataFrame:
    """(key, via, access, url, title) of a service's stored answers (key, body); no address where it gives no access."""
    r = F.col("r")
    open_item = _first(r["items"], lambda i: F.lower(i["usRightsString"]) == "full view") if service == "hathitrust" else None
    columns = {
        "unpaywall": lambda: (F.lit("copia aperta"), F.when(r["is_oa"], F.coalesce(r["best_oa_location"]["url_for_pdf"], r["best_oa_location"]["url"])), r["title"]),
        "openalex": lambda: (F.lit("copia aperta"), F.when(r["open_access"]["is_oa"], r["open_access"]["oa_url"]), r["display_name"]),
        "openlibrary": lambda: (F.when(r["ebook_access"] == "public", "pubblico dominio").when(r["ebook_access"] == "borrowable", "prestito digitale").otherwise("solo scheda"), F.concat(F.lit("https://openlibrary.org"), r["key"]), r["title"]),
        "hathitrust": lambda: (F.when(open_item.isNotNull(), "vista integrale").otherwise("solo scheda"), F.coalesce(open_item["itemURL"], F.get(r["items"], 0)["itemURL"]), r["title"]),
        "doab": lambda: (F.lit("libro ad accesso aperto"), F.concat(F.lit("https://directory.doabooks.org/handle/"), r["handle"]), r["name"]),
    }
    access, url, title = columns[service]()
    parsed = records.select("key", F.from_json("body", LOOK_UPS[service]).alias("r"))
    return parsed.select("key", F.lit(service).alias("via"), access.alias("access"), url.alias("url"), title.alias("title")).where("title IS NOT NULL")


def located(wanted: DataFrame, answers: DataFrame, compared: int = 50) -> DataFrame:
    """The best access per wanted title: wanted(key, title), answers(key, via, access, url, title).

    An answer about another title (its first ``compared`` characters, normalised, differ) does not count.
    """
    rank = F.create_map(*(F.lit(x) for pair in QUALITY.items() for x in pair))
    a = answers.withColumn("q", F.coalesce(rank[F.col("access")], F.lit(0))).withColumn("n", F.substring(normalised("title"), 1, compared))
    w = wanted.select("key", F.substring(normalised("title"), 1, compared).alias("m"))
    fitting = w.join(a, "key").where("m = n AND url IS NOT NULL")
    best = fitting.groupBy("key").agg(F.max_by(F.struct("via", "access", "url", "q"), F.struct("q", "via")).alias("b"))
    return wanted.join(best, "key", "left").select("key", "title", "b.via", "b.access", "b.url", F.col("b.q").alias("quality"))


def pdf_links(pages: DataFrame) -> DataFrame:
    """The link on each page (key, title, url, html) most likely to be the document itself, if any is.

    A title's distinctive words (four letters and more) are looked for in the link's path and text,
    never in its host; two of them have to be there, or the only one.
    """
    link = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^<>]*+>.*?(?:</a>|(?=<a\s)|\z)"), F.lit(0))
    each = pages.select("key", "title", F.posexplode(link).alias("nth", "tag"))
    target = F.get(html.links(F.col("tag")), 0)
    path = F.regexp_replace(F.lower(target), "^[a-z]+://[^/]*", "")
    where = F.concat(path, F.lit(" "), F.lower(F.regexp_replace("tag", "<[^<>]*+>", " ")))
    words = F.filter(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= 4)
    scored = each.select("key", "nth", target.alias("url"), F.size(F.filter(words, lambda w: F.contains(where, w))).alias("hits"), F.size(words).alias("n"), F.lower(path).rlike(r"\.pdf($|\?)").alias("pdf"))
    good = scored.where(F.col("pdf") & (F.col("hits") >= F.least(F.lit(2), F.greatest(F.lit(1), F.col("n")))))
    return good.groupBy("key").agg(F.max_by("url", F.struct("hits", -F.col("nth"))).alias("url"), F.max("hits").alias("hits"))
