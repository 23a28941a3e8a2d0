"""Candidates for new sources out of stored answers of discovery services: a row per address, one projection per service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.functions.text import normalised

SCHEMAS = {
    "news": "hits array<struct<title: string, url: string, points: long>>",
    "relief": "data array<struct<fields: struct<name: string, homepage: string>>>",
    "podcasts": "results array<struct<collectionName: string, feedUrl: string, trackCount: long>>",
    "repositories": "items array<struct<full_name: string, homepage: string, stargazers_count: long>>",
}


def _found(rows: Column, title: str, url: str, weight: str | None = None) -> Column:
    """An array of (title, url, weight) structs of a service's rows."""

    def one(r: Column) -> Column:
        def get(path: str) -> Column:
            value = r
            for part in path.split("."):
                value = value[part]
            return value

        return F.struct(get(title).alias("title"), get(url).alias("url"), (get(weight) if weight else F.lit(1)).cast("long").alias("weight"))

    return F.transform(rows, one)


SERVICES = {
    "news": ("hits", "title", "url", "points"),
    "relief": ("data", "fields.name", "fields.homepage", None),
    "podcasts": ("results", "collectionName", "feedUrl", "trackCount"),
    "repositories": ("items", "full_name", "homepage", "stargazers_count"),
}


def candidates(bodies: DataFrame, service: str) -> DataFrame:
    """(service, title, url, weight) of the stored JSON answers (body) of one service; rows without an address go."""
    rows, title, url, weight = SERVICES[service]
    parsed = bodies.select(F.explode(_found(F.from_json("body", SCHEMAS[service])[rows], title, url, weight)).alias("c"))
    return parsed.select(F.lit(service).alias("service"), "c.*").where(F.col("url").rlike("^https?://"))


def curated(bodies: DataFrame) -> DataFrame:
    """(service, title, url, weight) of Markdown lists (body): items that are links, without badges and links within the page."""
    link = F.regexp_extract_all("body", F.lit(r"(?m)^\s*+[-*+]\s++\[([^\]\n]++)\]\((https?://[^)\s]++)"), F.lit(0))
    e = bodies.select(F.explode(link).alias("x"))
    return e.select(F.lit("curated").alias("service"), F.regexp_extract("x", r"\[([^\]]+)\]", 1).alias("title"), F.regexp_extract("x", r"\((https?://.+)$", 1).alias("url"), F.lit(1).cast("long").alias("weight"))


def ranked(found: DataFrame, known: DataFrame) -> DataFrame:
    """(host, title, mentions, weight) per host that is not known (host): the title is that of the weightiest mention."""
    rows = found.select(urls.host(F.col("url")).alias("host"), normalised("title").alias("title"), "weight").where("host IS NOT NULL")
    fresh = rows.groupBy("host").agg(F.max_by("title", F.struct("weight", "title")).alias("title"), F.count("*").alias("mentions"), F.sum("weight").alias("weight"))
    return fresh.join(known.select("host"), "host", "left_anti")
