"""Sources: practice tables, JSON assets, archive records, feeds, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import html, text, urls
from sparkloom.operators.catalogue import MOST_ABSTRACT, MOST_AUTHORS, MOST_CONCEPTS

#: Column, type of a catalogue item.
ITEM = "key string, title string, authors array<string>, day date, doi string, kind string, source string, url string, url_pdf string, licence string, abstract string, concepts array<string>, publisher string"


def practice(spark: SparkSession, folder: str, names: list[str], columns: dict[str, list[str]] | None = None, attempts: int = 2) -> dict[str, DataFrame]:
    """Read-only tables of a folder as views of a session of their own.

    A table that is empty or lacks one of its ``columns`` is refused; a read that fails is tried again.
    """
    own = spark.newSession()
    for attempt in range(attempts):
        try:
            frames = {n: own.read.parquet(f"{folder}/{n}.parquet") for n in names}
            empty = [n for n, df in frames.items() if df.isEmpty()]
            break
        except Exception:
            if attempt == attempts - 1:
                raise
    lacking = [f"{n}.{c}" for n in names for c in (columns or {}).get(n, []) if c not in frames[n].columns]
    if empty or lacking:
        raise ValueError(f"practice tables are not whole: empty {empty}, lacking {lacking}")
    for n, df in frames.items():
        df.createOrReplaceTempView(n)
    return frames


def owned(frames: dict[str, DataFrame], owner: int | str, column: str = "user_id") -> dict[str, DataFrame]:
    """Of tables that have an owner's column the owner's rows alone; tables without it are refused."""
    bare = [n for n, df in frames.items() if column not in df.columns]
    if bare:
        raise ValueError(f"tables without {column}: {bare}")
    return {n: df.where(F.col(column) == F.lit(owner)) for n, df in frames.items()}


def whole_selection(pages: DataFrame, size: int) -> DataFrame:
    """The rows of stored pages (page, rows: an array) up to the first empty one.

    A page before the last that is shorter than ``size`` was cut by the server: what follows can't be
    trusted, so it raises rather than give a part for the whole.
    """
    sizes = [(r.page, r.n) for r in pages.select("page", F.size("rows").alias("n")).orderBy("page").collect()]  # a number per page
    stop = next((k for k, (_, n) in enumerate(sizes) if n == 0), None)
    if stop is None or any(n < size for _, n in sizes[: max(0, stop - 1)]):
        raise ValueError("the selection was cut: no empty page, or a short one before the last")
    return pages.where(F.col("page").isin([p for p, _ in sizes[:stop]])).select(F.explode("rows").alias("row"))


def prepared(spark: SparkSession, preparation: list[tuple[str, str]], sql: str) -> DataFrame:
    """A query after views of its own have been made: (name, SELECT) pairs in a session that is thrown away."""
    own = spark.newSession()
    for name, select in preparation:
        own.sql(select).createOrReplaceTempView(name)
    return own.sql(sql)


def assets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def insert_or_ignore(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """What is to be appended so that keys stay unique."""
    return fresh.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], order: str, merge: bool = True) -> DataFrame:
    """Existing rows with changes laid over by key, the last by ``order``; without ``merge`` existing rows win."""
    row = F.struct(*[F.col(c) for c in existing.columns])
    last = changes.groupBy(*keys).agg(F.max_by(row, order).alias("__r")).select("__r.*")
    if merge:
        return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)
    return existing.unionByName(last.join(existing.select(*keys), keys, "left_anti"))


def page_after(rows: DataFrame, after: tuple | None, size: int, arrival: str = "arrived", key: str = "id") -> DataFrame:
    """The next page by (arrival, key): a range, not an offset."""
    if after:
        at, last = after
        rows = rows.where((F.col(arrival) > F.lit(at)) | ((F.col(arrival) == F.lit(at)) & (F.col(key) > F.lit(last))))
    return rows.orderBy(arrival, key).limit(size)


def unfolded_abstract(index: Column) -> Column:
    """An abstract from its inverted index (word -> positions)."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def item(**columns: Column) -> list[Column]:
    """The catalogue schema's columns from those an adapter has; bounded lists and abstract, key by DOI or title."""
    null = F.lit(None)
    get = {n.split()[0]: columns.get(n.split()[0], null).cast(n.split()[1]) for n in ITEM.split(", ")}
    get["title"] = F.trim(F.regexp_replace(get["title"], r"\s+", " "))
    get["key"] = text.item_key(get["doi"], get["title"])
    get["authors"] = F.slice(F.coalesce(get["authors"], F.array().cast("array<string>")), 1, MOST_AUTHORS)
    get["concepts"] = F.slice(F.coalesce(get["concepts"], F.array().cast("array<string>")), 1, MOST_CONCEPTS)
    get["abstract"] = F.substring(F.coalesce(get["abstract"], F.lit("")), 1, MOST_ABSTRACT)
    return [c.alias(n) for n, c in get.items()]


def openalex(records: DataFrame) -> DataFrame:
    """Works as the archive returns them: a column r with id, title, doi, publication_date, abstract_inverted_index ..."""
    r = F.col("r")
    return records.select(*item(title=r["title"], doi=F.regexp_replace(r["doi"], "^https?://doi.org/", ""), day=r["publication_date"].try_cast("date"), authors=F.transform(r["authorships"], lambda a: a["author"]["display_name"]), abstract=unfolded_abstract(r["abstract_inverted_index"]), concepts=F.transform(r["concepts"], lambda c: c["display_name"]), url=r["id"], source=F.lit("openalex"), kind=r["type"]))


def crossref(records: DataFrame) -> DataFrame:
    """Works with title and date as arrays, as that registry writes them."""
    r = F.col("r")
    parts = r["issued"]["date-parts"][0]
    day = F.concat_ws("-", F.lpad(F.get(parts, 0).cast("string"), 4, "0"), F.lpad(F.coalesce(F.get(parts, 1), F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(F.get(parts, 2), F.lit(1)).cast("string"), 2, "0"))
    return records.select(*item(title=F.get(r["title"], 0), doi=r["DOI"], day=day.try_cast("date"), authors=F.transform(r["author"], lambda a: F.concat_ws(" ", a["given"], a["family"])), abstract=html.bare(F.coalesce(r["abstract"], F.lit(""))), url=r["URL"], source=F.lit("crossref"), kind=r["type"], publisher=r["publisher"]))


def feeds(bodies: DataFrame) -> DataFrame:
    """(source, body) of stored feeds as catalogue items."""
    from sparkloom.functions.dates import feed_date

    e = bodies.select("source", F.explode(html.feed_items("body")).alias("i"))
    return e.select(*item(title=F.col("i.title"), url=F.col("i.link"), day=feed_date(F.col("i.date")), abstract=F.col("i.text"), authors=F.array_compact(F.array(F.nullif(F.col("i.author"), F.lit("")))), source=F.col("source"), kind=F.lit("articolo")))


def sitemaps(bodies: DataFrame) -> DataFrame:
    """(source, site, body) of stored sitemaps -> sub-maps to store next, and addresses of the site itself."""
    e = bodies.select("source", "site", F.explode(html.sitemap_places("body")).alias("p")).select("source", "site", "p.*")
    return e.where(F.col("is_map") | urls.same_site(F.col("loc"), F.col("site"))).select("source", "is_map", "loc", "lastmod", "day")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Stored files with their SHA-256 and whether they are PDFs by their first bytes."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
