"""The catalogue: normalise, filter, classify, de-duplicate, rank.

An item has idx (reading order), key, title, abstract, concepts, source, day, has_pdf, is_book.
The vocabulary is an authored table (topic, term, tier) of terms of any number of words; an automaton
of it reads each text once (see ``functions.vocabulary``), so the cost does not grow with the terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text
from sparkloom.functions import vocabulary as vocabulary_
from sparkloom.sources.scratch import scratch

#: Weights of a term by tier, of a title against an abstract, of a concept; the threshold.
STRONG, WEAK, TITLE, CONCEPT, THRESHOLD = 1.0, 0.4, 1.5, 1.2, 1.0
MOST_AUTHORS, MOST_ABSTRACT, MOST_CONCEPTS = 12, 4000, 24
PER_SOURCE, PER_DAY, EXPLORED, EXPLORED_CHARS = 12, 80, 5, 1500
BOOST = 1.2
TERMS_IN_TASKS = 100_000

#: An authored vocabulary for the four languages of the documents table.
VOCABULARY = [
    ("english", "with", "strong"), ("english", "from", "strong"), ("english", "the", "weak"), ("english", "and", "weak"),
    ("french", "dans", "strong"), ("french", "pour", "strong"), ("french", "que", "weak"), ("french", "les", "weak"),
    ("german", "nicht", "strong"), ("german", "auch", "strong"), ("german", "und", "weak"), ("german", "der", "weak"),
    ("spanish", "como", "strong"), ("spanish", "para", "strong"), ("spanish", "los", "weak"), ("spanish", "una", "weak"),
]
CONCEPTS = [("english", "en"), ("french", "fr"), ("german", "de"), ("spanish", "es")]


def vocabulary(spark: SparkSession, rows: list[tuple[str, str, str]] = VOCABULARY) -> DataFrame:
    """(topic, term, strong), folded."""
    return spark.createDataFrame(rows, "topic string, term string, tier string").select("topic", text.folded(F.col("term")).alias("term"), (F.col("tier") == "strong").alias("strong"))


def items_of_documents(docs: DataFrame, most: int | None = MOST_ABSTRACT) -> DataFrame:
    """Documents as catalogue items: the first line is the title, the rest, whole or up to ``most`` characters, the abstract."""
    title = F.substring_index("text", "\n", 1)
    rest = F.length(title) + 2
    return docs.select(
        F.col("doc_id").alias("idx"),
        text.item_key(F.lit(None).cast("string"), title).alias("key"),
        title.alias("title"),
        (F.substr("text", rest) if most is None else F.substr("text", rest, F.lit(most))).alias("abstract"),
        F.slice(F.array("lang"), 1, MOST_CONCEPTS).alias("concepts"),
        "source",
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")).alias("day"),
        (F.pmod("doc_id", F.lit(3)) == 0).alias("has_pdf"),
        (F.pmod("doc_id", F.lit(17)) == 0).alias("is_book"),
    )


def any_word(column: Column, terms: list[str]) -> Column:
    """Whether any of the terms stands in the text as whole words; one pattern for all of them."""
    return text.folded(column).rlike(rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, terms))})(?!\w)")


#: Titles that are no publications; editorial noise; phrases of pieces worth a look without a topic.
NOT_PUBLICATIONS = [
    "retracted", "retraction of", "erratum", "corrigendum", "withdrawn",
    "table of contents", "front matter", "back matter", "editorial board",
    "call for papers", "conference programme", "author index", "issue information",
]
NOISE = [
    "round di finanziamento", "funding round", "series a", "series b", "valuation", "nomina", "appointed",
    "joins as", "steps down", "hires", "lancia il nuovo", "announces the launch", "now available",
    "general availability", "predizioni per il", "predictions for", "trends to watch", "what to expect in",
    "migliori strumenti", "best tools", "top 10", "top 5", "listicle", "ha dichiarato che", "ceo says",
    "reacts to", "slams", "sparks debate", "partnership with", "acquisisce", "acquires",
]
SIGNALS = ["case study", "lessons learned", "field notes", "retrospective", "how we built", "deep dive", "long read", "history of", "what we learned", "post-mortem"]


def _term_hits(items: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(idx, topic, term, strong, f): each term (or its number) that stands in an item, once, with the weight of its place.

    A vocabulary of at most ``most`` terms goes to the tasks as an automaton that reads each text once, whatever the
    number and length of terms; of a larger one a filter of bounded size goes there, and the runs of words that it lets
    through are joined with the terms.
    """
    spoken = terms.select("topic", "term", "strong", F.array_join(vocabulary_.words(F.col("term")), " ").alias("words")).where("words <> ''")
    known = spoken.select("words").distinct().limit(most + 1).collect()  # bounded
    title, abstract = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract"))
    if len(known) <= most:
        listed = sorted(r["words"] for r in known)
        terms_in = vocabulary_.finder(vocabulary_.Automaton(tuple(w.split(" ")) for w in listed))
        hits = items.select("idx", terms_in(vocabulary_.spaced(title)).alias("t"), terms_in(vocabulary_.spaced(abstract)).alias("a"))
        numbered = items.sparkSession.createDataFrame(list(enumerate(listed)), "w int, words string")
        spoken = F.broadcast(spoken.join(F.broadcast(numbered), "words"))  # checked above
    else:
        spark = items.sparkSession
        place = scratch(spark, "terms")
        spoken.withColumnRenamed("words", "w").distinct().withColumn("term", F.monotonically_increasing_id()).write.parquet(place)
        spoken = spark.read.parquet(place).hint("shuffle_hash")
        n, longest = spoken.agg(F.count("*"), F.max(F.size(F.split("w", " ")))).first()
        runs_in = vocabulary_.likely_runs(spark.sparkContext.broadcast(vocabulary_.run_filter(spoken.select("w"), n)), longest)
        texts = items.select("idx", vocabulary_.spaced(title).alias("t"), vocabulary_.spaced(abstract).alias("a"))
        met = texts.mapInArrow(runs_in, f"w string, place int, idx array<{items.schema['idx'].dataType.simpleString()}>").join(spoken, "w")
        f = F.when(F.col("place") == 0, F.lit(TITLE).cast("double")).otherwise(1.0)
        return _best(met.select(F.explode("idx").alias("idx"), "topic", "term", "strong", f.alias("f")))
    places = F.concat(F.transform("t", lambda w: F.struct(w.alias("w"), F.lit(TITLE).cast("double").alias("f"))), F.transform(F.array_except("a", "t"), lambda w: F.struct(w.alias("w"), F.lit(1.0).alias("f"))))
    met = hits.select("idx", F.explode(places).alias("p")).select("idx", "p.w", "p.f")  # a filter before would read the texts twice
    return _best(met.join(spoken, "w"))


def _best(met: DataFrame) -> DataFrame:
    return met.repartition("idx").groupBy("idx", "topic", "term", "strong").agg(F.max("f").alias("f"))


def topic_scores(items: DataFrame, terms: DataFrame, concepts: list[tuple[str, str]] = CONCEPTS, most: int = TERMS_IN_TASKS) -> DataFrame:
    """(idx, topic, score, strong): a term in the title counts once and a half, and then not in the abstract.

    Terms have any number of words; those within or across others count as well.
    """
    hits = _term_hits(items, terms, most)
    scored = hits.select("idx", "topic", (F.when(F.col("strong"), F.lit(STRONG)).otherwise(F.lit(WEAK)).cast("double") * F.col("f")).alias("p"), "strong")
    if concepts:
        named = items.sparkSession.createDataFrame(concepts, "topic string, concept string")
        extra = items.select("idx", F.explode("concepts").alias("concept")).distinct().join(F.broadcast(named), "concept").select("idx", "topic", F.lit(CONCEPT).cast("double").alias("p"), F.lit(True).alias("strong"))
        scored = scored.unionByName(extra)
    return scored.groupBy("idx", "topic").agg(F.round(F.sum("p"), 3).alias("score"), F.round(F.sum(F.when(F.col("strong"), F.col("p")).otherwise(0.0)), 3).alias("strong"))


def classified(scores: DataFrame, most: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(idx, topics, primary topic, relevance): at most ``most`` topics at or above the threshold, best first."""
    best = Window.partitionBy("idx").orderBy(F.desc("score"), "topic")
    top = scores.where(F.col("score") >= threshold).withColumn("k", F.row_number().over(best)).where(F.col("k") <= most)
    g = top.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("k", "topic"))).alias("t"), F.round(F.sum("score"), 3).alias("relevance"))
    return g.select("idx", F.col("t.topic").alias("topics"), F.get("t.topic", F.lit(0)).alias("topic"), "relevance")


def best_copies(items: DataFrame, key: str = "key") -> DataFrame:
    """(key, idx, sources, n_dropped) of one item per key: the one with a PDF, then the longest abstract, then the
    first; sources of all copies are named, the kept one's first, then the others in reading order.  Items without
    a key are nobody's copies and all stay."""
    rank = F.struct(F.col("has_pdf"), F.length(F.coalesce("abstract", F.lit(""))), -F.col("idx"))
    narrow = items.select(F.col(key).alias("key"), "idx", "source", rank.alias("rank"))  # texts stay where they are
    keyed, bare = narrow.where(F.coalesce("key", F.lit("")) != ""), narrow.where(F.coalesce("key", F.lit("")) == "")
    g = keyed.groupBy("key").agg(F.max_by(F.struct("idx", "source"), "rank").alias("best"), F.array_sort(F.collect_list(F.struct("idx", "source"))).alias("all"))
    others = F.filter("all", lambda x: x["idx"] != F.col("best.idx"))
    sources = F.concat_ws("+", F.array(F.col("best.source")), F.transform(others, lambda x: x["source"]))
    one = g.select("key", "best.idx", sources.alias("sources"), (F.size("all") - 1).alias("n_dropped"))
    return one.unionByName(bare.select("key", "idx", F.coalesce("source", F.lit("")).alias("sources"), F.lit(0).alias("n_dropped")))


def reasons(items: DataFrame, seen: DataFrame, topics: DataFrame, not_publications: list[str], noise: list[str], since: str) -> DataFrame:
    """(idx, reason): why an item is dropped, tested in a fixed order, or 'new'."""
    marked = items.join(seen.select("key").distinct().withColumn("was_seen", F.lit(True)), "key", "left").join(topics.select("idx", F.lit(True).alias("has_topic")), "idx", "left")
    early = (
        F.when(any_word(F.col("title"), not_publications), "not_publication")
        .when(any_word(F.col("title"), noise), "noise")
        .when((F.col("day") < F.lit(since).cast("date")) & ~F.col("is_book"), "out_of_window")
        .when(F.col("was_seen"), "seen")
    )
    placed = marked.select("idx", "key", early.alias("early"), "has_topic", F.struct(F.col("has_pdf"), F.length("abstract"), -F.col("idx")).alias("rank"))
    best = placed.where("early IS NULL").groupBy("key").agg(F.max_by("idx", "rank").alias("idx")).select("idx", F.lit(True).alias("is_best"))
    late = F.when(F.col("is_best").isNull(), "duplicate").when(F.col("has_topic").isNull(), "no_topic").otherwise("new")
    return placed.join(best, "idx", "left").select("idx", F.coalesce("early", late).alias("reason"))


def worth() -> Column:
    """What makes one copy better than another: PDF, kept abstract, whole abstract, relevance; the first on ties."""
    return F.struct(F.col("has_pdf"), F.least(F.length("abstract"), F.col("kept_chars")), F.length("abstract"), F.coalesce("relevance", F.lit(0.0)), -F.col("idx"))


def without_known(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Best copy per key, without keys that are known already; items without a key all stay."""
    keyed, bare = items.where(F.coalesce(F.col(key), F.lit("")) != ""), items.where(F.coalesce(F.col(key), F.lit("")) == "")
    fresh = keyed.join(known.select(key).distinct(), key, "left_anti").select(*items.columns)
    row = F.struct(*[F.col(c) for c in items.columns])
    return fresh.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, worth()).alias("row")).select("row.*").unionByName(bare)


def address_key(url: Column, url_pdf: Column, key: Column) -> Column:
    """What tells an item by its address: the page's, else the file's, without query and fragment; else its key."""

    def plain(address: Column) -> Column:
        return F.nullif(F.regexp_replace(F.lower(F.trim(address)), "[?#].*$", ""), F.lit(""))

    return F.coalesce(plain(url), plain(url_pdf), F.concat(F.lit("chiave:"), key))


def first_per(items: DataFrame, group: str, most: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return items.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")
