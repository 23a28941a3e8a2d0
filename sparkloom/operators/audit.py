"""Source quality: acceptance criteria, health, circuit breaker, change sets, installation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds of the acceptance criteria and of the breaker.
MOST_DAYS, SAMPLE, USEFUL, DISTINCT, PAYWALLS = 365, 10, 4, 0.8, 1
LEAST_SUMMARY = 500
BREAKER_NETWORK, BREAKER_FALL, BREAKER_LEAST = 0.4, 0.5, 5
ACCEPTED, TRANSIENT = "ACEPTADA", "TRANSITORIO"


def upper_median(values: Column) -> Column:
    """The middle element, the later of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def criteria(items: DataFrame, today: str, broken: DataFrame | None = None) -> DataFrame:
    """Per source, over its first ten items: the measurements and why it is not accepted.

    items: source, nth, day, useful, summary_chars, title_key, licensed, same_site, walled, is_pdf,
    reachable (whether the article itself could be read).  broken: (source, problem) of sources whose
    feed gave nothing and could not be mended; they have no measurements.
    """
    some = items.where(F.col("nth") <= SAMPLE)
    g = some.groupBy("source").agg(
        F.count("*").alias("n"),
        F.datediff(F.lit(today).cast("date"), F.max("day")).alias("days"),
        (F.max("day") == F.min_by("day", "nth")).alias("ordered"),
        F.count_if("useful").alias("useful"),
        upper_median(F.collect_list("summary_chars")).alias("median_chars"),
        F.count_distinct("title_key").alias("distinct_titles"),
        F.max("licensed").alias("licensed"),
        F.max("same_site").alias("same_site"),
        F.count_if(F.col("walled") & (F.col("nth") <= 3)).alias("walled"),
        F.count_if("is_pdf").alias("n_pdf"),
        F.count_if(F.col("reachable") & (F.col("nth") <= 3)).alias("reachable"),
    )
    tests = [
        ("p0 muerto", F.col("days") > MOST_DAYS),
        ("p2 orden", ~F.col("ordered")),
        ("p3 utiles", F.col("useful") < USEFUL),
        ("p6 duplicados", F.col("distinct_titles") < DISTINCT * F.col("n")),
        ("p7 sin licencia", ~F.col("licensed")),
        ("p8 canal", ~F.col("same_site")),
        ("p9 muro", F.col("walled") > PAYWALLS),
        ("p9 sin texto accesible", (F.col("reachable") == 0) & (F.col("median_chars") < LEAST_SUMMARY)),
    ]
    reason = F.concat_ws("; ", *(F.when(test, name) for name, test in tests))
    judged = g.withColumn("reason", F.when(reason == "", ACCEPTED).otherwise(reason))
    if broken is None:
        return judged
    down = broken.join(g.select("source"), "source", "left_anti").select("source", F.concat(F.lit("p1 roto ("), "problem", F.lit(")")).alias("reason"))
    return judged.unionByName(down, allowMissingColumns=True)


def tally(audit: DataFrame) -> DataFrame:
    """How often each reason was given."""
    reasons = F.explode(F.split("reason", "; ")).alias("why")
    return audit.where(F.col("reason") != ACCEPTED).select(reasons).groupBy("why").agg(F.count("*").alias("n"))


def health(audit: DataFrame, topic: str) -> DataFrame:
    return audit.groupBy(topic).agg(F.count_if(F.col("reason") == ACCEPTED).alias("accepted"), F.count("*").alias("candidates"), F.count_if(F.col("reason") != ACCEPTED).alias("to_review"))


#: What a reason says when it is the network's; how a licence begins that needs no page of the site.
NETWORK = r"HTTP 403|HTTP 5\d\d|status=None|anti-bot|URLError|timeout|NO_DESCARGADA|sin texto accesible|TRANSITORIO"
METADATA_ONLY = "solo metadati"


def breaker(audit: DataFrame, previous: int, previous_site: int = 0) -> DataFrame:
    """One row: whether a run looks like a broken network rather than broken sources.

    Too many network failures, or a fall of what is accepted: of all sources, or of those whose licence
    stands on their own pages (audit has a column licence), which fall alone when front pages do not answer.
    """

    def falls(before: int, now: str):
        return (F.lit(before) >= BREAKER_LEAST) & (F.col(now) < F.lit(before) * (1 - BREAKER_FALL))

    accepted = F.col("reason") == ACCEPTED
    of_site = accepted & ~F.coalesce(F.col("licence"), F.lit("")).startswith(METADATA_ONLY) if "licence" in audit.columns else accepted
    one = audit.agg(F.count("*").alias("n"), F.count_if(F.col("reason").rlike(NETWORK)).alias("network"), F.count_if(accepted).alias("accepted"), F.count_if(of_site).alias("accepted_site"))
    network = F.col("network") >= BREAKER_NETWORK * F.greatest(F.col("n"), F.lit(1))
    return one.withColumn("open", network | falls(previous, "accepted") | falls(previous_site, "accepted_site"))


def failures(before: DataFrame, now: DataFrame, most: int = 3) -> DataFrame:
    """Consecutive transient failures per source and whether it counts as down."""
    j = before.join(now, "source", "full").withColumn("failures", F.when(F.col("transient"), F.coalesce("failures", F.lit(0)) + 1).when(F.col("transient").isNull(), F.coalesce("failures", F.lit(0))).otherwise(0))
    return j.select("source", "failures", (F.col("failures") >= most).alias("down"))


def applied(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Sources (url, active, licence) after changes (seq, url, new_url, active, licence; null: no change).

    The last change of a source counts.  A rename to an address that exists already turns the old
    one off instead; of several renames to one new address the first by sequence gets it.
    """
    last = changes.groupBy("url").agg(F.max_by(F.struct("seq", "new_url", "active", "licence"), "seq").alias("c")).select("url", "c.*")
    first_claim = Window.partitionBy("new_url").orderBy("seq")
    last = last.withColumn("nth", F.when(F.col("new_url").isNotNull(), F.row_number().over(first_claim)))
    taken = sources.select(F.col("url").alias("new_url"), F.lit(True).alias("taken"))
    last = last.join(taken, "new_url", "left").withColumn("blocked", F.coalesce("taken", F.lit(False)) | (F.coalesce("nth", F.lit(1)) > 1))
    last = last.select("url", "new_url", F.col("active").alias("new_active"), F.col("licence").alias("new_licence"), F.col("blocked") & F.col("new_url").isNotNull())
    last = last.toDF("url", "new_url", "new_active", "new_licence", "blocked")
    j = sources.join(last, "url", "left")
    blocked = F.coalesce("blocked", F.lit(False))
    return j.select(
        F.when(~blocked, F.coalesce("new_url", "url")).otherwise(F.col("url")).alias("url"),
        F.when(blocked, False).otherwise(F.coalesce("new_active", "active")).alias("active"),
        F.coalesce("new_licence", "licence").alias("licence"),
    )


def installed(existing: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those of a template whose key is not there yet: running it twice adds nothing."""
    return existing.unionByName(template.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def proposed(existing: DataFrame, candidates: DataFrame, blocked: list[str]) -> DataFrame:
    """New sources: useful ones, unknown, not blocked; they start inactive with a low weight."""
    fresh = candidates.where((F.col("useful") >= USEFUL) & F.col("url").rlike("^https?://") & ~F.col("host").isin(*blocked))
    return fresh.dropDuplicates(["url"]).join(existing.select("url"), "url", "left_anti").select("url", "host", F.lit(0.3).cast("double").alias("weight"), F.lit(False).alias("active"))


def change_set(audit: DataFrame) -> DataFrame:
    """What an audit (url, new_url, reason, licence, measured) asks to change.

    A transient failure leaves activity and licence alone, a repair goes through all the same; a
    licence is written only if it was measured, then also when it is gone (an empty text).
    """
    settled = ~F.col("reason").startswith(TRANSIENT)
    rows = audit.select(
        "url",
        "new_url",
        F.when(F.col("new_url").startswith("sitemap:"), "sitemap").alias("method"),
        F.when(settled, F.col("reason") == ACCEPTED).alias("active"),
        F.when(settled & F.col("measured"), F.coalesce("licence", F.lit(""))).alias("licence"),
    )
    return rows.where("new_url IS NOT NULL OR active IS NOT NULL OR licence IS NOT NULL")


def podcasts(items: DataFrame, share: float = 0.5) -> DataFrame:
    """Sources of whose first ten items at least half carry audio or video (items: source, nth, media_type)."""
    media = F.coalesce(F.lower(F.trim("media_type")).rlike("^(audio|video)/"), F.lit(False))
    return items.where(F.col("nth") <= SAMPLE).groupBy("source").agg((F.count_if(media) >= share * F.count("*")).alias("is_podcast"))


def content_errors(cards: DataFrame, rubrics: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, error) of study content: cards(id, answer, source, reference), rubrics(id, criteria), sources(name, method, weight)."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    card = cards.select("id", F.array_compact(F.array(F.when(empty("source") | empty("reference"), "no source"), F.when(F.length(F.coalesce("answer", F.lit(""))) < 40, "answer too short"))).alias("e"))
    twice = cards.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.array(F.lit("duplicate id")).alias("e"))
    rubric = rubrics.where(F.coalesce(F.size("criteria"), F.lit(0)) < 4).select("id", F.array(F.lit("fewer than four criteria")).alias("e"))
    source = sources.select(F.col("name").alias("id"), F.array_compact(F.array(F.when(~F.col("method").isin("rss", "scrape", "api", "email"), "unknown method"), F.when(~F.col("weight").between(0, 1), "weight out of range"))).alias("e"))
    same = sources.groupBy(F.col("name").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.array(F.lit("duplicate source")).alias("e"))
    whole = card.unionByName(twice).unionByName(rubric).unionByName(source).unionByName(same)
    return whole.select("id", F.explode("e").alias("error"))
