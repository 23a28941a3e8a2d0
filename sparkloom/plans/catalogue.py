"""Catalogue queries: filter ladder, classification, de-duplication, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text, urls
from sparkloom.operators import catalogue as c
from sparkloom.plans.registry import query
from sparkloom.tables import Tables, spread

_WORDS = "list_distinct(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))"
ITEMS = f"""raw AS (SELECT *, string_split(text, chr(10))[1] AS title FROM documents),
items AS (SELECT doc_id AS idx, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 120) AS key, title, substr(text, length(title) + 2, 4000) AS abstract, lang, source, n_chars,
DATE '2024-01-01' + (doc_id % 400)::INT AS day, doc_id % 3 = 0 AS has_pdf, doc_id % 17 = 0 AS is_book FROM raw),
tokens AS (SELECT idx, {_WORDS.format("title")} AS tw, {_WORDS.format("coalesce(abstract, '')")} AS aw FROM items)"""
_VALUES = ", ".join(f"('{a}', '{b}', {str(t == 'strong').upper()})" for a, b, t in c.VOCABULARY)
_NAMED = ", ".join(f"('{a}', '{b}')" for a, b in c.CONCEPTS)
SCORES = f"""{ITEMS}, vocabulary(topic, term, strong) AS (VALUES {_VALUES}), named(topic, concept) AS (VALUES {_NAMED}),
hits AS (SELECT idx, w AS term, 1.5::DOUBLE AS f FROM (SELECT idx, unnest(tw) AS w FROM tokens) UNION ALL SELECT idx, w, 1.0 FROM (SELECT idx, unnest(aw) AS w, tw FROM tokens) WHERE NOT list_contains(tw, w)),
points AS (SELECT idx, topic, CASE WHEN strong THEN f ELSE 0.4 * f END AS p, strong FROM hits JOIN vocabulary USING (term) UNION ALL SELECT idx, topic, 1.2, TRUE FROM items JOIN named ON concept = lang),
scores AS (SELECT idx, topic, round(sum(p), 3)::DOUBLE AS score, round(coalesce(sum(p) FILTER (WHERE strong), 0), 3)::DOUBLE AS strong FROM points GROUP BY 1, 2)"""
CLASSIFIED = f"""{SCORES}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, topic) AS k FROM scores WHERE score >= 1.0) WHERE k <= 2),
classified AS (SELECT idx, string_agg(topic, ',' ORDER BY k) AS topics, max(CASE WHEN k = 1 THEN topic END) AS topic, round(sum(score), 3)::DOUBLE AS relevance FROM top GROUP BY 1)"""


def items(t: Tables, most: int | None = c.MOST_ABSTRACT) -> DataFrame:
    return c.items_of_documents(spread(t.documents), most)


def scores(t: Tables) -> DataFrame:
    return c.topic_scores(items(t), c.vocabulary(t.spark))


def classified(t: Tables) -> DataFrame:
    return c.classified(scores(t))


@query(f"WITH {ITEMS} SELECT idx, key, title, length(abstract) AS n_abstract, day FROM items")
def item_normaliser(t: Tables) -> DataFrame:
    return items(t).select("idx", "key", "title", F.length("abstract").cast("bigint").alias("n_abstract"), "day")


@query(f"WITH {SCORES} SELECT idx, topic, score, strong FROM scores")
def topic_scores(t: Tables) -> DataFrame:
    return scores(t)


@query(f"WITH {CLASSIFIED} SELECT * FROM classified")
def classify_top2(t: Tables) -> DataFrame:
    return classified(t).withColumn("topics", F.array_join("topics", ","))


@query(f"WITH {SCORES} SELECT topic, count(*) AS n FROM scores WHERE strong = 0 GROUP BY 1")
def weak_only_topics(t: Tables) -> DataFrame:
    """Topics that an item has by weak terms alone."""
    return scores(t).where("strong = 0").groupBy("topic").agg(F.count("*").alias("n"))


@query(f"""WITH {CLASSIFIED}, seen AS (SELECT DISTINCT key FROM items WHERE idx % 29 = 0),
early AS (SELECT i.*, cl.topic, CASE WHEN list_has_any(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{{L}}\\p{{N}}_]+'), ['was', 'pour']) OR regexp_matches(strip_accents(lower(title)), '\\b({"|".join(c.NOT_PUBLICATIONS)})\\b') THEN 'not_publication'
WHEN list_has_any(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{{L}}\\p{{N}}_]+'), ['that', 'nicht']) OR regexp_matches(strip_accents(lower(title)), '\\b({"|".join(c.NOISE)})\\b') THEN 'noise' WHEN day < DATE '2024-03-01' AND NOT is_book THEN 'out_of_window'
WHEN s.key IS NOT NULL THEN 'seen' END AS early FROM items i LEFT JOIN seen s ON s.key = i.key LEFT JOIN classified cl ON cl.idx = i.idx),
placed AS (SELECT *, row_number() OVER (PARTITION BY key, early IS NULL ORDER BY has_pdf DESC, length(abstract) DESC, idx) AS nth FROM early)
SELECT coalesce(early, CASE WHEN nth > 1 THEN 'duplicate' WHEN topic IS NULL THEN 'no_topic' ELSE 'new' END) AS reason, count(*) AS n FROM placed GROUP BY 1""")
def reason_ladder(t: Tables) -> DataFrame:
    i = items(t)
    seen = i.where("idx % 29 = 0").select("key")
    found = c.reasons(i, seen, classified(t), [*c.NOT_PUBLICATIONS, "was", "pour"], [*c.NOISE, "that", "nicht"], "2024-03-01")
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY has_pdf DESC, length(abstract) DESC, idx) AS nth FROM items WHERE key <> ''),
k AS (SELECT key, max(CASE WHEN nth = 1 THEN idx END) AS idx, max(CASE WHEN nth = 1 THEN source END) AS first, count(*) - 1 AS n_dropped, string_agg(source, '+' ORDER BY idx) FILTER (WHERE nth > 1) AS others FROM r GROUP BY 1)
SELECT key, idx, n_dropped, first || coalesce('+' || others, '') AS sources FROM k UNION ALL SELECT key, idx, 0, source FROM items WHERE key = ''""")
def dedup_best_copy(t: Tables) -> DataFrame:
    return c.best_copies(items(t)).select("key", "idx", F.col("n_dropped").cast("bigint").alias("n_dropped"), "sources")


@query(f"WITH {CLASSIFIED} SELECT idx, relevance, round_even(100.0 * relevance / (relevance + 5), 0)::INT AS grade FROM classified")
def grade_curve(t: Tables) -> DataFrame:
    return classified(t).select("idx", "relevance", text.grade(F.col("relevance")).alias("grade"))


def worthy(t: Tables) -> DataFrame:
    """Items with what ranks copies: kept abstract length (500 for metadata-only sources) and relevance."""
    kept = F.when(F.col("source").isin("src1", "src2"), 500).otherwise(c.MOST_ABSTRACT)
    return items(t).join(classified(t).select("idx", "topic", "relevance"), "idx", "left").withColumn("kept_chars", kept)


_WORTH = "ORDER BY has_pdf DESC, least(length(abstract), CASE WHEN source IN ('src1', 'src2') THEN 500 ELSE 4000 END) DESC, length(abstract) DESC, coalesce(relevance, 0) DESC, i.idx"


@query(f"""WITH {CLASSIFIED}, known AS (SELECT DISTINCT key FROM items WHERE idx % 31 = 0 AND key <> ''),
r AS (SELECT i.idx, i.key, row_number() OVER (PARTITION BY i.key {_WORTH}) AS nth FROM items i LEFT JOIN classified cl ON cl.idx = i.idx WHERE i.key NOT IN (SELECT key FROM known))
SELECT idx FROM r WHERE nth = 1 OR key = ''""")
def dedup_title(t: Tables) -> DataFrame:
    i = worthy(t)
    return c.without_known(i, items(t).where("idx % 31 = 0"), "key").select("idx")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'files/' || page_id // 10 || '.pdf' WHEN 1 THEN 'chiave:k' || page_id // 10 ELSE regexp_replace(lower(url), '[?#].*$', '') END AS u, length(html) AS n FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, page_id) AS nth FROM p) SELECT page_id, u FROM r WHERE nth = 1""")
def dedup_url(t: Tables) -> DataFrame:
    """The longest page per address without query and fragment; where a page has none, per file or key.  Only lengths
    go through the shuffle."""
    k, ten = F.pmod("page_id", F.lit(5)), F.floor(F.col("page_id") / 10).cast("string")
    address = c.address_key(F.when(k > 1, F.col("url")).when(k == 1, ""), F.when(k == 0, F.concat(F.lit("FILES/"), ten, F.lit(".pdf#page=2"))), F.concat(F.lit("k"), ten))
    p = t.pages.select("page_id", address.alias("u"), F.length("html").alias("n"))
    return p.groupBy("u").agg(F.max_by("page_id", F.struct(F.col("n"), -F.col("page_id"))).alias("page_id")).select("page_id", "u")


@query(f"""WITH {SCORES}, known AS (SELECT idx FROM (SELECT idx, topic, sum(CASE WHEN strong THEN f ELSE 0.4 * f END) AS s FROM hits JOIN vocabulary USING (term) GROUP BY 1, 2) WHERE round(s, 3) >= 2.8)
SELECT idx FROM items WHERE idx NOT IN (SELECT idx FROM known) AND (n_chars >= 1500 OR regexp_matches(strip_accents(lower(title)), '\\b({"|".join(c.SIGNALS)})\\b')) ORDER BY idx LIMIT 5""")
def exploration_quota(t: Tables) -> DataFrame:
    """Long items, or with a phrase that promises a good piece, whose words alone settle no topic: a handful a run,
    by reading order."""
    known = c.topic_scores(items(t), c.vocabulary(t.spark), []).where("score >= 2.8D").select("idx")
    promising = c.any_word(F.substring_index("text", "\n", 1), c.SIGNALS)
    long = t.documents.where((F.col("n_chars") >= c.EXPLORED_CHARS) | promising).select(F.col("doc_id").alias("idx"))
    return long.join(known, "idx", "left_anti").orderBy("idx").limit(c.EXPLORED)


@query(f"WITH {ITEMS} SELECT idx, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC, idx) AS k FROM items) WHERE k <= 12")
def per_source_cap(t: Tables) -> DataFrame:
    return c.first_per(items(t).select("idx", "source", "day"), "source", c.PER_SOURCE, F.desc("day"), "idx").select("idx", "source")


@query(f"WITH {CLASSIFIED} SELECT i.idx, relevance FROM items i JOIN classified cl ON cl.idx = i.idx ORDER BY relevance DESC, day DESC, key, i.idx LIMIT 80")
def daily_cap(t: Tables) -> DataFrame:
    """The day's best eighty: newest first among equals."""
    ranked = items(t).select("idx", "key", "day").join(classified(t).select("idx", "relevance"), "idx")
    return ranked.orderBy(F.desc("relevance"), F.desc("day"), "key", "idx").limit(c.PER_DAY).select("idx", "relevance")


@query(f"WITH {CLASSIFIED} SELECT idx, CASE WHEN topic = 'german' THEN round(relevance * 1.2, 3) ELSE relevance END AS boosted FROM classified")
def category_boost(t: Tables) -> DataFrame:
    hit = F.array_contains("topics", "german") & (F.col("topic") == "german")
    return classified(t).select("idx", F.when(hit, F.round(F.col("relevance") * c.BOOST, 3)).otherwise(F.col("relevance")).alias("boosted"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, CASE WHEN url LIKE 'https:%' THEN 5 WHEN url LIKE '%?%' THEN 1 ELSE 3 END AS quality FROM pages)
SELECT host, arg_max(page_id, (quality, -page_id)) AS page_id, max(quality)::INT AS quality FROM h GROUP BY 1""")
def access_best(t: Tables) -> DataFrame:
    """Best way to each host by the quality of access."""
    quality = F.when(F.col("url").like("https:%"), 5).when(F.col("url").like("%?%"), 1).otherwise(3)
    p = t.pages.select("page_id", urls.host(F.col("url")).alias("host"), quality.alias("quality"))
    return p.groupBy("host").agg(F.max_by("page_id", F.struct(F.col("quality"), -F.col("page_id"))).alias("page_id"), F.max("quality").alias("quality"))


@query("SELECT source, round(avg(n_chars), 2) AS weight, count(*) AS n FROM documents GROUP BY 1 ORDER BY weight DESC, source LIMIT 200")
def source_order(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.round(F.avg("n_chars"), 2).alias("weight"), F.count("*").alias("n"))
    return g.orderBy(F.desc("weight"), "source").limit(200)


@query("""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1)
SELECT doc_id, CASE WHEN length(transcript) >= 400 THEN 'transcript' WHEN length(text) >= 400 THEN 'page' ELSE 'none' END AS origin,
length(CASE WHEN length(transcript) >= 400 THEN transcript WHEN length(text) >= 400 THEN text END) AS n FROM documents LEFT JOIN c ON conv_id = doc_id""")
def text_choice(t: Tables) -> DataFrame:
    """The first text of an ordered chain that is long enough."""
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    talk = turns.select("doc_id", F.array_join("x.text", "\n\n").alias("transcript"))
    j = t.documents.select("doc_id", "text").join(talk, "doc_id", "left")
    good = F.when(F.length("transcript") >= 400, "transcript").when(F.length("text") >= 400, "page").otherwise("none")
    size = F.when(F.length("transcript") >= 400, F.length("transcript")).when(F.length("text") >= 400, F.length("text"))
    return j.select("doc_id", good.alias("origin"), size.cast("bigint").alias("n"))


@query("SELECT d.doc_id, length(p.html) AS n FROM documents d JOIN pages p ON 'RAS-' || substr(sha1(d.doc_id::VARCHAR), 1, 16) = 'RAS-' || substr(sha1((p.page_id * 3)::VARCHAR), 1, 16) WHERE d.n_chars < 2000")
def text_backfill(t: Tables) -> DataFrame:
    """Items without a text get that of a volume with the same hashed code."""
    d = t.documents.where("n_chars < 2000").select("doc_id", text.hashed_id(F.col("doc_id").cast("string")).alias("code"))
    p = t.pages.select(text.hashed_id((F.col("page_id") * 3).cast("string")).alias("code"), F.length("html").cast("bigint").alias("n"))
    return d.join(p, "code").select("doc_id", "n")


@query(f"WITH {CLASSIFIED} SELECT count(*) AS n_items, count(cl.idx) AS n_classified, count(DISTINCT key) AS n_keys, count(*) FILTER (WHERE has_pdf) AS n_pdf FROM items i LEFT JOIN classified cl ON cl.idx = i.idx")
def run_report(t: Tables) -> DataFrame:
    j = items(t).select("idx", "key", "has_pdf").join(classified(t).select("idx", F.lit(1).alias("hit")), "idx", "left")
    return j.agg(F.count("*").alias("n_items"), F.count("hit").alias("n_classified"), F.count_distinct("key").alias("n_keys"), F.count_if("has_pdf").alias("n_pdf"))


@query("SELECT d.doc_id, CASE WHEN n_chars > 500 THEN substr(text, 1, 500) ELSE text END AS summary, array_to_string([lang, source], '; ') AS authors FROM documents d")
def row_shaping(t: Tables) -> DataFrame:
    """A publishable row: bounded summary, authors as text."""
    return t.documents.select("doc_id", F.when(F.col("n_chars") > 500, F.substring("text", 1, 500)).otherwise(F.col("text")).alias("summary"), F.array_join(F.array("lang", "source"), "; ").alias("authors"))


@query("SELECT source, lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1, 2")
def anti_join_state(t: Tables) -> DataFrame:
    """What the state table has not seen yet, by source."""
    return t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy("source", "lang").agg(F.count("*").alias("n"))
