"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

The texts are read once.  That writes, for every document, its number of terms and its class, and for every document and
every term of the queries a posting.  A class is all documents that hold the queries' terms equally often among equally
many terms (copies, first of all): they have one score for any item.  Its name is a hash of 128 bits of just that.  With
the number of documents of each term these give the weights, and a posting for each term and class is written with its
impact, partitioned by term (lists of more than ``LIST`` postings in several parts, so that a common term is many tasks'
work).  The three phases see classes alone, so a group of copies of any size is one entry of a list.

1. Each list sends its ``k`` highest entries.  Their sums per item and class are lower bounds of scores; the k-th best
   of an item is t.
2. The threshold of an item is t divided by the number of its lists, the same for all of them.  Each list sends its
   entries that reach the lowest threshold of an item that asks for it, once, to the task that gathers their class,
   which adds them up for all items that ask for the list.  A list tells the best entry it has not sent, if there is one;
   that bounds the scores from above.  A task hands on, for each item, the classes whose
   upper bound reaches the k-th lower bound it has seen.  The k-th best lower bound of all tasks decides the candidates:
   no class that could rank is lost, ties included.
3. Candidates' entries are looked up in all lists; of each class its ``k`` smallest doc_ids are ranked by their score.

Queries go in batches of about ``PAIRS`` (item, term) pairs, whose thresholds the tasks hold.  The queries' terms are
sent to the tasks that read texts if there are at most ``TERMS`` of them; otherwise postings of all terms are joined
with them.

Rows that share a doc_id are documents of their own; a null doc_id is ranked after all others of equal score.  Null and
empty texts have no terms and do not count.  Rows of queries that share an item_id are one query; a null text has no
terms, and an item without a match gives no row.  Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from sparkloom.llm.common import documents, id_and_text, pieces, shuffle_width, text_bytes, written

TOP = 10
TERMS, PAIRS = 200_000, 500_000
LIST = 25_000
CELLS = 1 << 20  # items times documents that a task sums at once
HELD = 200_000  # pairs that a task holds before it hands some on
B = 75  # percent of the weight that a document's length has
#: Bytes of terms keep their place (A-Z in lower case), all others become blanks.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
POSTINGS = "term string, row long, row2 long, doc_id long, tf long, n long"
CLASS = ["row", "row2"]


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def raw_postings(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """Postings (term, row, row2, null, tf, n) of the wanted terms (None: of all); a row of a null term for each document with terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  pa.compute

        for batch in batches:
            for part in pieces(batch, 4 << 20):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
                    if found := terms(text):
                        counts, n = sorted(Counter(found if wanted is None else [w for w in found if w in wanted]).items()), len(found)
                        row = struct.unpack("<qq", hashlib.blake2b(b"%d" % n + b"".join(b" %b %d" % c for c in counts), digest_size=16).digest())
                        out.append((None, *row, doc, 1, n))
                        out += [(w, *row, None, tf, n) for w, tf in counts]
                for a in range(0, len(out), 50_000):
                    w, *numbers = zip(*out[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in numbers)], names=["term", "row", "row2", "doc_id", "tf", "n"])

    return id_and_text(docs).mapInArrow(run, POSTINGS)


@F.arrow_udf(ArrayType(StringType()))
def term_array(text: pa.Array) -> pa.Array:
    return pa.array([[w.decode() for w in terms(t or b"")] for t in text_bytes(text)], pa.list_(pa.string()))


def weighted(postings: DataFrame, terms_of: DataFrame, width: int, part: int = LIST) -> DataFrame:
    """(term, row, row2, impact) of raw postings, partitioned by term: what one occurrence of the term in a query is worth."""
    n_docs, n_terms = postings.where("term IS NULL").agg(F.sum("tf"), F.sum("n")).first()
    n_docs, n_terms = n_docs or 0, max(n_terms or 0, 1)
    own = postings.where("term IS NOT NULL").join(terms_of.select("term").distinct(), "term", "left_semi")
    frequency = own.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    lists = frequency.select("term", weight.alias("w"), F.ceil(F.col("df") / part).alias("parts"))
    dealt = own.join(lists, "term").select("term", F.pmod("row", "parts").alias("part"), *CLASS, "tf", "n", "w").repartition(width, "term", "part")
    once = dealt.groupBy("term", "part", *CLASS).agg(F.first("tf").alias("tf"), F.first("n").alias("n"), F.first("w").alias("w"))
    m = F.lit(100 - B) + F.expr(f"({B} * n * {n_docs}L) div {n_terms}L")
    impact = F.col("w") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")
    scored = once.withColumn("m", m).select("term", *CLASS, impact.alias("impact"))
    return written(scored.where("impact > 0"), "postings")


@dataclass
class Plan:
    """A batch of queries: its terms, and the pairs of an item and a term in the order of the terms.

    ``begins[t]`` to ``begins[t + 1]`` are the pairs of term t, with their item, times, and ``unseen``, the most that
    the item may miss there.  The list of term t sends impacts of at least ``lowest[t]``; ``kth`` is the items' first
    lower bound of the k-th score.
    """

    items: list
    terms: list[str]
    begins: np.ndarray
    item: np.ndarray
    times: np.ndarray
    unseen: np.ndarray
    lowest: np.ndarray
    kth: np.ndarray

    @staticmethod
    def of(pairs: list, firsts: dict) -> Plan:
        """From (item_id, term, times) and the items' first bounds."""
        items, terms_ = sorted({p.item_id for p in pairs}, key=repr), sorted({p.term for p in pairs})
        number, place = {x: k for k, x in enumerate(items)}, {x: k for k, x in enumerate(terms_)}
        rows = np.array([(place[p.term], number[p.item_id], p.times) for p in pairs], np.int64).reshape(-1, 3)
        term, item, times = rows[np.argsort(rows[:, 0], kind="stable")].T
        kth = np.array([firsts.get(x, 0) for x in items], np.int64)
        lists = np.bincount(item, minlength=len(items))
        least = np.maximum(1, -(-kth // np.maximum(lists, 1)))
        begins = np.searchsorted(term, np.arange(len(terms_) + 1))
        lowest = np.minimum.reduceat(-(-least[item] // times), begins[:-1]) if len(terms_) else np.empty(0, np.int64)
        return Plan(items, terms_, begins, item, times, times * (lowest[term] - 1), lowest, kth)

    def told(self, rests: dict[str, int]) -> Plan:
        """With the best entries that the lists have not sent, by term; lists without one have sent all."""
        rest = np.array([rests.get(t, 0) for t in self.terms], np.int64)
        return replace(self, unseen=self.times * np.repeat(rest, np.diff(self.begins)))

    def gathered(self, k: int):
        """Entries (tid, row, row2, impact) sorted by class -> (nth, row, row2, low, high): the bounds of pairs that may rank."""
        total = np.bincount(self.item, weights=self.unseen, minlength=len(self.items)).astype(np.int64)
        step = max(1, CELLS // max(1, len(self.items)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros((len(self.items), k), np.int64)
            held: list[np.ndarray] = []

            def add(tid: np.ndarray, row: np.ndarray, row2: np.ndarray, impact: np.ndarray) -> None:
                nonlocal best
                new = np.append(True, (row[1:] != row[:-1]) | (row2[1:] != row2[:-1]))
                column, own, own2 = np.cumsum(new) - 1, row[new], row2[new]
                n = self.begins[tid + 1] - self.begins[tid]
                entry = np.repeat(np.arange(len(tid)), n)
                pair = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + self.begins[tid][entry]
                cell = self.item[pair] * len(own) + column[entry]
                low = np.zeros(len(self.items) * len(own), np.int64)
                spared = low.copy()
                np.add.at(low, cell, self.times[pair] * impact[entry])
                np.add.at(spared, cell, self.unseen[pair])
                low, spared = low.reshape(len(self.items), -1), spared.reshape(len(self.items), -1)
                best = np.sort(np.concatenate([best, low], axis=1), axis=1)[:, -k:]
                high = low + total[:, None] - spared
                i, j = np.nonzero((low > 0) & (high >= np.maximum(best[:, :1], self.kth[:, None])))
                held.append(np.stack([i, own[j], own2[j], low[i, j], high[i, j]]))

            def open_() -> np.ndarray:
                rows = np.concatenate([np.empty((5, 0), np.int64), *held], axis=1)
                held[:] = [rows[:, rows[4] >= best[rows[0], 0]]]
                return held[0]

            def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
                for a in range(0, rows.shape[1], 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, a : a + 50_000]], names=["nth", "row", "row2", "low", "high"])

            rest = np.empty((4, 0), np.int64)
            for batch in batches:
                rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])], axis=1)
                starts = np.flatnonzero(np.append(True, (rest[1:3, 1:] != rest[1:3, :-1]).any(0))) if rest.shape[1] else []
                while len(starts) > step:  # the last class may go on in the next batch
                    add(*rest[:, : starts[step]])
                    rest, starts = rest[:, starts[step] :], starts[step:] - starts[step]
                if sum(x.shape[1] for x in held) > HELD and open_().shape[1] > HELD // 2:
                    yield from out(held.pop())
            if rest.shape[1]:
                add(*rest)
            yield from out(open_())

        return run


def search(queries: DataFrame, docs: DataFrame, k: int = TOP, most_terms: int = TERMS, part: int = LIST, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score) of queries (item_id, text) over docs; see the module."""
    asked = queries.select(F.col("item_id"), F.explode(term_array(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term"))
    asked = written(asked.groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    few = asked.select("term").distinct().limit(most_terms + 1).collect()  # bounded: beyond that many terms, a join
    wanted = frozenset(r.term.encode() for r in few) if len(few) <= most_terms else None
    raw = written(raw_postings(docs, wanted), "raw")
    postings = weighted(raw, asked, shuffle_width(docs.sparkSession), part)
    members = raw.where("term IS NULL").select(*CLASS, "doc_id")
    by_impact = Window.partitionBy("term").orderBy(F.desc("impact"), *CLASS)
    heads = written(postings.withColumn("nth", F.row_number().over(by_impact)).where(F.col("nth") <= k), "heads")
    batches = max(1, -(-asked.count() // pairs))
    parts = [_ranked(postings, members, heads, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b), k) for b in range(batches)]
    return reduce(DataFrame.unionByName, parts)


def _ranked(postings: DataFrame, members: DataFrame, heads: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The results of one batch of queries."""
    spark, width, worth = postings.sparkSession, shuffle_width(postings.sparkSession), F.col("times") * F.col("impact")
    lists = written(asked.join(heads.select("term").distinct(), "term", "left_semi"), "lists")  # lists without a posting are gone
    sums = heads.join(lists, "term").groupBy("item_id", *CLASS).agg(F.sum(worth).alias("low"))
    plan = Plan.of(lists.collect(), {r.item_id: r.kth for r in _kth(sums, k).collect()})  # a batch's pairs and items
    if not plan.items:
        return lists.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))

    lowest = spark.createDataFrame(list(zip(plan.terms, range(len(plan.terms)), plan.lowest.tolist())), "term string, tid int, lowest long")
    entries = postings.join(lowest, "term")
    plan = plan.told({r.term: r.rest for r in entries.where("impact < lowest").groupBy("term").agg(F.max("impact").alias("rest")).collect()})  # a row per list
    sent = entries.where("impact >= lowest").select("tid", *CLASS, "impact")
    bounds = sent.repartition(width, *CLASS).sortWithinPartitions(*CLASS).mapInArrow(plan.gathered(k), "nth long, row long, row2 long, low long, high long")
    names = spark.createDataFrame(list(enumerate(plan.items)), f"nth long, item_id {asked.schema['item_id'].dataType.simpleString()}")
    bounds = written(bounds.join(names, "nth"), "bounds")
    candidates = bounds.join(_kth(bounds, k), "item_id", "left").where("high >= coalesce(kth, 0)").select("item_id", *CLASS)

    candidates = written(candidates, "candidates")
    classes = written(candidates.select(*CLASS).distinct(), "classes")
    entries = postings.join(classes, CLASS, "left_semi").join(lists, "term").join(candidates, ["item_id", *CLASS])
    exact = entries.groupBy("item_id", *CLASS).agg(F.sum(worth).alias("score"))
    by_id = Window.partitionBy(*CLASS).orderBy(F.asc_nulls_last("doc_id"))
    first = members.join(classes, CLASS, "left_semi").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = exact.join(first, CLASS).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item_id, kth): the k-th highest low of each item; items with fewer are missing, as any score may rank."""
    order = Window.partitionBy("item_id").orderBy(F.desc("low"), *CLASS)
    return sums.withColumn("nth_low", F.row_number().over(order)).where(F.col("nth_low") <= k).where(F.col("nth_low") == k).select("item_id", F.col("low").alias("kth"))


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS nd, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
c AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))) AS score FROM p JOIN w USING (term), s),
t AS (SELECT item_id, k, any_value(doc_id) AS doc_id, sum(score)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY item_id, k HAVING sum(score) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, k))::INTEGER AS rank, doc_id, score FROM t
QUALIFY rank <= 10
"""
