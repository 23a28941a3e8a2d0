"""Hard negatives from k-means inverted lists with stored radii.

1. Centroids are fitted on at most ``SAMPLE`` rows (those of the smallest hash of their id) and at most
   ``SAMPLE_NUMBERS`` components.  Every row goes to the list of its nearest centroid, and each list stores its
   radius, the largest distance from the centroid to a row.  A list is kept in blocks of about ``BLOCK`` rows, dealt
   by id, so that a list with a third of all rows is many tasks' work.
2. A search knows, for an anchor q and a list with centroid c and radius r, that all scores lie within
   q.c - |q| r and q.c + |q| r (Cauchy-Schwarz).  It visits the lists in the order of their upper bounds, in rounds of
   ``FIRST`` lists and then ``GROWTH`` times as many as before; lists outside the window of scores are skipped, and an
   anchor stops when the next bound lies strictly below its k-th best score.  As equal scores are still visited, ties
   by id are exact.  A round moves anchors and list rows to a task per block; a block's rows are scored there as one
   product of matrices, so a task holds a block and a batch of anchors however large the list is.
3. Positives are one search (rows of the anchor's label, no window), negatives a second one (rows of other labels) with
   a window for each positive.

Scores are integer inner products: in doubles while they are exact, in 64-bit integers beyond.  Bounds leave a margin
for their own rounding.  The index holds every row, and the result is exact: recall is 1.

Rows without id, label or vector, or with a null or non-finite component, take no part.  Vectors shorter than the
longest count as padded with zeros.  Of rows that share an id the one of the smallest (label, vector) takes part.
Anchors without positives, and positives without a negative in their window, give no rows; an empty table gives none.
Columns other than the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import shuffle_width, written
from sparkloom.tables import spread

SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 21
LISTS, STEPS = 256, 8
BLOCK, ANCHORS = 4096, 256
FIRST, GROWTH = 4, 4
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)
ROWS = "list int, block int, asks int, id long, label int, vector binary, lo array<long>, hi array<long>"
FOUND = "anchor long, w int, id long, score long"


@dataclass
class Index:
    """Centroids (float64), the lists' radii and numbers of blocks, the vectors' length and stored type."""

    centroids: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray
    kind: str

    def unpacked(self, vectors: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(vectors), self.kind).reshape(len(vectors), -1)

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of each vector with the rows of each list."""
        q = vectors.astype(np.float64)
        middle, length = q @ self.centroids.T, np.sqrt((q * q).sum(1))[:, None]
        reach = length * self.radii
        margin = 1e-9 * (reach + length * np.sqrt((self.centroids**2).sum(1))) + 1e-6
        return middle - reach - margin, middle + reach + margin


def entrants(table: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v): the rows that take part, v as floor(256 * x)."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("id"), label.cast("int").alias("label"), F.when(finite, F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")))).alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def k_means(sample: np.ndarray, lists: int, steps: int = STEPS) -> np.ndarray:
    """Centroids after some steps from distinct rows, spread over the sample."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(lists, len(distinct))).astype(int)]
    for _ in range(steps):
        near = _nearest(sample, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    near = ((centroids**2).sum(1) - 2 * (rows @ centroids.T)).argmin(1)
    return near, np.sqrt(((rows - centroids[near]) ** 2).sum(1))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """A list column as rows of ``dim`` numbers, padded with zeros."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(pc.list_value_length(column), np.int64))
    size = np.diff(np.append(0, ends))
    out = np.zeros((len(column), dim), kind)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(ends - size, size)] = values
    return out


def build(rows: DataFrame, lists: int = LISTS, block: int = BLOCK, sample: int = SAMPLE) -> tuple[Index, DataFrame]:
    """The index over (id, label, v), and all rows as (list, block, id, label, vector)."""
    spark = rows.sparkSession
    rows = written(rows, "entrants")
    n, dim, high, low = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    dim, most = max(dim or 0, 1), max(high or 0, -(low or 0))
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
    taken = rows.select("id", "v", F.xxhash64("id").alias("by")).orderBy("by", "id").limit(max(1, min(sample, SAMPLE_NUMBERS // dim)))
    drawn = np.zeros((0, dim))
    if n:
        drawn = _matrix(pa.array(taken.toArrow().column("v").combine_chunks()), dim, "int64").astype(np.float64)
    centroids = k_means(drawn, min(lists, max(1, int(n**0.5)))) if n else np.zeros((1, dim))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), dim, kind)
                near, far = _nearest(x.astype(np.float64), centroids)
                vectors = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1), vectors, pa.array(far)], names=["list", "id", "label", "vector", "far"])

    assigned = written(rows.select("id", "label", "v").mapInArrow(assign, "list int, id long, label int, vector binary, far double"), "lists")
    blocks, radii = np.ones(len(centroids), np.int64), np.zeros(len(centroids))
    for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row per list
        blocks[r.list], radii[r.list] = max(1, round(r.n / block)), r.far * (1 + 1e-9)
    counts = spark.createDataFrame(list(enumerate(blocks.tolist())), "list int, blocks long")
    dealt = assigned.join(F.broadcast(counts), "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "label", "vector")
    return Index(centroids, radii, blocks, kind), dealt


def _visits(index: Index, first: int, last: int):
    """(id, label, vector, lo, hi, kth) -> a row for each block of the lists that come first to last in the order of an anchor's bounds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                yield from visit(batch.slice(a, 1024))

    def visit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lower, upper = index.bounds(index.unpacked(batch.column(2).to_pylist()))
        los, his, kths = (batch.column(k).to_pylist() for k in (3, 4, 5))
        asks, lists, lo = [], [], []
        for i in range(batch.num_rows):
            least = [max(a, LOW if b is None else b) for a, b in zip(los[i], kths[i])]
            inside = np.flatnonzero(lower[i] <= max(his[i]))  # lists wholly above the window are skipped
            order = inside[np.argsort(-upper[i, inside], kind="stable")][first:last]
            order = order[upper[i, order] >= min(least)]  # the bounds fall: from here on all are strictly below
            asks += [i] * len(order)
            lists += order.tolist()
            lo += [least] * len(order)
        if not asks:
            return
        n = index.blocks[lists]
        owner = np.repeat(np.arange(len(asks)), n)
        block = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = pa.array(np.array(asks)[owner])
        cols = [np.array(lists, np.int32)[owner], block.astype(np.int32), np.ones(len(owner), np.int32)]
        lows = pa.array(lo, pa.list_(pa.int64())).take(pa.array(owner))
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *(batch.column(k).take(at) for k in (0, 1, 2)), lows, batch.column(4).take(at)], names=["list", "block", "asks", "id", "label", "vector", "lo", "hi"])

    return run


def scores(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products: float64 where they are exact, else 64-bit integers."""
    most = float(np.abs(asked.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * asked.shape[1]
    if most < EXACT:
        return asked.astype(np.float64) @ rows.astype(np.float64).T
    return asked.astype(np.int64) @ rows.astype(np.int64).T


def _scored(index: Index, k: int, same: bool):
    """Rows sorted by list, block, asks and id -> each anchor's best k of a block within each window."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, rows = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if place != tuple(where[a, :2]):
                    place, held, rows = tuple(where[a, :2]), [], None
                part = batch.slice(a, b - a)
                if not where[a, 2]:
                    held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), index.unpacked(part.column(5).to_pylist())))
                elif held:
                    rows = rows or [np.concatenate(x) for x in zip(*held)]
                    for c in range(0, part.num_rows, ANCHORS):
                        if (out := best(part.slice(c, ANCHORS), *rows)) is not None:
                            yield out

    def best(asked: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch | None:
        anchor, label = asked.column(3).to_numpy(), asked.column(4).to_numpy()
        s = scores(index.unpacked(asked.column(5).to_pylist()), vectors)
        mine = label[:, None] == labels[None, :]
        fits = mine & (anchor[:, None] != ids[None, :]) if same else ~mine
        low, out = -np.inf if s.dtype == np.float64 else LOW, []
        los, his = asked.column(6).to_pylist(), asked.column(7).to_pylist()
        for w in range(max(map(len, los))):
            lo, hi = (np.array([x[w] if w < len(x) else none for x in xs], object).astype(s.dtype)[:, None] for xs, none in ((los, HIGH), (his, LOW)))
            within = fits & (s >= lo) & (s <= hi)
            at = np.flatnonzero(within.any(1))
            if not len(at):
                continue
            left, open_ = np.where(within[at], s[at], low), within[at]
            for _ in range(k):  # rows stand in the order of their ids, and argmax takes the first of equal ones
                top = left.argmax(1)
                good = open_[np.arange(len(at)), top]
                out.append((anchor[at[good]], np.full(good.sum(), w, np.int32), ids[top[good]], s[at[good], top[good]].astype(np.int64)))
                left[np.arange(len(at)), top] = low
                open_[np.arange(len(at)), top] = False
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "w", "id", "score"])

    return run


def search(index: Index, dealt: DataFrame, asked: DataFrame, k: int, same: bool, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(anchor, w, rank, id, score): the first k rows of the same label (or of others) in each window of each anchor.

    asked: id, label, vector and the windows lo, hi (arrays of equal length).
    """
    width = shuffle_width(asked.sparkSession)
    by_score = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    lists = dealt.select("list", "block", F.lit(0).alias("asks"), "id", "label", "vector", F.lit(None).cast("array<long>").alias("lo"), F.lit(None).cast("array<long>").alias("hi"))
    top, begin, step = None, 0, first
    while begin < len(index.centroids):
        if top is None:
            known = asked.withColumn("kth", F.transform("lo", lambda _: F.lit(None).cast("long")))
        else:
            full = top.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            full = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kths"))  # an entry per window
            known = asked.join(full.withColumnRenamed("anchor", "id"), "id", "left").withColumn("kth", F.transform("lo", lambda _, w: F.element_at("kths", w)))
        visits = written(known.select("id", "label", "vector", "lo", "hi", "kth").mapInArrow(_visits(index, begin, begin + step), ROWS), "visits")
        begin, step = begin + step, step * growth
        if not visits.isEmpty():
            wanted = lists.join(F.broadcast(visits.select("list").distinct()), "list", "left_semi").select(lists.columns)  # a row per list
            meet = wanted.unionByName(visits).repartition(width, "list", "block").sortWithinPartitions("list", "block", "asks", "id")
            found = meet.mapInArrow(_scored(index, k, same), FOUND)
            found = found if top is None else found.unionByName(top.select("anchor", "w", "id", "score"))
            top = written(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "top")
    if top is None:
        top = asked.sparkSession.createDataFrame([], FOUND).withColumn("rank", F.lit(0))
    return top.select("anchor", "w", "rank", "id", "score")


def hard_negatives(rows: DataFrame, every: int = 50, lists: int = LISTS, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (id, label, v); see the module."""
    index, dealt = build(rows, lists, block)
    anchors = written(dealt.where(F.col("id") % every == 0).select("id", "label", "vector"), "anchors")
    unlimited = anchors.select("*", F.array(F.lit(LOW)).alias("lo"), F.array(F.lit(HIGH)).alias("hi"))
    positives = search(index, dealt, unlimited, POSITIVES, same=True, first=first)
    positives = written(positives.select("anchor", F.col("rank").alias("nth"), F.col("id").alias("positive"), "score"), "positives")
    p = F.col("score")
    windows = positives.where("score >= 0").select("anchor", "nth", "positive", "score", F.expr("score div 2 + score % 2").alias("lo"), (p - F.expr("score div 20") - F.when(p % 20 > 0, 1).otherwise(0)).alias("hi"))
    windows = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "lo", "hi"))).alias("p"))  # one per positive
    asked = windows.join(anchors, windows["anchor"] == anchors["id"]).select("id", "label", "vector", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), F.col("p.nth").alias("nths"))
    asked = written(asked, "asked")
    negatives = search(index, dealt, asked, NEGATIVES, same=False, first=first)
    nths = asked.select(F.col("id").alias("anchor"), "nths")
    named = negatives.join(nths, "anchor").select("anchor", F.element_at("nths", F.col("w") + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(positives, ["anchor", "nth"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(entrants(table, "vec_id", "embedding", label))


OP13_SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS mine, b.id, b.label,
             list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
      FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = mine
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> mine AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""
