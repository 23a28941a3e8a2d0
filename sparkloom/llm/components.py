"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import forget, shuffle_width, shuffles, written

EDGES = 200_000  # edges for a task
FEW = 50_000  # edges that one task joins at once: rounds of nearly empty shuffles would take longer


def _least(edges: DataFrame) -> DataFrame:
    """Edges with m, the smallest b of their a.

    A node with a large part of all edges is not one task's: its edges are dealt out in parts by their
    other end, and only one row per part meets on the node.
    """
    parts = max(8, shuffle_width(edges.sparkSession) // 6)
    edges = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(parts)))
    least = edges.groupBy("a", "s").agg(F.min("b").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return edges.join(least, ["a", "s"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to its smallest neighbour; edges are (larger, smaller)."""
    least = _least(edges)
    return least.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def local_stars(links: Iterable[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """What a task's own links connect, as (node, smallest node) pairs: fewer and shorter than the links."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root) for x in up if (root := find(x)) != x]


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root that has none itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _joined_at_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of all edges of a task -> (node, root)."""
    stars = local_stars((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for k in range(0, len(stars), EDGES):
        x, y = zip(*stars[k : k + EDGES])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots themselves; a root is its component's smallest node.

    The rounds grow with the logarithm of a component's size; edges that are stars already need
    none.  Each round's edges are a table in the shared folder, so lineage stays short and a lost
    executor costs one round at most.  ``FEW`` edges at most need no rounds and no shuffle.
    """
    given = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    count = given.count()
    if count <= FEW:
        kind = given.schema["a"].dataType.simpleString()
        roots = written(given.coalesce(1).mapInArrow(_joined_at_once, f"node {kind}, root {kind}"), "roots")
        forget(given)
        return roots
    with shuffles(given.sparkSession, count, EDGES):
        now = written(given.distinct(), "edges")
        forget(given)
        for _ in range(most_rounds):
            if _are_stars(now):
                return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            before = now
            now = written(_small_star(_large_star(before)).distinct(), "edges")
            forget(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``roots`` with further links between their nodes."""
    if links.isEmpty():
        return roots
    return components(links.select("a", "b").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
