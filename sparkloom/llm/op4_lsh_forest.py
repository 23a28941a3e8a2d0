"""MinHash near-duplicates by an LSH forest.

1. Texts with equal shingle sets form a class; one row per class goes on, under a label that starts
   with the class's smallest doc_id, so that the smallest label of a component names its smallest id.
2. The forest holds each class's MinHash values in ``TREES`` sorted orders of ``DEPTH`` values.
   Classes whose first ``BASE`` values in an order agree are a region.  All its pairs that are not
   yet connected are compared through the whole sketches; it hands on a spanning forest of its
   likely links, never all pairs.  A region of more than ``HOT`` classes is dealt out in blocks of
   about that size, and one class of each block stands for it in a region of its own, which joins
   near copies of one text; there alone more than ``REGION`` classes are split by their next values.
   Then all that is outside the region's largest group is compared with every block.  Where a
   region's texts are no near copies (they share a long template), that is all its pairs: the work
   grows with the square of the region.
3. Components of the likely links are clusters.  Within a cluster all links are confirmed on
   the full shingle sets; a pair that is already connected needs no test.  A cluster beyond
   ``CLUSTER`` classes is dealt out in blocks.  One class of each block's largest group meets
   those of other blocks, which connects near copies of one text.  Whatever is then outside the
   cluster's largest group is compared with all blocks: first one class of each group and those
   outside their block's largest group, then all that is left.  Sketches alone visit the blocks;
   texts follow only where sketches agree, to a place per pair of blocks.

A link of similarity 0.75 shares a region in an order with probability 0.42, whatever the size of
the region, so it is missed by all 24 orders about once in 500,000, and its sketches agree too
seldom about once in 250,000; stronger links are missed more rarely, links below are never made.

Shingles follow the query's contract.  Null and empty texts have an empty set and are linked
with nothing.  Rows with a null doc_id count as the largest id (their component_id is null if
there is no other).  Repeated rows get equal rows.  Columns other than doc_id and text are not
read and may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, free_names, id_and_text, per_slice, shuffle_width, shuffles, text_bytes, written
from sparkloom.llm.components import components, extended, local_stars
from sparkloom.llm.shingles import shingle_sets, similar, sketches

TREES, DEPTH, BASE = 24, 6, 3
SIZE = TREES * DEPTH
REGION = 256
HOT = 1024
CLUSTER = 400
CLUSTER_SHINGLES = 500_000
MEMBERS = 50_000  # members of large clusters for a task, without their texts
PERCENT = 75
LIKELY = int(SIZE * 0.585)  # 0.75 less 4.6 standard deviations of the estimate
NO_ID = (1 << 63) - 1
SIGN = -(1 << 63)
COLD, STAND_INS = -1, -2  # blocks: a region that is not dealt out; those who stand for blocks
SKETCH = "did long, th long, n_shingles long, set binary, sketch binary"


def _sketch_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(text_bytes(batch.column(2)))
    values = sketches(sets, SIZE)
    nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    rows = [v.tobytes() if n else None for v, n in zip(values, nodes)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.binary()), pa.array(rows, pa.binary())], names=["did", "th", "n_shingles", "set", "sketch"])


def _tree_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values by class, order and depth; the regions' keys: three values of 16 bits under the order's number."""
    v = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH).astype(np.int64)
    key = np.broadcast_to(np.arange(TREES, dtype=np.int64), v.shape[:2])
    for k in range(BASE):
        key = key << 16 | v[:, :, k]
    return v, key


def _tree_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sketch) -> a row per order: the region's key."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_tree_values(batch)[1].ravel())], names=["key"])


def _tree_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sketch) -> a row per order: the region's key, the deeper values, the node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v, key = _tree_values(batch)
        deep = np.zeros(v.shape[:2], np.int64)
        for k in range(BASE, DEPTH):
            deep = deep << 16 | v[:, :, k]
        node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(deep.ravel()), node], names=["key", "deep", "node"])


class Groups:
    """A small union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def likely_links(values: np.ndarray, deep: np.ndarray, most: int = REGION, bits: int = 16 * (DEPTH - BASE)) -> list[tuple[int, int]]:
    """A spanning forest of the likely links of a region, whose rows are sorted by ``deep``."""
    group, links = np.arange(len(values)), []

    def test(i: int, others: np.ndarray) -> None:
        others = others[group[others] != group[i]]
        near = others[np.count_nonzero(values[others] == values[i], axis=1) >= LIKELY]
        for j in near.tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                links.append((i, j))

    def part(lo: int, hi: int, left: int) -> None:
        if hi - lo <= most or left == 0:
            for i in range(lo, hi - 1):
                test(i, np.arange(i + 1, min(hi, i + 1 + most)))
            return
        prefix = deep[lo:hi] >> (left - 16)
        cut = lo + 1 + np.flatnonzero(prefix[1:] != prefix[:-1])
        edges = [lo, *cut.tolist(), hi]
        for a, b in zip(edges, edges[1:]):
            part(a, b, left - 16)
            if b < hi:
                test(b - 1, np.arange(b, min(hi, b + 1)))

    part(0, len(values), bits)
    return links


def _region_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, deep, node, sketch, block) sorted by key, block and deep -> likely links (a, b)."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch | None:
        key, deep = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        nodes = rows.column(2).to_pylist()
        values = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint16).reshape(-1, SIZE)
        block = rows.column(4).to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(key)]
        out: set[tuple[bytes, bytes]] = set()
        for a, b in zip(edges, edges[1:]):
            if b - a == 2:
                if np.count_nonzero(values[a] == values[a + 1]) >= LIKELY:
                    out.add((max(nodes[a], nodes[a + 1]), min(nodes[a], nodes[a + 1])))
            elif b - a > 2:
                for i, j in likely_links(values[a:b], deep[a:b], REGION if block[a] == STAND_INS else b - a):
                    out.add((max(nodes[a + i], nodes[a + j]), min(nodes[a + i], nodes[a + j])))
        if not out:
            return None
        x, y = zip(*local_stars(out))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        key = rows.column(0).to_numpy()
        whole = int(np.searchsorted(key, key[-1]))  # the last region may go on in the next batch
        if whole and len(key) >= 5000:
            if (links := flush(rows.slice(0, whole).combine_chunks())) is not None:
                yield links
            held = rows.slice(whole).combine_chunks().to_batches()
    if held and (links := flush(pa.Table.from_batches(held))) is not None:
        yield links


def _confirm(sets: list[np.ndarray], values: np.ndarray, asked: np.ndarray | None = None, groups: Groups | None = None) -> Groups:
    """Joins all rows that links of full sets connect; with ``asked`` only pairs with one of those rows are tested."""
    groups = groups or Groups(len(sets))
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, values = size[order], values[order]
    wanted = np.ones(len(sets), bool) if asked is None else asked[order]
    for i in range(len(order)):
        hi = int(np.searchsorted(size, 100 * size[i] // PERCENT, side="right"))
        near = i + 1 + np.flatnonzero(np.count_nonzero(values[i + 1 : hi] == values[i], axis=1) >= LIKELY)
        if not wanted[i]:
            near = near[wanted[near]]
        for j in near.tolist():
            a, b = int(order[i]), int(order[j])
            if groups.find(a) != groups.find(b) and similar(sets[a], sets[b], PERCENT):
                groups.join(a, b)
    return groups


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, block, node, sketch, text, asked, owner) sorted by cluster and block -> links (a, b) that join them.

    asked is null where all pairs are to be tested; else pairs with an asked row are, and rows of
    one owner count as joined.
    """
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch | None:
        cluster, block = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        out, a = [], 0
        while a < len(cluster):
            b = a
            while b < len(cluster) and (cluster[b], block[b]) == (cluster[a], block[a]):
                b += 1
            unique: dict[bytes, int] = {}
            for k, node in enumerate(rows.column(2).slice(a, b - a).to_pylist()):
                unique.setdefault(node, a + k)
            if len(unique) > 1:
                part, nodes = rows.take(pa.array(list(unique.values()))), list(unique)
                sets = shingle_sets(text_bytes(part.column(4).combine_chunks()))
                values = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, SIZE)
                asked, groups = part.column(5).to_pylist(), Groups(len(nodes))
                first: dict[bytes, int] = {}
                for k, owner in enumerate(part.column(6).to_pylist()):
                    if owner is not None:
                        groups.join(first.setdefault(owner, k), k)
                before = [groups.find(k) for k in range(len(nodes))]
                _confirm(sets, values, None if asked[0] is None else np.array(asked, bool), groups)
                for k in range(len(nodes)):
                    if (root := groups.find(k)) != before[k] or asked[0] is None and root != k:
                        out.append((nodes[k], nodes[root]))
            a = b
        if not out:
            return None
        x, y = zip(*local_stars(out))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        rows = pa.Table.from_batches(held)
        same = (np.array([hash(x) for x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]))
        change = np.flatnonzero(same != same[-1])
        whole = int(change[-1]) + 1 if len(change) else 0
        if whole:
            if (links := flush(rows.slice(0, whole).combine_chunks())) is not None:
                yield links
            held = rows.slice(whole).combine_chunks().to_batches()
    if held and (links := flush(pa.Table.from_batches(held))) is not None:
        yield links


def _links(rows: DataFrame, width: int) -> DataFrame:
    """Confirmed links of rows (cluster, block, node, sketch, text, asked, owner)."""
    rows = rows.select("cluster", "block", "node", "sketch", "text", "asked", "owner")
    return rows.repartition(width, "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_confirmed, "a binary, b binary")


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, block, visits, home, asked, owner, node, sketch) sorted by the first four -> those that need a test.

    Of a block come its own rows, then the visitors, home by home: asked rows of the cluster's other
    blocks.  Out come, as (block, home, node, asked, owner), visitors whose sketch agrees with one of
    the block's rows of another owner, and the rows that they agree with, each once a home.
    """
    place, home_, own, met, values = None, None, [], {}, None

    def rows() -> list[tuple]:
        found = [(place[0], place[1], home_, *x) for x in met.values()]
        met.clear()
        return found

    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple] = []
        for cluster, block, visits, home, asked, owner, node, sketch in zip(*(batch.column(k).to_pylist() for k in range(8))):
            if met and ((cluster, block) != place or home != home_):
                out += rows()
            if (cluster, block) != place:
                place, own, values = (cluster, block), [], None
            home_ = home
            if not visits:
                own.append((asked, owner, node, sketch))
                continue
            if values is None:
                held = np.array([x[0] for x in own], bool)
                owners = np.array([*(x[1] for x in own), None], object)[:-1]
                values = np.frombuffer(b"".join(x[3] for x in own), np.uint16).reshape(-1, SIZE)
            wanted = owners != owner
            if home < block:  # of two asked rows only one visits the other
                wanted &= ~held
            others = np.flatnonzero(wanted)
            near = others[np.count_nonzero(values[others] == np.frombuffer(sketch, np.uint16), axis=1) >= LIKELY]
            if len(near):
                met[node] = (node, True, owner)
                for j in near.tolist():
                    met.setdefault(own[j][2], (own[j][2], False, own[j][1]))
        if out:
            yield _meeting_rows(out)
    if met:
        yield _meeting_rows(rows())


MEETING = "cluster binary, block int, home int, node binary, asked boolean, owner binary"


def _meeting_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["cluster", "block", "home", "node", "asked", "owner"])


def _tagged(members: DataFrame, roots: DataFrame, every: bool) -> DataFrame:
    """Members with their group (owner), and who is to be compared with other blocks (asked): none of the cluster's
    largest group; of other groups all, or unless ``every`` one member and all outside their block's largest group."""
    named = members.join(roots, "node", "left").select("cluster", "block", "node", "sketch", F.coalesce("root", "node").alias("owner"))
    named = written(named, "named")
    parts = named.groupBy("cluster", "block", "owner").agg(F.count("*").alias("size"), F.min("node").alias("one"))
    groups = written(parts.groupBy("cluster", "owner").agg(F.sum("size").alias("size"), F.min("one").alias("one")), "owners")
    largest = groups.groupBy("cluster").agg(F.max_by("owner", F.struct("size", "owner")).alias("largest"))
    outside = named.join(written(largest, "largest"), "cluster").where("owner <> largest")
    if every:
        asked = outside.select("node")
    else:
        of_block = parts.groupBy("cluster", "block").agg(F.max_by("owner", F.struct("size", "owner")).alias("common"))
        outside = outside.join(written(of_block, "common"), ["cluster", "block"]).join(groups.select("one", F.lit(True).alias("is_one")), F.col("node") == F.col("one"), "left")
        asked = outside.where(F.col("is_one") | (F.col("owner") != F.col("common"))).select("node")
    return written(named.join(asked.withColumn("asked", F.lit(True)), "node", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "asked")


def _join_blocks(members: DataFrame, roots: DataFrame, width: int, cluster: int) -> DataFrame:
    """The components ``roots`` with the links between the blocks of clusters that are too large for one task; see step 3."""
    spark = members.sparkSession
    narrow = members.select("cluster", "block", "node", "sketch")
    with shuffles(spark, narrow.count(), MEMBERS):
        firsts = narrow.join(roots, "node", "left").groupBy("cluster", "block", F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("size"), F.min("node").alias("node"))
        firsts = firsts.groupBy("cluster", "block").agg(F.max_by("node", F.struct("size", "root")).alias("node"))
        firsts = written(firsts.select("node", F.floor(F.col("block") / F.lit(cluster)).cast("long").alias("place")), "firsts")
        blocks = written(members.groupBy("cluster").agg(F.max("block").alias("last")), "last")
    met = members.join(firsts, "node").select("cluster", F.col("place").alias("block"), "node", "sketch", "text", F.lit(None).cast("boolean").alias("asked"), F.lit(None).cast("binary").alias("owner"))
    roots = extended(roots, written(_links(met, width), "links"))

    done: DataFrame | None = None
    for every in (False, True):
        with shuffles(spark, narrow.count(), MEMBERS):
            tagged = _tagged(narrow, roots, every)
        if done is not None:
            tagged = tagged.join(done.select("node", F.lit(True).alias("was")), "node", "left").withColumn("asked", F.col("asked") & F.col("was").isNull()).drop("was")
        asked = tagged.where("asked")
        if asked.isEmpty():
            continue
        done = asked
        own = tagged.select("cluster", "block", F.lit(False).alias("visits"), F.lit(-1).alias("home"), "asked", "owner", "node", "sketch")
        out = asked.join(blocks, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), "last")).alias("to"), F.lit(True).alias("visits"), F.col("block").alias("home"), "asked", "owner", "node", "sketch")
        rows = own.unionByName(out.withColumnRenamed("to", "block").where("home <> block"))
        meetings = rows.repartition(width, "cluster", "block").sortWithinPartitions("cluster", "block", "visits", "home").mapInArrow(_meetings, MEETING)
        pair = (F.col("home").cast("long") * (1 << 31) + F.col("block")).alias("block")
        meetings = written(meetings, "meetings")
        if meetings.isEmpty():
            continue
        tested = meetings.select("cluster", pair, "node", "asked", "owner").join(members.select("node", "sketch", "text"), "node")
        roots = extended(roots, written(_links(tested, width), "links"))
    return roots


def _visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, visits, home, asked, owner, node, sketch) sorted by the first three -> likely links (a, b).

    Of a block come its own rows, then the visitors: asked rows of the region's other blocks.  Each is
    compared with the block's own rows of other owners; of two asked rows only one visits the other.
    """
    at, own, up, ready = None, [], {}, False

    def find(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in range(8)]
        out = []
        for key, block, visits, home, asked, owner, node, sketch in zip(*cols):
            if at != (key, block):
                at, own, up, ready = (key, block), [], {}, False
            if not visits:
                own.append((asked, owner, node, sketch))
                continue
            if not ready:
                nodes = [x[2] for x in own]
                held = np.array([x[0] for x in own], bool)
                owners = np.array([*(x[1] for x in own), None], object)[:-1]
                values = np.frombuffer(b"".join(x[3] for x in own), np.uint16).reshape(-1, SIZE)
                ready = True
            mine = find(owner)
            wanted = owners != mine
            if home < block:
                wanted &= ~held
            others = np.flatnonzero(wanted)
            if not len(others):
                continue
            of = values if len(others) == len(values) else values[others]
            near = others[np.count_nonzero(of == np.frombuffer(sketch, np.uint16), axis=1) >= LIKELY]
            for j in near.tolist():
                if owners[j] != mine:
                    out.append((node, nodes[j]))
                    up[owners[j]] = mine
                    owners[owners == owners[j]] = mine
        if out:
            x, y = zip(*local_stars(out))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])


def _join_regions(dealt: DataFrame, sketches: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """The components ``roots`` after all pairs of regions (key, block, node) that are dealt out; see step 2."""
    named = dealt.join(roots, "node", "left").select("key", "block", "node", F.coalesce("root", "node").alias("owner"))
    named = written(named, "regions")
    sizes = named.groupBy("key", "owner").agg(F.count("*").alias("size"))
    largest = written(sizes.groupBy("key").agg(F.max_by("owner", F.struct("size", "owner")).alias("largest")), "largest")
    asked = named.join(largest, "key").select("key", "block", "node", "owner", (F.col("owner") != F.col("largest")).alias("asked"))
    asked = written(asked, "asked")
    if asked.where("asked").isEmpty():
        return roots
    blocks = dealt.groupBy("key").agg(F.max("block").alias("last"))
    rows = asked.select("key", "block", F.lit(False).alias("visits"), F.col("block").alias("home"), "asked", "owner", "node")
    out = asked.where("asked").join(blocks, "key").select("key", F.explode(F.sequence(F.lit(0), "last")).alias("to"), F.lit(True).alias("visits"), F.col("block").alias("home"), "asked", "owner", "node")
    rows = rows.unionByName(out.withColumnRenamed("to", "block").where("home <> block")).join(sketches, "node")
    rows = rows.select("key", "block", "visits", "home", "asked", "owner", "node", "sketch").repartition(width, "key", "block").sortWithinPartitions("key", "block", "visits")
    links = rows.mapInArrow(_visits, "a binary, b binary")
    return extended(roots, written(links, "links"))


def likely_roots(classes: DataFrame, width: int, hot: int = HOT) -> DataFrame:
    """(node, root) of the components of likely links between classes (node, sketch)."""
    sizes = classes.select("sketch").mapInArrow(_tree_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "sizes")
    forest = classes.select("node", "sketch").mapInArrow(_tree_rows, "key long, deep long, node binary").join(sizes.hint("shuffle_hash"), "key")
    block = F.when(F.col("n") > hot, F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / F.lit(hot))).cast("int")).otherwise(F.lit(COLD))
    forest = forest.select("key", block.alias("block"), "deep", "node")
    first = forest.where("block >= 0").groupBy("key", "block").agg(F.min(F.struct("deep", "node")).alias("f")).select("key", F.lit(STAND_INS).alias("block"), "f.deep", "f.node")
    forest = written(forest.unionByName(first), "forest")
    rows = forest.join(classes.select("node", "sketch"), "node").select("key", "deep", "node", "sketch", "block")
    likely = rows.repartition(width, "key", "block").sortWithinPartitions("key", "block", "deep", "node").mapInArrow(_region_links, "a binary, b binary")
    roots = components(likely)
    dealt = forest.where("block >= 0").select("key", "block", "node")
    return roots if dealt.isEmpty() else _join_regions(dealt, classes.select("node", "sketch"), roots, width)


def near_duplicates(docs: DataFrame, cluster: int = CLUSTER, cluster_shingles: int = CLUSTER_SHINGLES, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; see the module's docstring."""
    result = _grouped(docs, cluster, cluster_shingles, hot)
    component = F.coalesce(_smallest_id(F.col("root")), "did")
    return result.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_shingles", F.when(component != NO_ID, component).alias("component_id"), (F.col("did") == component).alias("kept")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, with all their columns, with one row left of each group: that with the smallest id, and of
    those with one id that with the smallest text hash.  Rows without words all stay."""
    found = _grouped(docs)
    keys = did, th = free_names(docs, "did", "th")
    worded = found.where("root IS NOT NULL").select("root", F.col("did").alias(did), F.col("th").alias(th))
    chosen = worded.groupBy("root").agg(F.min(F.struct(did, th)).alias("k")).select("k.*")
    bare = found.where("root IS NULL").select(F.col("did").alias(did), F.col("th").alias(th)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(text)})
    kept = keyed.join(chosen.unionByName(bare).hint("shuffle_hash"), keys, "left_semi")
    repeated = worded.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    if not repeated.isEmpty():
        kept = kept.join(repeated, keys, "left_anti").unionByName(kept.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def _label(did: Column, content: Column) -> Column:
    """Bytes that sort as (did, content) does."""
    return F.concat(F.unhex(F.lpad(F.hex(did.bitwiseXOR(F.lit(SIGN))), 16, "0")), content)


def _smallest_id(label: Column) -> Column:
    return F.conv(F.hex(F.substring(label, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(SIGN))


def _grouped(docs: DataFrame, cluster: int = CLUSTER, cluster_shingles: int = CLUSTER_SHINGLES, hot: int = HOT) -> DataFrame:
    """did, th, n_shingles of every row and its group's root, a label (null without words)."""
    width = shuffle_width(docs.sparkSession)
    texts = id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")
    rows = written(texts.mapInArrow(per_slice(_sketch_slice), SKETCH), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("set").agg(F.min(F.struct("did", "th")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = written(classes.select(_label(F.col("rep.did"), F.col("set")).alias("node"), "set", "rep.did", "rep.th", "n_shingles", "sketch"), "classes")

    roots = likely_roots(classes, width, hot)
    clusters = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

    members = clusters.join(classes, "node").select("node", F.col("root").alias("cluster"), "did", "th", "n_shingles", "sketch")
    members = written(members, "clusters")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(cluster)), F.ceil(F.sum("n_shingles") / F.lit(cluster_shingles))).cast("int").alias("blocks"))
    members = members.join(written(blocks, "blocks"), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = texts.join(members.hint("shuffle_hash"), ["did", "th"]).select("cluster", "block", "blocks", "node", "sketch", "text")
    members = written(members, "members")
    roots = components(_links(members.withColumns({"asked": F.lit(None).cast("boolean"), "owner": F.lit(None).cast("binary")}), width))
    large = members.where("blocks > 1").drop("blocks")
    if not large.isEmpty():
        roots = _join_blocks(large, roots, width, cluster)

    named = classes.select("node", "set").join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root"))
    return rows.select("did", "th", "n_shingles", "set").join(written(named, "groups"), "set", "left").select("did", "th", "n_shingles", "root")


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
