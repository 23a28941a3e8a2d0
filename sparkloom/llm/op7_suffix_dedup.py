"""Removes repeated passages: every byte of a 100-byte string that also starts earlier.

1. Each 100-byte window of a text belongs to an anchor (see ``anchors``): equal windows have
   equal anchors at equal offsets.  A run of windows with one anchor is a segment.  Within a
   slice of rows, all but the first of equal segments (one per text where ids repeat) are marked at once, so that a passage in a
   third of all rows meets in one task as a few rows per slice.
2. Anchors with more than ``HOT`` segments of different content (a phrase, or the edge of a passage, that a
   large part of all rows holds) would be one task's.  They are counted first, slice by slice (a content that
   several slices have counts in each), with aggregates that combine before the shuffle.  All other segments meet by anchor; those of hot anchors by
   their content too.  Of equal segments all but the earliest are marked.  Anchors whose earliest
   segments differ go on.
3. Those segments' bytes, aligned at the anchor, are the collection of a column-wise
   Burrows-Wheeler construction (see ``columnwise``): one symbol per segment and round, with
   common prefixes.  Windows whose common prefix with an earlier segment reaches 100 bytes are
   marked.  Segments of hot anchors are taken apart into single windows, which meet by their
   content and, like segments, as a few rows per slice, in an order that Spark has sorted.
4. Marked windows are joined to their texts, merged and cut out.

Matches never cross texts, all of them are judged on the input, and overlaps count.  Order is
by doc_id (null first), then start.  Rows that share a doc_id are one document as far as order
goes: none of them is earlier than the other.  Null texts count as empty; texts under 100 bytes
stay whole; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from sparkloom.llm import anchors
from sparkloom.llm.columnwise import Columns, later_windows
from sparkloom.llm.common import documents, free_names, id_and_text, joined, per_slice, pieces, shuffle_width, text_bytes, written

LENGTH = anchors.WINDOW
LEFT = anchors.SPAN - 1  # most bytes of a window before its anchor
WIDTH = LEFT + LENGTH
HOT = 1000
NO_ID = -(1 << 63)
SEGMENT, LONE, MARKED = 0, 1, 2  # kinds of rows that meet in step 3
LATE, OPEN, IN_PARTS = 1, 0, 2  # states of segments: marked, neither, of a hot anchor
SEGMENTS = "h long, seg long, did long, th long, start long, count int, shift int, state int"
MARKS = "did long, th long, start long, count int"
RESULT = "did long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(did, th, text): order and key of a row without nulls, and its text."""
    return id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring stretches of the same document as one."""
    if not len(doc):
        return doc, start, count
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1]))
    head = np.flatnonzero(new)
    return doc[head], start[head], np.add.reduceat(count, head)


def _anchor_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Anchors and how many different contents their segments have in the slice."""
    s = anchors.segments(*joined(text_bytes(batch.column(0))))
    order = np.lexsort((s["content"], s["gram"]))
    gram, content = s["gram"][order].view(np.int64), s["content"][order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1]))[: len(order)]
    gram = gram[new]
    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    return pa.RecordBatch.from_arrays([pa.array(gram[head]), pa.array(np.diff(np.append(head, len(gram))))], names=["h", "n"])


def _anchor_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    did, th = (batch.column(k).to_numpy() for k in (0, 1))
    s = anchors.segments(*joined(text_bytes(batch.column(2))))
    owner = did[s["doc"]]
    order = np.lexsort((th[s["doc"]], s["start"], owner, s["content"], s["gram"]))
    gram, content, who, start, which = (x[order] for x in (s["gram"], s["content"], owner, s["start"], th[s["doc"]]))
    new = np.append(True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])) if len(order) else np.empty(0, bool)
    head = np.flatnonzero(new)
    first = np.repeat(head, np.diff(np.append(head, len(order))))
    late = (who != who[first]) | (start != start[first])
    d, b, c = _runs(s["doc"][order[late]], start[late], s["count"][order[late]])
    keep = order[~late & (new | np.append(True, which[1:] != which[:-1])[: len(order)])]  # of rows with one id each text
    salt = anchors.splitmix(th[d].view(np.uint64) ^ anchors.splitmix(b))
    doc = np.concatenate([s["doc"][keep], d])
    zero = np.zeros(len(d), np.int64)
    cols = {
        "h": np.concatenate([s["gram"][keep], salt]).view(np.int64),
        "seg": np.concatenate([s["content"][keep], salt]).view(np.int64),
        "did": did[doc],
        "th": th[doc],
        "start": np.concatenate([s["start"][keep], b]),
        "count": np.concatenate([s["count"][keep], c]).astype(np.int32),
        "shift": np.concatenate([s["shift"][keep], zero]).astype(np.int32),
        "state": np.where(np.arange(len(doc)) < len(keep), OPEN, LATE).astype(np.int32),
    }
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols.values()], names=list(cols))


def _cut_slice(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(did, th, text, wanted: [(h, start, count, shift, hot)]) -> a row per segment with its bytes; of hot
    segments a row per window, the first of equal ones in the slice, and marks for the others."""
    cold, hot = [], []
    for did, th, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist()):
        for w in wanted:
            row = (w["h"], did, th, w["start"], w["count"], w["shift"], text[w["start"] : w["start"] + w["count"] - 1 + LENGTH])
            (hot if w["hot"] else cold).append(row)
    if cold:
        *numbers, bodies = zip(*cold)
        yield _cut_rows(*(np.array(x, np.int64) for x in numbers), SEGMENT, pa.array(bodies, pa.binary()))
    size, at = np.cumsum([len(r[6]) for r in hot]), 0
    while at < len(hot):  # windows of some segments at a time: each is a row of many arrays
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 18), side="right")))
        yield from _cut_windows(hot[at:upto])
        at = upto


def _cut_windows(hot: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Windows of hot segments: the first of equal ones, and runs of the others as marks."""
    data, ends = joined([r[6] for r in hot])
    _, did, th, begin, count = (np.array(x, np.int64) for x in list(zip(*hot))[:5])
    owner = np.repeat(np.arange(len(hot)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    key = anchors.window_hashes(data, (ends - (count - 1 + LENGTH))[owner] + at).view(np.int64)
    start = begin[owner] + at
    order = np.lexsort((th[owner], start, did[owner], key))
    new = np.append(True, key[order][1:] != key[order][:-1])
    head = np.flatnonzero(new)
    first = np.repeat(order[head], np.diff(np.append(head, len(order))))
    after = (did[owner[order]] != did[owner[first]]) | (start[order] != start[first])
    other = np.append(True, th[owner[order]][1:] != th[owner[order]][:-1])
    keep, late = order[~after & (new | other)], order[after]
    yield _cut_rows(key[keep], did[owner[keep]], th[owner[keep]], start[keep], np.ones(len(keep), np.int64), np.zeros(len(keep), np.int64), LONE)
    if len(late):
        of, b, c = _runs(owner[late], start[late], np.ones(len(late), np.int64))
        yield _cut_rows(anchors.splitmix(th[of].view(np.uint64) ^ b.view(np.uint64)).view(np.int64), did[of], th[of], b, c, np.zeros(len(of), np.int64), MARKED)


def _cut_rows(h: np.ndarray, did: np.ndarray, th: np.ndarray, start: np.ndarray, count: np.ndarray, shift: np.ndarray, kind: int, body: pa.Array | None = None) -> pa.RecordBatch:
    cols = [pa.array(h), pa.array(did), pa.array(th), pa.array(start), pa.array(count.astype(np.int32)), pa.array(shift.astype(np.int32))]
    body = pa.nulls(len(h), pa.binary()) if body is None else body
    return pa.RecordBatch.from_arrays([*cols, body, pa.array(np.full(len(h), kind, np.int32))], names=[c.split()[0] for c in CUT.split(", ")])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401  pa.compute

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            yield from _cut_slice(part)


CUT = "h long, did long, th long, start long, count int, shift int, body binary, kind int"


def _marks(did: np.ndarray, th: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(did), 50_000):
        b = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(did[b]), pa.array(th[b]), pa.array(start[b]), pa.array(count[b].astype(np.int32))], names=["did", "th", "start", "count"])


def _columnwise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, key, document and start -> the marked windows.  All segments of a task are one collection."""
    columns, kept, first = Columns(WIDTH), [], None
    for batch in batches:
        kind = batch.column(7).to_numpy() if batch.num_rows else np.empty(0)
        if len(at := np.flatnonzero(kind == MARKED)):
            yield from _marks(*(batch.column(k).to_numpy()[at] for k in (1, 2, 3, 4)))
        if len(at := np.flatnonzero(kind == LONE)):
            key, did, th, start = (batch.column(k).to_numpy()[at] for k in (0, 1, 2, 3))
            new = np.append(first is None or first[0] != key[0], np.diff(key) != 0)
            head = np.flatnonzero(new)
            source = head[np.cumsum(new) - 1] if len(head) else np.zeros(len(key), np.int64)
            early_did, early_start = did[source], start[source]
            if not new[0]:  # the key goes on from the batch before
                to = head[0] if len(head) else len(key)
                early_did[:to], early_start[:to] = first[1:]
            late = np.flatnonzero((did != early_did) | (start != early_start))
            first = int(key[-1]), int(early_did[-1]), int(early_start[-1])
            yield from _marks(did[late], th[late], start[late], np.ones(len(late), np.int64))
        part = batch.filter(pa.array(kind == SEGMENT))
        if not part.num_rows:
            continue
        start, shift = part.column(3).to_numpy(), part.column(5).to_numpy()
        data, ends = joined(part.column(6).to_pylist())
        size = np.diff(np.append(0, ends))
        matrix = np.zeros((part.num_rows, WIDTH), np.uint16)
        row = np.repeat(np.arange(part.num_rows), size)
        matrix[row, np.arange(len(data)) - np.repeat(ends - size, size) + np.repeat(LEFT - shift, size)] = data.astype(np.uint16) + 1
        columns.add(matrix)
        kept.append((part.column(1).to_numpy(), part.column(2).to_numpy(), start + shift))
    if not columns.rows:
        return
    did, th, anchor = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((anchor, did))
    step = np.append(0, (did[order][1:] != did[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
    rank = np.empty(columns.rows, np.int64)
    rank[order] = np.cumsum(step)
    found = later_windows(columns, rank, LENGTH, LEFT + 1)
    columns.close()
    hit = np.flatnonzero(found)
    bits = np.unpackbits(found[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, offset = np.nonzero(bits)
    row, begin, count = _runs(hit[at], anchor[hit[at]] - LEFT + offset, np.ones(len(at), np.int64))
    yield from _marks(did[row], th[row], begin, count)


def spans(windows: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes under runs of windows (first start, number of starts)."""
    out: list[list[int]] = []
    for start, count in sorted(windows):
        stop = start + count - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _remover(keep_text: bool):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, marks in zip(text_bytes(batch.column(2)), batch.column(3).to_pylist()):
            cut = spans([(m["start"], m["count"]) for m in marks]) if marks else []
            rest, at = [], 0
            for a, b in cut:
                rest.append(text[at:a])
                at = b
            kept = b"".join([*rest, text[at:]]) if cut else text
            rows.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["did", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return per_slice(work)


def hot_anchors(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(h, n): anchors whose segments have more than ``hot`` different contents."""
    counts = texts.select("text").mapInArrow(per_slice(_anchor_counts, 8 << 20), "h long, n long")
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > hot)


def repeated_windows(texts: DataFrame, dealt: DataFrame, width: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Marked windows of keyed texts (also ``dealt`` by their key), as (did, th, start, count): those of whole equal segments, and those found in step 3."""
    crowded = written(hot_anchors(texts, hot).select("h", F.lit(IN_PARTS).alias("parts")), "hot")
    segments = texts.mapInArrow(per_slice(_anchor_slice, 8 << 20), SEGMENTS).join(crowded, "h", "left")
    in_parts = F.col("parts").isNotNull() & (F.col("state") == OPEN)
    segments = segments.select(
        F.when(in_parts, F.xxhash64("h", "seg")).otherwise(F.col("h")).alias("h"), "seg", "did", "th", "start", "count", "shift", F.when(in_parts, F.lit(IN_PARTS)).otherwise(F.col("state")).alias("state")
    ).repartition(width, "h")
    by_anchor = Window.partitionBy("h")
    met = segments.select(
        "*",
        F.rank().over(Window.partitionBy("h", "seg").orderBy("did", "start")).alias("nth"),
        (F.min("seg").over(by_anchor) != F.max("seg").over(by_anchor)).alias("several"),
    )
    hot_rows = F.col("state") == IN_PARTS
    met = met.select("h", "did", "th", "start", "count", "shift", ((F.col("state") == LATE) | (F.col("nth") > 1)).alias("marked"), (F.col("several") | hot_rows).alias("several"), hot_rows.alias("hot"))
    met = written(met.where("marked OR several"), "segments")

    wanted = met.where("NOT marked").groupBy("did", "th").agg(F.collect_set(F.struct("h", "start", "count", "shift", "hot")).alias("wanted"))
    bodies = dealt.join(wanted.hint("shuffle_hash"), ["did", "th"]).select("did", "th", "text", "wanted")
    bodies = bodies.mapInArrow(_cut, CUT)
    found = bodies.repartition(width, "h").sortWithinPartitions("kind", "h", "did", "start").mapInArrow(_columnwise, MARKS)
    return met.where("marked").select("did", "th", "start", "count"), found


def remove_repeats(docs: DataFrame, keep_text: bool = False, key_columns: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept, the remaining bytes."""
    width = shuffle_width(docs.sparkSession)
    texts = keyed(docs)
    dealt = texts.repartition(width, "did", "th")
    equal, found = repeated_windows(texts, dealt, width, hot)
    marks = equal.unionByName(found).groupBy("did", "th").agg(F.collect_set(F.struct("start", "count")).alias("marks"))
    result = dealt.join(marks.hint("shuffle_hash"), ["did", "th"], "left").select("did", "th", "text", "marks").mapInArrow(_remover(keep_text), RESULT)
    doc_id = F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")
    return result.select(*(["did", "th"] if key_columns else []), doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns and repeated passages cut out of text; n_chars, where there is
    one, follows.  A character of which a cut takes some bytes goes as a whole."""
    did, th, kept = free_names(docs, "did", "th", "kept")
    keys = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    cut = remove_repeats(docs, keep_text=True, key_columns=True).where("n_removed > 0").select(F.col("did").alias(did), F.col("th").alias(th), F.col("kept").alias(kept))
    cut = cut.dropDuplicates([did, th])
    out = keys.join(cut, [did, th], "left").withColumn("text", F.when(F.col(kept).isNotNull(), whole_characters(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


@F.arrow_udf(StringType())
def whole_characters(body: pa.Array) -> pa.Array:
    return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in body.to_pylist()], pa.string())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
