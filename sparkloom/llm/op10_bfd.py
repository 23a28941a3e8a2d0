"""Best-fit-decreasing packing into token matrices.

A *shard* is what a task has read of its own scan partition until ``SHARD`` ids are together:
bounded memory and no shuffle, and a task run anew packs the same shards.  Within a shard,
texts longer than a row are split into full rows and a rest, so that no id is lost; the parts
are placed longest first, each into the row with the least room that still holds it.  A segment
tree over room sizes finds that row in log2(row) steps.

Each row comes with its ids and positions as little-endian unsigned 32-bit integers (positions
restart at 0 in each segment and in the padding) and the cumulative lengths of its segments;
``files`` gives whole shards instead: an id matrix, cumulative lengths and positions of all its rows.

A null or empty text is its end id alone; ties are taken in reading order; repeated rows are
packed each; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import wordbpe
from sparkloom.llm.common import documents, id_and_text

ROW = 2048
SHARD = 2_000_000
PAD = 0
ROWS = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, n_pad int, ids_crc32 long, positions_crc32 long, ids binary, positions binary"
FILES = "shard_id long, n_rows int, ids binary, row_starts array<int>, cu_seqlens array<int>, positions binary"


class Rooms:
    """Rows by free room; a segment tree over room sizes 0 to ``size`` with how many rows lie below each node."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest room that is ``least`` or more, and that room."""
        tree, node = self.tree, self.leaves + least
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], size: int = ROW) -> list[list[int]]:
    """Rows of part numbers; parts longest first, in order on ties."""
    rooms, rows = Rooms(size), []
    for part in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[part])
        if found is None:
            found = len(rows), size
            rows.append([])
        row, room = found
        rows[row].append(part)
        if room > lengths[part]:
            rooms.put(row, room - lengths[part])
    return rows


def _shards(batches: Iterable[pa.RecordBatch], tokenizer: str | None, most: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, packed ids) of about ``most`` ids."""
    words, held, size = wordbpe.words(tokenizer), [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = words.packed(text.as_py()) + wordbpe.END
            held.append((doc, ids))
            size += len(ids) // 4
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _packed(shard: list[tuple], size: int) -> list[list[tuple]]:
    """Rows of (doc_id, start, bytes)."""
    parts = [(doc, at, ids[4 * at : 4 * (at + size)]) for doc, ids in shard for at in range(0, len(ids) // 4, size)]
    return [[parts[k] for k in row] for row in best_fit([len(p[2]) // 4 for p in parts], size)]


def _positions(lengths: list[int], size: int) -> np.ndarray:
    """0, 1, ... in each segment and in the padding after the last one."""
    ends = np.cumsum([*lengths, size - sum(lengths)])
    return (np.arange(size) - np.repeat(np.append(0, ends[:-1]), np.diff(np.append(0, ends)))).astype("<u4")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = ROW, shard: int = SHARD, files: bool = False) -> DataFrame:
    """One row per packed sequence; with ``files`` one row per shard with its matrices, ready to be written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for number, held in enumerate(_shards(batches, tokenizer, shard)):
            rows = _packed(held, size)
            lengths = [[len(p) // 4 for _, _, p in row] for row in rows]
            bodies = [b"".join(p for _, _, p in row).ljust(4 * size, PAD.to_bytes(1)) for row in rows]
            places = [_positions(n, size).tobytes() for n in lengths]
            sums = [np.cumsum([0, *n]).tolist() for n in lengths]
            if files:
                starts = np.cumsum([0, *map(len, sums)]).tolist()
                cols = [[base + number], [len(rows)], [b"".join(bodies)], [starts], [[x for s in sums for x in s]], [b"".join(places)]]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                names = ["shard_id", "n_rows", "ids", "row_starts", "cu_seqlens", "positions"]
            else:
                first = base + (number << 20)
                used = [s[-1] for s in sums]
                cols = [range(first, first + len(rows)), [[d for d, _, _ in r] for r in rows], [[a for _, a, _ in r] for r in rows], sums, used, [size - n for n in used], map(zlib.crc32, bodies), map(zlib.crc32, places), bodies, places]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                names = ["sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", "n_pad", "ids_crc32", "positions_crc32", "ids", "positions"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return id_and_text(docs).mapInArrow(run, FILES if files else ROWS)


def op10_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
