"""Sum-of-squares online packing of token sequences.

Each part is put, as it comes, into an open window whose fill level makes the sum of the
squared counts of equally filled windows smallest.  ``Levels`` keeps one count for each fill
level, so a step looks at the level array alone and never at the windows.

Each task packs the rows of its own scan partition: no shuffle, no state that grows with the
corpus, and a task run anew gives the same windows.  Documents longer than a window are cut
into full windows and a rest.  When a task ends, the fullest open windows are filled from the ends
of the emptiest ones, and the last window is cut into windows whose sizes are powers of two, so
nothing is padded.  Texts are read by as many tasks as their files have splits: small tables are not
dealt out any further, as every task has its own open windows.

Empty and null texts have the end id alone; repeated rows are packed each; an empty table
gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import wordbpe
from sparkloom.llm.common import id_and_text

WINDOW = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Levels:
    """Open windows by fill level; ``count[h]`` windows are filled to h, and ``open[h]`` has their numbers."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.used = 0

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset for a part of ``length`` ids, 0 < length <= size."""
        count, size = self.count, self.size
        # Moving a window from level h to h + length changes the sum of squares by
        # 2 * (count[h + length] - count[h]) + 2; a new window by 2 * count[length] + 1;
        # the full level does not count.
        from_level = count[: size - length + 1]
        to_level = count[length : size + 1].copy()
        change = 2 * (to_level - from_level) + 2
        change[size - length] = 1 - 2 * from_level[size - length]
        change = np.where(from_level > 0, change, np.iinfo(np.int64).max)
        fresh = 2 * int(count[length]) + 1 if length < size else 0
        h = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest on ties
        if from_level[h] == 0 or fresh < change[h]:
            window, h = self.used, 0
            self.used += 1
        else:
            window = self.open[h].pop()
            count[h] -= 1
        if h + length < size:
            count[h + length] += 1
            self.open.setdefault(h + length, []).append(window)
        return window, h


class Packer:
    """Packs the documents of one task; rows() are finished pieces (doc, start, bytes, doc_tokens, window, offset)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.levels = Levels(size)
        self.held: dict[int, list[tuple]] = {}
        self.filled: dict[int, int] = {}

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        for start in range(0, total, self.size):
            part = ids[4 * start : 4 * (start + self.size)]
            window, offset = self.levels.place(len(part) // 4)
            piece = (doc, start, part, total, window, offset)
            if offset + len(part) // 4 == self.size:
                yield from self.held.pop(window, ())
                yield piece
                self.filled.pop(window, None)
            else:
                self.held.setdefault(window, []).append(piece)
                self.filled[window] = offset + len(part) // 4

    def close(self) -> Iterator[tuple]:
        """Fills the fullest open windows from the ends of the emptiest ones; what one window holds in the end is cut
        into powers of two.  All other parts stay where the level array has put them."""
        order = sorted(self.held, key=lambda w: (-self.filled[w], w))
        full, last = 0, len(order) - 1
        while full < last:
            to, source = order[full], self.held[order[last]]
            doc, start, part, total, window, offset = source.pop()
            n = len(part) // 4
            take = min(self.size - self.filled[to], n)
            self.held[to].append((doc, start + n - take, part[4 * (n - take) :], total, to, self.filled[to]))
            self.filled[to] += take
            if take < n:
                source.append((doc, start, part[: 4 * (n - take)], total, window, offset))
            self.filled[order[last]] -= take
            if self.filled[to] == self.size:
                yield from self.held[to]
                full += 1
            last -= not source
        rest = self.held[order[last]] if full == last else []
        left, window, room = sum(len(p[2]) // 4 for p in rest), self.levels.used, 0
        for doc, start, part, total, _, _ in rest:
            while part:
                if not room:
                    window, room = window + 1, 1 << (left.bit_length() - 1)
                    size = room
                take = min(room, len(part) // 4)
                yield doc, start, part[: 4 * take], total, window, size - room
                start, part, room, left = start + take, part[4 * take :], room - take, left - take
        self.held.clear()


def _columns(rows: list[tuple], shard: int) -> pa.RecordBatch:
    cols = list(zip(*((d, s, len(p) // 4, zlib.crc32(p), n, (shard << 40) + w, o) for d, s, p, n, w, o in rows)))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(_FIELDS))


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = WINDOW) -> DataFrame:
    """One row for each piece; see the module's docstring."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, packer, shard, out = wordbpe.words(tokenizer), Packer(size), TaskContext.get().partitionId(), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += packer.add(doc, vocabulary.packed(text.as_py()) + wordbpe.END)
                if len(out) >= 4096:
                    yield _columns(out, shard)
                    out = []
        out += packer.close()
        if out:
            yield _columns(out, shard)

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
