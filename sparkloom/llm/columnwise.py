"""Column-wise construction over many documents: one symbol per document and round.

The documents of a collection stand in rows, aligned at a common column.  Rounds go from the
last column to the first.  A round reads, in the order of the suffixes found so far, the symbol
that precedes each suffix - that is the round's part of the Burrows-Wheeler transform - and a
stable sort by it gives the order of the suffixes that start one column further left.  The
longest common prefix of neighbours follows from the last round's: one more than the smallest
value between the two old places where the symbols are equal, else none.

Symbols lie column by column in external files that are written once and read once, in
sequence; only the order, the common prefixes and one column are in memory (about 20 bytes a
document).  Rows shorter than the collection are padded; a pad equals nothing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

PAD = 0  # bytes are stored as 1 to 256
IN_MEMORY = 64 << 20


class Columns:
    """The collection's symbols, column by column; files beyond IN_MEMORY bytes, gone when closed."""

    def __init__(self, width: int):
        self.width, self.rows, self.blocks = width, 0, []
        self.file = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)

    def add(self, matrix: np.ndarray) -> None:
        """Rows of uint16 symbols, stored transposed as one block."""
        self.blocks.append((self.file.tell(), len(matrix)))
        self.file.write(np.ascontiguousarray(matrix.T).tobytes())
        self.rows += len(matrix)

    def column(self, k: int) -> np.ndarray:
        out, at = np.empty(self.rows, np.uint16), 0
        for begin, n in self.blocks:
            self.file.seek(begin + 2 * k * n)
            out[at : at + n] = np.frombuffer(self.file.read(2 * n), np.uint16)
            at += n
        return out

    def close(self) -> None:
        self.file.close()


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first[i] : last[i] + 1]), by doubling; only the levels that some range needs."""
    size = last - first + 1
    out = values[last].copy()
    level = np.frexp(size.astype(np.float64))[1] - 1
    table, k = values, 0
    for top in range(1, int(level.max(initial=0)) + 1):
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1
        if len(at := np.flatnonzero(level == top)):
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << top) + 1])
    return out


def rounds(columns: Columns) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, order, common prefixes with the previous row in order, transform of the round), last column first."""
    order, common = np.arange(columns.rows), np.zeros(columns.rows, np.uint8)
    for k in range(columns.width - 1, -1, -1):
        transform = columns.column(k)[order]
        moved = np.argsort(transform, kind="stable")
        sorted_symbols = transform[moved]
        following = np.zeros(columns.rows, np.uint8)
        same = np.flatnonzero((sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] != PAD)) + 1
        if len(same):
            following[same] = np.minimum(range_minima(common, moved[same - 1] + 1, moved[same]), 254) + 1
        order, common = order[moved], following
        yield k, order, common, transform


def later_windows(columns: Columns, rank: np.ndarray, length: int, starts: int) -> np.ndarray:
    """Per row, a bit for each of the first ``starts`` (at most 64) columns at which an equal string
    of ``length`` symbols stands in a row of smaller rank."""
    found = np.zeros(columns.rows, np.uint64)
    for k, order, common, _ in rounds(columns):
        if k >= starts:
            continue
        head = np.flatnonzero(common < length)
        if len(head) == columns.rows:
            continue
        ranks = rank[order]
        least = np.minimum.reduceat(ranks, head)
        late = ranks > np.repeat(least, np.diff(np.append(head, columns.rows)))
        found[order[late]] |= np.uint64(1) << np.uint64(k)
    return found
