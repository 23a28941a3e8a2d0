"""Sets of five-word shingles as sorted 64-bit hashes, and their MinHash sketches (numpy)."""

from __future__ import annotations

import numpy as np

from sparkloom.llm.anchors import _BYTE, _powers, splitmix

WORDS = 5
CHUNK = 1 << 20
_U = np.uint64


def normal(text: bytes) -> bytes:
    """A-Z in lower case, words (runs without 0x20 and 0x09 to 0x0D) joined by one space."""
    return b" ".join(text.lower().split())


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text, its distinct shingles' hashes in order; texts under five words have one shingle, empty ones none."""
    out: list[np.ndarray] = []
    clean = [normal(t) for t in texts]
    at = 0
    while at < len(clean):
        to, size = at, 0
        while to < len(clean) and (to == at or size + len(clean[to]) < CHUNK):
            size += len(clean[to]) + 1
            to += 1
        out += _chunk(clean[at:to])
        at = to
    return out


def _chunk(clean: list[bytes]) -> list[np.ndarray]:
    # Each text is followed by one space, so that a word's end is the place of the next space.
    data = np.frombuffer(b" ".join(clean) + b" ", np.uint8)
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
    stop = np.flatnonzero(data == 32)
    sets, begin, word = [], 0, 0
    for text in clean:
        if not text:
            sets.append(np.empty(0, _U))
            begin, word = begin + 1, word + 1
            continue
        last = int(np.searchsorted(stop, begin + len(text)))  # the space that ends the text
        ends = stop[word : last + 1]
        starts = np.append(begin, ends[:-1] + 1)
        if len(ends) > WORDS:
            starts, ends = starts[: len(ends) - WORDS + 1], ends[WORDS - 1 :]
        elif len(ends) > 0:
            starts, ends = starts[:1], ends[-1:]
        with np.errstate(over="ignore"):
            h = (prefix[ends] - prefix[starts]) * inverse[starts]
        sets.append(np.unique(splitmix(h)))
        begin, word = begin + len(text) + 1, last + 1
    return sets


def sketches(sets: list[np.ndarray], size: int, salt: int = 7) -> np.ndarray:
    """(len(sets), size) MinHash values of 16 bits; rows of empty sets are 0."""
    out = np.zeros((len(sets), size), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    seeds = splitmix(np.arange(2 * size) + (salt << 32))
    at = 0
    while at < len(full):
        to, n = at, 0
        while to < len(full) and (to == at or n + len(sets[full[to]]) < CHUNK // 8):
            n += len(sets[full[to]])
            to += 1
        part = [sets[k] for k in full[at:to]]
        data = np.concatenate(part)
        head = np.cumsum([0, *map(len, part[:-1])])
        rows = np.empty((size, len(part)), _U)
        work = np.empty_like(data)
        with np.errstate(over="ignore"):
            for k in range(size):
                np.bitwise_xor(data, seeds[2 * k], out=work)
                np.multiply(work, seeds[2 * k + 1] | _U(1), out=work)
                rows[k] = np.minimum.reduceat(work, head)
        out[full[at:to]] = (splitmix(rows) & _U(0xFFFF)).astype(np.uint16).T
        at = to
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)
