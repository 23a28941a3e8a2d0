"""Content-defined anchors of a byte collection (numpy, vectorised over many documents).

Every stretch of ``WINDOW`` bytes picks one of its ``GRAM``-byte substrings: the one with
the smallest hash, leftmost on ties.  The choice depends on the stretch alone, so equal
stretches pick equal substrings at equal offsets, wherever they stand.  Runs of neighbouring
stretches that pick the same substring form one *segment*.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
GRAM = 37
SPAN = WINDOW - GRAM + 1  # grams in a window: 64, so that six doublings make a sliding minimum
CHUNK = 1 << 20

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, over an array."""
    with np.errstate(over="ignore"):
        x = x.astype(_U) + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = splitmix(np.arange(256))
_MUL = splitmix(np.arange(1000, 1008)) | _U(1)
_BASE = int(_MUL[7])
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            pair = []
            for base in (_BASE, _BASE_INV):
                p = np.empty(size, _U)
                p[0], done, step = 1, 1, base
                while done < size:
                    p[done : 2 * done] = p[:done] * _U(step)
                    done, step = 2 * done, step * step % (1 << 64)
                pair.append(p)
        _POWERS[size] = (pair[0], pair[1])
    return _POWERS[size]


def grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each substring of GRAM = 32 + 4 + 1 bytes."""
    with np.errstate(over="ignore"):
        h1 = _BYTE[data]
        h2 = h1[:-1] * _MUL[0] + h1[1:]
        h4 = h2[:-2] * _MUL[1] + h2[2:]
        h8 = h4[:-4] * _MUL[2] + h4[4:]
        h16 = h8[:-8] * _MUL[3] + h8[8:]
        h32 = h16[:-16] * _MUL[4] + h16[16:]
        n = len(data) - GRAM + 1
        h = h32[:n] * _MUL[5] + h4[32 : 32 + n] * _MUL[6] + h1[36 : 36 + n]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


def window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of the WINDOW bytes at each start."""
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
        return splitmix((prefix[starts + WINDOW] - prefix[starts]) * inverse[starts])


def segments(data: np.ndarray, ends: np.ndarray, contents: bool = True) -> dict[str, np.ndarray]:
    """Segments of concatenated documents; ``ends`` are the documents' ends in ``data``.

    Returns arrays: doc (index of the document), start (of the first stretch, within the
    document), count (stretches), shift (of the anchor from start), gram (anchor hash),
    content (hash of the bytes that the segment's stretches cover, with shift and length; only if ``contents``).
    """
    parts = []
    begins = np.concatenate([[0], ends[:-1]])
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + CHUNK, side="right")))
        parts.append(_segments(data[begins[lo] : ends[hi - 1]], begins[lo:hi] - begins[lo], ends[lo:hi] - begins[lo], lo, contents))
        lo = hi
    keys = ("doc", "start", "count", "shift", "gram", "content")[: 6 if contents else 5]
    types = (np.int64, np.int64, np.int64, np.int64, _U, _U)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in zip(keys, types)}


def _segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: int, contents: bool) -> dict[str, np.ndarray]:
    n = len(data) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return {"doc": none, "start": none, "count": none, "shift": none, "gram": none.astype(_U), "content": none.astype(_U)}
    g = grams(data)
    bits = _U(max(20, int(len(data)).bit_length()))
    low = (_U(1) << bits) - _U(1)
    v = (g & ~low) | np.arange(len(g), dtype=_U)
    step = 1
    while step < SPAN:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    pick = (v[:n] & low).astype(np.int64)
    size = ends - begins
    owner = np.repeat(np.arange(len(ends)), size)[:n]
    inside = np.arange(n) + WINDOW <= ends[owner]
    at = np.flatnonzero(inside)
    if not len(at):
        return _segments(data[:0], begins, ends, first, contents)
    p, o = pick[at], owner[at]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    start, count = at[head], at[last] - at[head] + 1
    anchor, doc = p[head], o[head]
    shift = anchor - start
    found = {"doc": doc + first, "start": start - begins[doc], "count": count, "shift": shift, "gram": g[anchor]}
    if contents:
        power, inverse = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(data) + 1, _U)
            np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
            body = (prefix[start + count - 1 + WINDOW] - prefix[start]) * inverse[start]
            found["content"] = splitmix(body ^ splitmix((count * 4096 + shift).astype(_U)))
    return found
