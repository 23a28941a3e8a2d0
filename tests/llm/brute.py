"""Plain versions of what operators compute, for small inputs."""

import hashlib
from collections import defaultdict


def repeats(docs, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what stays), for distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        body = (text or "").encode()
        cover = bytearray(len(body))
        for s in range(len(body) - length + 1):
            window = body[s : s + length]
            if window in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, c in zip(body, cover) if not c)
        out[i] = (len(body), sum(cover), sum(1 for k in range(len(body)) if cover[k] and not (k and cover[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near(docs):
    """doc_id -> (n_shingles, component_id, kept), all pairs compared."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                shared[j] += 1
            where[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
