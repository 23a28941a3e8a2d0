"""Ranked search, licence scan and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op11_tput, op12_license_scan, op13_hard_negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_search(queries, docs, k=10):
    """(item, rank, doc, score) by the contract's formulas, every document scored."""
    held = [(i, TERM.findall((t or "").translate(CAPITALS))) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n_docs, length = len(held), sum(len(ts) for _, ts in held)
    df = Counter(t for _, ts in held for t in set(ts))
    asked = {}
    for item, text in queries:
        asked.setdefault(item, []).extend(TERM.findall((text or "").translate(CAPITALS)))
    out = []
    for item, words in asked.items():
        rows = []
        for at, (i, ts) in enumerate(held):
            tf, score = Counter(ts), 0
            m = 25 + (75 * len(ts) * n_docs) // length
            for w in words:
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0, at, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, _, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def lexical():
    draw = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["ÉTÉ", "été", "Straße", "42", "x_y", "A-b"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(draw.choices(words, weights, k=draw.randrange(1, 60)))) for k in range(400)]
    docs += [(k, docs[7][1]) for k in range(500, 560)]  # many of one score
    docs += [(900, None), (901, ""), (902, "--- ..."), (None, docs[8][1]), (None, docs[8][1]), (903, docs[9][1]), (903, docs[9][1]), (904, "w3 " * 30_000)]
    queries = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 12)))) for k in range(40)]
    queries += [(50, docs[7][1]), (51, docs[8][1]), (52, None), (53, ""), (54, "nowhere"), (55, "w1 w1 w1 w2"), (56, docs[9][1]), (56, "w5")]
    return queries, docs


@pytest.mark.parametrize("how", [{}, {"most_terms": 3}, {"part": 7}, {"k": 1}, {"pairs": 40}])
def test_search_equals_scoring_every_document(spark, frame, how):
    queries, docs = lexical()
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = op11_tput.search(asked, frame(docs), **how).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == slow_search(queries, docs, how.get("k", 10))


def test_search_of_empty_tables(spark, frame):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op11_tput.search(asked, frame([])).count() == 0
    assert op11_tput.search(asked.limit(0), frame([(1, "a b")])).count() == 0


def slow_scan(text):
    low = (text or "").translate(CAPITALS)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(low)
    base = sorted((k, label) for phrase, label in op12_license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    labels, score, blocks = {label for _, label in base}, 1.0 if base else 0.0, set()
    lines = low.split("\n")
    runs, run = [], []
    for line in lines:
        if word.search(line):
            run.append(line)
        elif run:
            runs, run = [*runs, "\n".join(run)], []
    runs += ["\n".join(run)] if run else []
    for label, template in op12_license_scan.TEMPLATES:
        wanted = set(word.findall(template.translate(CAPITALS)))
        long = len(wanted) > op12_license_scan.SHORT
        for k, block in enumerate(runs if long else lines):
            shared = len(wanted & set(word.findall(block)))
            if 100 * shared >= op12_license_scan.PERCENT * len(wanted):
                labels.add(label)
                blocks.add((long, k))
                score = max(score, shared / len(wanted))
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, len(blocks)


def licensed():
    draw = random.Random(5)
    mit, bsd = (next(t for x, t in op12_license_scan.TEMPLATES if x == label and len(t) > 90) for label in ("mit", "bsd"))
    wrapped = "\n".join(re.sub(r"(.{40,60}) ", r"\1\n", mit).split("\n"))
    fewer = lambda text, n: " ".join(w for k, w in enumerate(text.split()) if k not in draw.sample(range(len(text.split())), n))
    texts = [None, "", "\n\n \n", "plain words only", "Under the MIT license under the MIT license", "under-the-mit-LICENSE", "licensed under cc by nc 4.0", "GNU GENERAL PUBLIC LICENSE\nversion 3"]
    texts += [mit, wrapped, f"intro\n\n{wrapped}\n***\nrest", fewer(mit, 2), fewer(mit, 12), fewer(bsd, 1), fewer(bsd, 4), bsd.upper()]
    texts += ["this work is licensed under the GNU General Public License, version 3.", "version 3 of the gnu public general license", "apache license version 2 " * 4000, ("word " * 5000 + "\n") * 20 + "Released under the MIT License."]
    texts += [f"{label} {text}" for label, text in op12_license_scan.TEMPLATES]
    return [(k, t) for k, t in enumerate(texts)] + [(3, "plain words only"), (None, mit)]


def test_licences_equal_comparing_all_blocks(frame):
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks")
    got = sorted(((r.doc_id, *(r[c] for c in columns)) for r in op12_license_scan.scanned(frame(licensed())).collect()), key=repr)
    assert got == sorted(((i, *slow_scan(t)) for i, t in licensed()), key=repr)
    assert op12_license_scan.scanned(frame([])).count() == 0


def test_licence_blocks(frame):
    rows = op12_license_scan.template_matches(frame([(1, "a\nReleased under the MIT License.\nb"), (2, "nothing")])).collect()
    assert [(r.doc_id, r.kind, r.block, r.label, r.n_block, r.n_shared, r.containment) for r in rows] == [(1, "line", 1, "mit", 5, 5, 1.0)]


def slow_negatives(rows):
    rows = {i: (label, np.array(v, object)) for i, label, v in rows}
    dim = max((len(v) for _, v in rows.values()), default=0)
    rows = {i: (label, np.append(v, np.zeros(dim - len(v), object))) for i, (label, v) in rows.items()}
    out = []
    for a, (label, q) in rows.items():
        if a % 50:
            continue
        scored = sorted((-int(sum(q * v)), i, other == label) for i, (other, v) in rows.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(-t, i) for t, i, same in scored if not same and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "copies", "large", "huge"])
@pytest.mark.parametrize("how", [{}, {"lists": 7, "block": 20, "first": 1}])
def test_negatives_equal_all_pairs(spark, kind, how):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8))
    v = centres[draw.integers(0, 12, 600)] + 0.4 * draw.normal(size=(600, 8))
    if kind == "copies":
        v[50:350] = v[50]
    v *= {"large": 1e5, "huge": 2e6}.get(kind, 1)
    table = [(int(k), [float(x) for x in row], int(draw.integers(0, 4))) for k, row in enumerate(v)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = op13_hard_negatives.hard_negatives(op13_hard_negatives.entrants(df, "vec_id", "embedding", F.col("label")), **how)
    want = slow_negatives([(k, label, [math.floor(256 * x) for x in row]) for k, row, label in table])
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == want
    assert want


def test_negatives_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 2.0], 1), (1, [1.0, nan], 1), (2, [inf, 1.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    table += [(6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (7, [0.5, 1.0], 2), (8, [0.5, 1.0], 2), (9, [1.0], 2), (10, [], 2), (50, [-1.0, -1.0], 3), (100, [1e300, -1e300], 4)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("list", F.lit("clash")).withColumn("id", F.lit("clash"))
    rows = op13_hard_negatives.entrants(df.where("vec_id IS NULL OR vec_id < 100"), "vec_id", "embedding", F.col("label"))
    got = sorted(tuple(r) for r in op13_hard_negatives.hard_negatives(rows).collect())
    assert got == [(0, 6, 1, 7, 327680, 163840), (0, 6, 2, 8, 327680, 163840)]
    assert op13_hard_negatives.hard_negatives(op13_hard_negatives.entrants(df, "vec_id", "embedding", F.col("label"))).count() >= 0
    assert op13_hard_negatives.hard_negatives(rows.limit(0)).count() == 0


def test_bounds_hold_for_every_row(spark):
    draw = np.random.default_rng(1)
    v = draw.normal(size=(500, 6))
    df = spark.createDataFrame([(k, row.tolist(), 0) for k, row in enumerate(v)], "vec_id long, embedding array<double>, label int")
    index, dealt = op13_hard_negatives.build(op13_hard_negatives.entrants(df, "vec_id", "embedding", F.col("label")), lists=9, block=30)
    q = np.floor(256 * draw.normal(size=(20, 6)))
    lower, upper = index.bounds(q)
    for r in dealt.collect():
        s = q @ index.unpacked([bytes(r.vector)])[0]
        assert (lower[:, r.list] <= s).all() and (s <= upper[:, r.list]).all()
