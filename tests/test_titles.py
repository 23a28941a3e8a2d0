"""Similar titles against all pairs compared."""

import difflib
import random

import pytest

from sparkloom import plans
from sparkloom.operators import titles

ITEMS = "id long, title string"


def compared(classes, percent):
    known = sorted((r.class_id, r.plain) for r in classes.collect())
    out = {}
    for k, (a, x) in enumerate(known):
        for b, y in known[k + 1 :]:
            matcher = difflib.SequenceMatcher(None, x, y)
            if matcher.real_quick_ratio() >= percent / 100 and matcher.quick_ratio() >= percent / 100 and matcher.ratio() >= percent / 100:
                out[a, b] = round(matcher.ratio(), 9)
    return out


def joined(classes, percent):
    return {(r.first, r.second): round(r.ratio, 9) for r in titles.similar(classes, percent).collect()}


def damaged(chance, line):
    letters = list(line)
    for _ in range(chance.randrange(1, 6)):
        at = chance.randrange(len(letters) + 1)
        letters[at : at + chance.randrange(2)] = chance.choice(["", "x", "é", "𝒳", " "])
    return "".join(letters)


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_equal_to_all_pairs(spark, percent):
    chance = random.Random(percent)
    lines = ["a", "ab", "abc", "abcd", "aaaa", "aaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 41, "", None, "Été  à Rome!", "ete a rome", "?!"]
    for _ in range(25):
        line = " ".join("".join(chance.choices("abcdeiou", k=chance.randrange(1, 9))) for _ in range(chance.randrange(1, 12)))
        lines += [line] + [damaged(chance, line) for _ in range(3)]
    rows = [*enumerate(lines), (None, "no id"), (500, lines[20])]
    classes = titles.classes(spark.createDataFrame(rows, ITEMS))
    got = joined(classes, percent)
    assert got == compared(classes, percent) and len(got) > 10
    assert sum(r.copies for r in classes.collect()) == len(rows) - 4


def test_given_titles_equal_all_pairs(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS id", "split(text, '\\n')[0] AS title")
    classes = titles.classes(documents)
    want = compared(classes, 95)
    assert {(r.idx, r.like): r.ratio for r in plans.queries()["similar_titles"](spark, data).collect()} == {k: round(v, 6) for k, v in want.items()}
    assert joined(classes, 80) == compared(classes, 80)


def test_no_titles(spark):
    assert joined(titles.classes(spark.createDataFrame([], ITEMS)), 95) == {}
    with pytest.raises(ValueError):
        titles.similar(titles.classes(spark.createDataFrame([], ITEMS)), 100)


def test_candidates_are_few(spark):
    """Of two million pairs of unrelated titles, two fifths of whose characters are the same, some 14,000 are compared."""
    chance = random.Random(3)
    words = ["".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randrange(3, 10))) for _ in range(3000)]
    rows = [(n, "the study of " + " ".join(chance.choices(words, k=8)) + " in the field of medicine") for n in range(2000)]
    texts = titles.classes(spark.createDataFrame(rows, ITEMS)).selectExpr("class_id", "plain", "CAST(length(plain) AS LONG) AS n")
    assert titles._candidates(texts, 95, titles.gram_length(95)).count() < 20_000


def test_no_row_for_each_gram(spark):
    """Titles of one template with a fifth of their characters their own: none of the 500,000 pairs is handed on."""
    chance = random.Random(4)
    rows = [(n, "a long introduction to the theory and the practice of " + "".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=20)) + " in the age of medicine") for n in range(1000)]
    texts = titles.classes(spark.createDataFrame(rows, ITEMS)).selectExpr("class_id", "plain", "CAST(length(plain) AS LONG) AS n")
    assert titles._candidates(texts, 95, titles.gram_length(95)).count() < 50


def test_blocks_meet_once(spark):
    """Ranges in many small blocks: each pair comes once, and those of one block for all are the same."""
    chance = random.Random(5)
    lines = [" ".join(chance.choices(["some", "words", "of", "a", "title"], k=chance.randrange(1, 15))) for _ in range(60)]
    rows = list(enumerate(lines + [damaged(chance, line) for line in lines * 3]))
    classes = titles.classes(spark.createDataFrame(rows, ITEMS))
    texts = classes.selectExpr("class_id", "plain", "CAST(length(plain) AS LONG) AS n")
    whole, blocks = ([tuple(r) for r in titles._candidates(texts, 90, 2, most).collect()] for most in (10_000, 7))
    assert len(set(blocks)) == len(blocks) and set(blocks) == set(whole) and {(min(p), max(p)) for p in blocks} >= compared(classes, 90).keys()
