"""Texts of megabytes through all operators: whole results, in bounded time."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op1_warc, op2_telephony, op3_packing, op4_lsh_forest, op5_byte_bpe, op6_factorisation, op7_suffix_dedup, op8_pseudonyms, op9_quality_rules, op10_bfd


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randrange(2, 9))) for _ in range(n))


LONG = words(1, 350_000)  # about 2 MB
TEXTS = {1: LONG, 2: LONG[:-40] + " " + words(2, 5), 3: "".join(random.Random(3).choices("abcdefgh0123", k=2_000_000)), 4: "\n".join([words(4, 12)] * 25_000), 5: "a" * 1_500_000, 6: "short text of five words and more", 7: "@" * 600_000 + "1" * 600_000}


@pytest.fixture()
def docs(spark):
    rows = spark.createDataFrame([(i, t) for i, t in TEXTS.items()], "doc_id long, text string")
    return rows.withColumn("n_chars", F.length("text"))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates(docs):
    got = by_id(op4_lsh_forest.near_duplicates(docs))
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert got[1].n_shingles > 340_000 and got[3].n_shingles == 1


def test_repeated_passages(docs):
    got = by_id(op7_suffix_dedup.remove_repeats(docs))
    assert got[1].n_removed == 0 and got[2].n_bytes - got[2].n_removed < 120 and got[3].n_removed == 0
    assert got[4].n_removed > 0.99 * got[4].n_bytes and got[5].n_removed == 1_500_000 - 1 - 0 and got[6].n_removed == 0


def test_tokens(docs):
    got = by_id(op5_byte_bpe.encode_and_decode(docs))
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in TEXTS.items())
    pieces = op3_packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == len(TEXTS) and all(r.n == r.all for r in pieces)
    rows = op10_bfd.pack(docs).select("n_tokens", F.length("ids").alias("n")).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.all for r in pieces) and all(r.n == 4 * op10_bfd.ROW for r in rows)


def test_rules_and_scores(docs):
    book = by_id(op9_quality_rules.ledger(docs))
    assert book[1].n_words == 350_000 and book[4].n_dup_lines == 24_999 and book[5].n_words == 1
    model = op6_factorisation.fit([op6_factorisation.features(b"a b", 3), op6_factorisation.features(b"c", 1)], [0, 1])
    scores = by_id(op6_factorisation.scored(docs, model))
    assert len(scores) == len(TEXTS) and all(0 <= r.score <= 1 for r in scores.values())


def test_audio(docs):
    got = by_id(op2_telephony.decode_columns(docs))
    for i, t in TEXTS.items():
        body = t.encode()
        assert got[i].payload_sha256 == hashlib.sha256(body + bytes(-len(body) % 64)).hexdigest()


def test_pseudonyms(docs):
    secret = "x" * 300_000
    more = docs.select("doc_id", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" mail bo.42@mail8.example.com"))).when(F.col("doc_id") == 6, F.concat(F.lit("token="), F.lit(secret))).otherwise(F.col("text")).alias("text"))
    got = {r.doc_id: r.text for r in op8_pseudonyms.pseudonymised(more).collect()}
    assert got[1].startswith(LONG) and "bo.42@" not in got[1] and all(got[i] == TEXTS[i] for i in (2, 3, 4, 5))
    assert len(got[6]) == 6 + len(secret) and secret[:50] not in got[6]


def test_pages(spark):
    html = "<html lang=en><title>t</title>" + "<p>one &amp; <a href=x>two</a>" * 120_000
    (row,) = op1_warc.derivatives(op1_warc.captured(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()
    assert (row.title, row.language, row.links, row.n_text_bytes) == ("t", "en", ["x"], 1 + 120_000 * len("\none & two"))
