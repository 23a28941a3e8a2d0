"""Queries on inputs that the given tables lack, against their SQL."""

import duckdb
import pytest

from sparkloom import plans
from tests.test_queries import rows

SCHEMAS = {
    "documents": "doc_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Whether a query of one small table gives what its SQL does."""

    def check(name, table, values):
        spark.createDataFrame(values, SCHEMAS[table]).repartition(2).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        result = con.execute(plans.oracles()[name])
        names = [d[0] for d in result.description]
        df = plans.queries()[name](spark, str(tmp_path))
        got = df.collect()
        assert rows(df.columns, got) == rows(names, result.fetchall())
        return got

    return check


def test_transcripts_keep_what_is_said_twice(same_as_sql):
    texts = ["Be.\nBe.", "Be.", "a <b> & &amp; --> c", " \n\n7\r\n \fNOTE x\n", None, "", "\xa0no\x0bbreak\xa0", "WEBVTT", "12\n12"]
    turns = [(1, k, "user", x) for k, x in enumerate(texts)] + [(2, 150 + k, "user", str(k % 2)) for k in range(120)]
    turns += [(3, 0, "user", None), (4, 0, "user", ""), (5, 1, "user", "one"), (5, None, "user", "last"), (None, 1, "user", "x")]
    assert len(same_as_sql("transcript_text", "conversations", turns)) == 6


def test_large_vocabularies_by_a_filter(spark):
    """Terms of one to seven words, beyond what an automaton is made for, against all runs of each text."""
    import random

    from sparkloom.operators import catalogue

    draw = random.Random(5)
    words = ["a", "été", "b_1", "漢字", "x" * 300, "und", "der"]
    line = lambda n: " ".join(draw.choices(words, k=n))
    terms = list({(f"t{k % 3}", line(draw.randrange(1, 8)), bool(k % 2)) for k in range(400)}) + [("t0", "und-der", True), ("t0", "und der", False), ("t1", "?", True)]
    items = [(k, line(draw.randrange(0, 12)), line(draw.randrange(0, 60))) for k in range(60)] + [(60, None, None), (61, "", " Der, ÉTÉ: ")]
    df = spark.createDataFrame(items, "idx long, title string, abstract string").selectExpr("*", "CAST(array() AS array<string>) AS concepts")
    vocabulary = spark.createDataFrame(terms, "topic string, term string, strong boolean")
    got, want = (sorted(map(tuple, catalogue.topic_scores(df, vocabulary, [], most).collect())) for most in (3, 100_000))
    assert got == want and len(got) > 60


def test_runs_split_a_text_once(spark):
    from sparkloom.functions import vocabulary
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("One, two three",), ("",), (None,)], "x string").select(vocabulary.runs(F.coalesce("x", F.lit("")), [2, 1]).alias("r"))
    assert [r.r for r in df.collect()] == [["one", "two", "three", "one two", "two three"], [], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_values_become_objects_some_at_a_time():
    import pyarrow as pa

    from sparkloom.functions import batches

    alive, most = set(), [0]

    class Made(str):
        def __del__(self):
            alive.discard(id(self))

    def one(x):
        made = Made(x or "")
        alive.add(id(made))
        most[0] = max(most[0], len(alive))
        return made

    values = [None, *map(str, range(999))]
    assert batches.in_parts(pa.array(values), one, pa.string()).to_pylist() == ["", *values[1:]]
    assert batches.in_parts(pa.array([], pa.string()), one, pa.string()).to_pylist() == [] and most[0] <= 2 * batches.ROWS


def test_no_column_function_makes_a_batch_of_objects():
    from sparkloom.functions import html, text, vocabulary
    from pyspark.util import PythonEvalType

    own = [html.html_text, html.feed_items, html.transcript_text, html.sitemap_places, html.decoded_text, html.page_paragraphs, text.normalised, vocabulary.finder(vocabulary.Automaton([("a",)]))]
    assert {f.evalType for f in own} == {PythonEvalType.SQL_SCALAR_ARROW_UDF}


def test_batches_are_bounded_in_bytes(spark, data):
    plans.queries()["html_text"](spark, data)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b"


def test_inverted_texts_do_not_move(spark, data, same_as_sql):
    df = plans.queries()["inverted_abstract"](spark, data)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    texts = ["b a b  a\tb", "", " ", "one", "é É\n\né \x0b x", None, "a " * 3000]
    assert len(same_as_sql("inverted_abstract", "documents", list(enumerate(texts)))) == 6


def test_a_backlog_is_read_in_few_versions(spark, tmp_path, monkeypatch):
    from sparkloom.sources import arrivals
    from sparkloom.sources.versions import Store

    monkeypatch.setattr(arrivals, "SORTED", 25)
    log = spark.createDataFrame([(k % 380, 10 * k) for k in range(400)], "id long, arrived long")
    store = Store(spark, str(tmp_path / "arrivals"))
    arrivals.begin(store, log, buckets=2)
    assert arrivals.follow(store, log, 10**6, margin_ms=50, rows=20) == 400
    assert len(store.versions()) < 12  # twenty pages and one before
    assert {tuple(r) for r in store.read(arrivals.NAME).collect()} == {(k % 380, 10 * k) for k in range(20, 400)}
