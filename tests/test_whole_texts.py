"""Topic scores read texts to their ends."""

import duckdb
import pytest

from sparkloom import plans
from sparkloom.operators import catalogue
from sparkloom.plans import library
from sparkloom.tables import Tables
from tests.test_queries import rows

FAR = "filler " * 900  # 6,300 characters
DOCUMENTS = [
    (1, f"A title\n{FAR}zebra crossing ahead"),
    (2, f"zebra crossing\n{FAR}Zébra CROSSING"),
    (3, f"{FAR}zebra crossing ahead"),
    (4, f"\n{'𝒳 漢 ' * 3000}zebra-crossing"),
    (5, None),
    (6, ""),
    (7, "no term here\n"),
    (8, f"A title\n{FAR}crossing"),
    (8, "zebra crossing\ncrossing"),
    (None, f"\n{FAR}ahead"),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(k, text, "en", "src1") for k, text in DOCUMENTS], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Zebra crossing ahead, and a title of one and two"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_scores_of_terms_far_into_texts(spark, folder):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    result = con.execute(plans.oracles()["topic_scores_long"])
    want = rows([d[0] for d in result.description], result.fetchall())
    df = plans.queries()["topic_scores_long"](spark, folder)
    got = df.collect()
    assert rows(df.columns, got) == want
    assert {1, 2, 3, 4, 8} <= {r.idx for r in got}

    t = Tables(spark, folder)
    filtered = catalogue.topic_scores(library.items(t, None), library.long_vocabulary(t), [], 1)
    assert rows(filtered.columns, filtered.collect()) == want


def test_texts_are_read_once_for_terms(spark, folder):
    t = Tables(spark, folder)
    for most, step in ((100_000, "ArrowEvalPython"), (1, "MapInArrow")):
        df = catalogue.topic_scores(library.items(t, None), library.long_vocabulary(t), [], most)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count(step) == 1 and plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
