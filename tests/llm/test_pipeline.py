"""The corpus pipeline, stage by stage, against plain versions."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op9_quality_rules
from tests.llm import brute
from tests.llm.test_text_ops import corpus, edited, prose


@pytest.fixture()
def docs(spark):
    rows = corpus() + [(500, "# % & $ " * 60), (501, prose(600, 80) + " call +1 (988) 555-2485"), (502, edited(prose(600, 80), 1, 2) + " or bo.42@mail8.example.com")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")


def test_stages(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, "")
    expected = {i for i, t in texts.items() if not op9_quality_rules.failed_bits(op9_quality_rules.measure((t or "").encode()))}
    assert {r.doc_id for r in kept.collect()} == expected and kept.columns == columns

    one = stages["near_duplicates"](spark, kept, "")
    near = brute.near([(i, texts[i]) for i in expected])
    left = {i for i, (_, _, k) in near.items() if k}
    assert sorted(r.doc_id for r in one.collect()) == sorted(left) and one.columns == columns

    cut = stages["repeated_passages"](spark, one, "")
    plain = brute.repeats([(i, texts[i]) for i in left])
    rows = {r.doc_id: r for r in cut.collect()}
    assert set(rows) == left and cut.columns == columns
    for i, (size, removed, _, digest) in plain.items():
        assert len(rows[i].text.encode()) == size - removed and rows[i].n_chars == len(rows[i].text)

    private = stages["personal_data"](spark, cut, "")
    out = {r.doc_id: r.text for r in private.collect()}
    assert private.columns == columns and set(out) == left
    assert not any("555-2485" in t or "bo.42@" in t for t in out.values())
    assert sum(out[i] != rows[i].text for i in left) == sum("555-2485" in rows[i].text or "bo.42@" in rows[i].text for i in left)

    packed = stages["packing"](spark, private, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.agg(F.count_distinct("doc_id")).first()[0] > 30
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
