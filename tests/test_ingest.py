"""Rows taken in once: the index of known ids."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import ingest
from sparkloom.sources.versions import Store

ROWS = "id string, v long"


def batch(spark, ids, v=0):
    return spark.createDataFrame([(None if n is None else f"r{n}", v) for n in ids], ROWS)


@pytest.fixture()
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest.begin(store, ROWS, blocks=4, buckets=16)
    ingest.absorb(store, 0, batch(spark, [*range(50), 7, None]))
    return store


def held(store):
    return {(r.id, r.v) for r in store.read("known").collect()}


def test_each_id_once(spark, store):
    ingest.absorb(store, 1, batch(spark, range(30, 80), 1).unionByName(batch(spark, [79], -5)))
    want = {(f"r{n}", 0 if n < 50 else 1 if n < 79 else -5) for n in range(80)}
    assert held(store) == want and store.read("known").count() == 80 == store.note("known")["rows"]
    version = store.versions()[-1]
    ingest.absorb(store, 1, batch(spark, range(500), 1))  # run again
    assert store.versions()[-1] == version
    ingest.absorb(store, 2, batch(spark, []))
    assert held(store) == want


def test_the_filter_misses_nothing_and_keeps_files_unread(spark, store):
    ids = batch(spark, range(1000)).select("id")
    maybe = {r.id for r in ingest.maybe_known(store, ids).collect()}
    assert {f"r{n}" for n in range(50)} <= maybe and len(maybe) < 150
    new = batch(spark, range(1000)).select("id").where(~F.col("id").isin(list(maybe)))
    assert new.count() > 850 and ingest.maybe_known(store, new).count() == 0
    assert store.of_keys("known", new.limit(0)).inputFiles() == []  # no bucket is touched
    one = store.of_keys("known", batch(spark, [3]).select("id")).inputFiles()
    assert 0 < len(one) < len(store.read("known").inputFiles())


def test_compaction_changes_files_alone(spark, store):
    for n in range(1, 4):
        ingest.absorb(store, n, batch(spark, range(n * 100, n * 100 + 90), n))
    before, files, blocks = held(store), store.tables()["tables"]["known"]["files"], store.note("known")["blocks"]
    assert max(len(at) for at in files.values() if not isinstance(at, str)) == 4
    assert ingest.compact(store, 2) > 0 and held(store) == before
    assert store.note("known")["blocks"] > blocks == 4
    assert all(isinstance(at, str) or len(at) <= 2 for at in store.tables()["tables"]["known"]["files"].values())
    maybe = {r.id for r in ingest.maybe_known(store, batch(spark, range(3000)).select("id")).collect()}
    assert {i for i, _ in before} <= maybe and len(maybe) < 500
    assert ingest.compact(store, 2) == 0
    assert store.vacuum() > 0 and held(store) == before
    ingest.absorb(store, 9, batch(spark, range(400), 9))
    assert len(held(store)) == store.read("known").count() == 400


def test_a_crash_leaves_rows_and_filter_as_they_were(spark, store, monkeypatch):
    def dies(*given):
        raise RuntimeError("dead")

    before = held(store)
    monkeypatch.setattr(store, "_commit", dies)
    with pytest.raises(RuntimeError):
        ingest.absorb(store, 1, batch(spark, range(90), 1))
    monkeypatch.undo()
    assert held(store) == before
    ingest.absorb(store, 1, batch(spark, range(90), 1))
    assert len(held(store)) == store.read("known").count() == 90
