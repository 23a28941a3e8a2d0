"""Summaries kept by differences against summaries computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import summaries
from sparkloom.plans import streams
from sparkloom.sources.versions import Store
from sparkloom.tables import Tables

FACTS, DIMS = "id long, dim long, value long, gone boolean", "dim long, g string, gone boolean"


def anew(facts, dims):
    groups = {}
    for dim, value in facts.values():
        if dim is not None and dim in dims:
            groups.setdefault(dims[dim], []).append(value)
    out = {}
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        out[g] = (len(values), sum(known) if known else None, min(known, default=None), max(known, default=None))
    return out


def kept(store):
    return {r.g: (r.n, r.total, r.least, r.greatest) for r in summaries.summary(store).collect()}


def test_any_changes_equal_a_new_summary(spark, tmp_path):
    chance, store = random.Random(5), Store(spark, str(tmp_path / "s"))
    summaries.begin(store, {"g": "string"}, buckets=3)
    assert kept(store) == {}
    facts, dims = {}, {}
    for n in range(4):
        new_facts = {chance.randrange(40): (chance.choice([None, *range(6)]), chance.choice([None, -9000, 5, 4095, 4096, 70_000]), chance.random() < 0.3) for _ in range(25)}
        new_dims = {chance.choice([None, *range(6)]): (chance.choice([None, "a", "b"]), chance.random() < 0.3) for _ in range(4)}
        given = spark.createDataFrame([(k, *v) for k, v in new_facts.items()], FACTS), spark.createDataFrame([(k, *v) for k, v in new_dims.items()], DIMS)
        summaries.absorb(store, n, *given)
        for k, (dim, value, gone) in new_facts.items():
            facts.pop(k, None)
            if not gone:
                facts[k] = (dim, value)
        for k, (g, gone) in new_dims.items():
            dims.pop(k, None)
            if not gone:
                dims[k] = g
        assert kept(store) == anew(facts, dims)
        if n == 1:
            version = store.versions()[-1]
            summaries.absorb(store, n, *given)  # run again
            assert store.versions()[-1] == version
    everything = spark.createDataFrame([(k, None, None, True) for k in facts], FACTS)
    summaries.absorb(store, 9, everything, spark.createDataFrame([], DIMS))
    assert kept(store) == {} and store.read("counts").count() == store.read("held").count() == 0


@pytest.mark.parametrize("step", ["_written", "_commit"])
def test_a_crash_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"))
    summaries.begin(store, {"g": "string"}, buckets=2)
    dims = spark.createDataFrame([(1, "a", False)], DIMS)
    summaries.absorb(store, 0, spark.createDataFrame([(1, 1, 10, False), (2, 1, 20, False)], FACTS), dims)
    real, calls = getattr(store, step), []

    def dies(*given):
        calls.append(step)
        if step == "_commit" or len(calls) == 3:
            raise RuntimeError("dead")
        return real(*given)

    change = spark.createDataFrame([(2, 1, None, True), (3, 1, 7, False)], FACTS)
    monkeypatch.setattr(store, step, dies)
    with pytest.raises(RuntimeError):
        summaries.absorb(store, 1, change, dims.limit(0))
    monkeypatch.undo()
    assert kept(store) == {"a": (2, 30, 10, 20)}
    summaries.absorb(store, 1, change, dims.limit(0))
    assert kept(store) == {"a": (2, 17, 7, 10)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    summaries.begin(store, {"g": "string"}, buckets=32)
    dims = spark.createDataFrame([(d, f"g{d}", False) for d in range(40)], DIMS)
    summaries.absorb(store, 0, spark.createDataFrame([(n, n % 40, n * 100, False) for n in range(400)], FACTS), dims)
    before = store.tables()["tables"]
    summaries.absorb(store, 1, spark.createDataFrame([(7, 7, 1, False)], FACTS), dims.limit(0))
    after = store.tables()["tables"]
    for name in summaries.TABLES:
        files = {b: p for b, p in after[name]["files"].items() if before[name]["files"].get(b) != p}
        assert len(files) <= 1, name


def test_a_batch_is_computed_once(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "s")), spark.sparkContext.accumulator(0)
    summaries.begin(store, {"g": "string"}, buckets=2)

    @F.udf("long")
    def value(n):
        seen.add(1)
        return n

    facts = spark.range(100).select("id", F.lit(1).cast("long").alias("dim"), value("id").alias("value"), F.lit(False).alias("gone"))
    summaries.absorb(store, 0, facts, spark.createDataFrame([(1, "a", False)], DIMS))
    assert kept(store) == {"a": (100, 4950, 0, 99)} and seen.value == 100


def test_slots_of_one_group_lie_in_many_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    summaries.begin(store, {"g": "string"}, buckets=4)
    facts = spark.createDataFrame([(n, 1, n * summaries.SLOT, False) for n in range(40)], FACTS)
    summaries.absorb(store, 0, facts, spark.createDataFrame([(1, "a", False)], DIMS))
    assert len(store.tables()["tables"]["slots"]["files"]) == 4
    summaries.absorb(store, 1, facts.where("id < 30").withColumn("gone", F.lit(True)), spark.createDataFrame([], DIMS))
    assert kept(store) == {"a": (10, sum(range(30, 40)) * summaries.SLOT, 30 * summaries.SLOT, 39 * summaries.SLOT)}


def test_buckets_grow_with_the_facts(spark, tmp_path, monkeypatch):
    stores = []
    monkeypatch.setattr(summaries, "absorb", lambda store, *batch: stores.append(store))
    monkeypatch.setattr(summaries, "ROWS", 4)
    spark.range(100).selectExpr("id o_orderkey", "id o_custkey", "1.5D o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(5).selectExpr("id c_custkey", "1 c_nationkey", "'A' c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    streams.summary_by_differences(Tables(spark, str(tmp_path)))
    assert {t["buckets"] for t in stores[0].tables()["tables"].values()} == {25}
