"""Versioned tables: snapshots, conflicts and crashes between any two steps."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.versions import Conflict, Store

ROWS = "k long, v string"


@pytest.fixture()
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.replace({"t": (spark.createDataFrame([(k, "a") for k in range(100)] + [(None, "n")], ROWS), ["k"])}, buckets=8)
    return store


def rows(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=repr)


def test_upsert_keeps_untouched_buckets(spark, store):
    before = store.tables()["tables"]["t"]["files"]
    assert store.upsert("t", spark.createDataFrame([(5, "b"), (1000, "new"), (None, "m")], ROWS)) == 2
    after = store.tables()["tables"]["t"]["files"]
    assert 0 < sum(before[b] != p for b, p in after.items()) <= 3
    assert rows(store.read("t")) == sorted([(k, "b" if k == 5 else "a") for k in range(100)] + [(1000, "new"), (None, "m")], key=repr)
    assert rows(store.read("t", 1)) == sorted([(k, "a") for k in range(100)] + [(None, "n")], key=repr)
    gone = spark.createDataFrame([(k, "", True) for k in range(100)] + [(7, "kept", False)], f"{ROWS}, gone boolean").where("k <> 7 OR NOT gone")
    store.upsert("t", gone, deleted="gone")
    assert rows(store.read("t")) == sorted([(7, "kept"), (1000, "new"), (None, "m")], key=repr)
    assert store.upsert("t", gone.limit(0), deleted="gone") == 4 and store.read("t").count() == 3


def test_of_two_writers_one_starts_again(spark, store):
    other, tables = Store(spark, store.folder), store.tables()["tables"]
    other.upsert("t", spark.createDataFrame([(1, "other")], ROWS))
    with pytest.raises(Conflict):
        store._commit(1, tables)
    commit, first = store._commit, []

    def late(base, new):
        if not first:
            first.append(other.upsert("t", spark.createDataFrame([(2, "other")], ROWS)))
        return commit(base, new)

    store._commit = late
    assert store.upsert("t", spark.createDataFrame([(3, "mine")], ROWS)) == 4
    assert {k: v for k, v in rows(store.read("t")) if v != "a"} == {1: "other", 2: "other", 3: "mine", None: "n"}


@pytest.mark.parametrize("step", ["_written", "_commit"])
def test_a_crash_leaves_the_last_version(spark, store, step):
    real = getattr(store, step)

    def dies(*given):
        if step == "_written":
            real(*given)
        raise KeyboardInterrupt

    setattr(store, step, dies)
    with pytest.raises(KeyboardInterrupt):
        store.upsert("t", spark.createDataFrame([(5, "b")], ROWS))
    again = Store(spark, store.folder)
    assert again.versions() == [1] and ("5", "b") not in rows(again.read("t"))
    again.upsert("t", spark.createDataFrame([(5, "c")], ROWS))
    assert dict(rows(again.read("t")))[5] == "c"
    assert again.vacuum() >= 1 and dict(rows(again.read("t")))[5] == "c"


def test_a_draft_is_no_version(spark, store):
    with open(os.path.join(store.folder, "commits", "_draft-x"), "w") as f:
        f.write('{"version": 2, "tab')
    assert store.versions() == [1] and store.read("t").count() == 101


def test_tables_change_together_and_stay_readable(spark, store):
    before = store.read("t")
    df = spark.range(3).select(F.col("id").alias("k"), F.lit("z").alias("v"))
    assert store.replace({"t": (df, ["k"]), "u": (df.limit(0), ["k"])}, buckets=4) == 2
    assert before.count() == 101 and store.read("t").count() == 3 and store.read("u").count() == 0
    with pytest.raises(ValueError):
        store.read("t", 9)


def test_arrivals_of_any_order_come_once(spark, tmp_path):
    import random

    from sparkloom.sources import arrivals

    draw, schema = random.Random(3), "id string, arrived long, v long"
    rows = [(f"r{k:03}", 1000 + 10 * k + draw.randrange(5), k) for k in range(300)]
    visible = {r[0]: r[1] + (90 if draw.random() < 0.2 else 0) for r in rows}  # some are committed late
    rows += [(i, a + 200, v) for i, a, v in rows[::17]] + [(i, a + 30, v) for i, a, v in rows[5:300:23]] + [(None, 5, 5), ("x", None, 6), ("ahead", 10**9, 7)]
    store = Store(spark, str(tmp_path / "arrivals"))
    everything = spark.createDataFrame(rows, schema)
    arrivals.begin(store, everything)
    for now in (1500, 1501, 2600, 5000):
        seen = spark.createDataFrame([r for r in rows if r[1] is None or r[1] + (visible.get(r[0], 0) - r[1] if r[0] in visible and r[1] <= visible[r[0]] else 0) <= now or r[0] == "ahead"], schema)
        arrivals.follow(Store(spark, store.folder), seen, now, margin_ms=100, rows=40)  # a new reader each time
        assert store.note(arrivals.NAME)["cursor"] <= now
    got = {r.id: (r.arrived, r.v) for r in store.read(arrivals.NAME).collect()}
    want = {}
    for i, a, v in rows:
        if i is not None and a is not None and a >= want.get(i, (0,))[0]:
            want[i] = (a, v)
    assert got == want


def test_a_reader_that_dies_reads_its_page_again(spark, tmp_path):
    from sparkloom.sources import arrivals

    store = Store(spark, str(tmp_path / "arrivals"))
    log = spark.createDataFrame([(k, 10 * k) for k in range(20)], "id long, arrived long")
    arrivals.begin(store, log)
    arrivals.pull(store, log, 10**6, rows=5)
    real = store._commit
    store._commit = lambda *given: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        arrivals.pull(store, log, 10**6, rows=5)
    store._commit = real
    assert store.note(arrivals.NAME)["cursor"] == 40 and store.read(arrivals.NAME).count() == 5
    assert arrivals.follow(store, log, 10**6, rows=5) == 15 and store.read(arrivals.NAME).count() == 20


def test_sessions_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    import random

    from sparkloom.streaming import sessions

    draw = random.Random(12)
    events = [(draw.choice([1, 2, None]), draw.randrange(-400, 3000)) for _ in range(400)] + [(9, 0), (9, 10), (9, 21), (8, None)]
    want = set()
    for key in {k for k, at in events if at is not None}:
        times = sorted(at for k, at in events if k == key and at is not None)
        start = times[0]
        for a, b in zip(times, [*times[1:], None]):
            if b is None or b - a > 10:
                want.add((key, start, a))
                start = b
    for n, order in enumerate((sorted(events, key=repr), draw.sample(events, len(events)))):
        store = Store(spark, str(tmp_path / f"s{n}"))
        sessions.begin(store)
        for a in range(0, len(order), 110):
            sessions.absorb(store, spark.createDataFrame(order[max(0, a - 30) : a + 110], "key long, at long"), 10)
        sessions.absorb(store, spark.createDataFrame([], "key long, at long"), 10)
        assert {(r.key, r.start, r.end) for r in store.read(sessions.NAME).collect()} == want and store.read(sessions.NAME).count() == len(want)
