"""State of sources across runs: batches, restarts, repeated and late rows."""

import random

import pandas as pd

from sparkloom.streaming import health


def test_states_do_not_depend_on_batches(spark, tmp_path):
    draw = random.Random(1)
    rows = [(s, r, draw.random() < 0.5, None if draw.random() < 0.1 else [draw.choice("abcdefg") for _ in range(3)] + [None]) for s in range(6) for r in range(12)]
    want = []
    for s in range(6):
        failures, seen = 0, set()
        for _, r, transient, items in (x for x in rows if x[0] == s):
            failures = failures + 1 if transient else 0
            found = set() if transient else {i for i in items or [] if i}
            want.append((s, r, failures, failures >= 3, len(found), len(found - seen)))
            seen |= found
    for k, cuts in enumerate(([12], [3, 4, 12])):
        place = str(tmp_path / str(k))
        for cut in cuts:  # each start reads a file more, with all runs up to its own
            part = [x for x in rows if x[1] < cut] + [(None, 1, True, []), (1, None, False, ["z"])]
            draw.shuffle(part)
            spark.createDataFrame(part + part[:5], health.RUNS).coalesce(1).write.parquet(f"{place}/in/{cut}")
            stream = spark.readStream.schema(health.RUNS).option("recursiveFileLookup", True).parquet(f"{place}/in")
            health.follow(stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
        assert sorted(tuple(r) for r in spark.read.schema(health.STATES).parquet(f"{place}/out").collect()) == want


class Kept:
    """A value and a map state, with the items that were asked for."""

    def __init__(self):
        self.value, self.items, self.asked = None, {}, []

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        self.asked.append(key[0])
        return key in self.items

    def updateValue(self, key, value):
        self.items[key] = value


def test_each_item_is_asked_for_once_a_batch():
    kept, work = Kept(), health.Health()
    work.init(kept)

    def batch(*runs):
        frame = pd.DataFrame([(1, r, False, list(items)) for r, items in runs], columns=["source", "run", "transient", "items"])
        return [r.n_new for out in work.handleInputRows((1,), iter([frame]), None) for r in out.itertuples()]

    assert batch((1, "ab"), (2, "abc"), (3, "bc")) == [2, 1, 0] and kept.asked == []
    assert batch((4, "ad"), (5, "ade"), (6, "de")) == [1, 1, 0] and sorted(kept.asked) == ["a", "d", "e"]
