"""Every registered query against its SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from sparkloom import plans
from sparkloom.tables import NAMES

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int, float, Decimal)):
        return ("number", "nan" if math.isnan(v) else round(float(v), 6) + 0.0)
    return ("null",) if v is None else ("text", str(v))


def rows(names, values):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(cell(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", ["row_number_topn", "dedup_best_copy", "merge_conflicts", "log_projection", "gaps_islands"])
def test_repeatable(spark, data, name):
    first, second = (rows(df.columns, df.collect()) for df in (QUERIES[name](spark, data) for _ in range(2)))
    assert first == second
