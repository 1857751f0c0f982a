"""Every query that has SQL gives the SQL's rows; the others run and give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(data, "sf0.001", f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 3) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def told(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, db, name):
    got = QUERIES[name](spark, f"{data}/sf0.001")
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    assert told(got.select(*names).collect()) == told(rows)
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, data, name):
    got = QUERIES[name](spark, f"{data}/sf0.001")
    rows = got.collect()
    assert rows and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
