"""The text operators that have SQL give the SQL's rows."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        path = Path(data, "sf0.001", f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = con.execute(entries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = entries.QUERIES[name](spark, f"{data}/sf0.001")
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    assert rows and sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, rows))
