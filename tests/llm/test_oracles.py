"""Queries that SQL can express against DuckDB."""

import duckdb
import pytest

from pagewise.llm import queries

SF = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(norm, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
