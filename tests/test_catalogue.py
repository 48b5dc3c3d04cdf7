"""Every registered query with SQL against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from rolesift.plans import history, portals, records, reporting, screening  # noqa: F401 - they register their queries
from rolesift.plans.catalogue import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.01")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(x) else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, str(SF)).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    a, b = rows(want), rows(got)
    assert len(a) == len(b)
    assert [x for x in zip(a, b) if x[0] != x[1]][:2] == []
