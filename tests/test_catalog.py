"""Every registered query of the engine against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from twinlake.plans import registry

DATA = Path("/root/testdata/sf0.001")


def normal(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    cols = sorted(got.columns)
    rows = [normal(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    assert rows
    if name not in registry.oracle_sql():
        return
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    want = [normal(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in (r[i] for i in at))) for r in want.fetchall()]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
