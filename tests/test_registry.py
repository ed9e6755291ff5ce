"""Every registered query against its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from flightloom.plans import oracle, registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(oracle.oracle_sql()[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(names) == sorted(df.columns)
    rows = [[r[n] for n in sorted(names)] for r in df.collect()]
    order = [names.index(n) for n in sorted(names)]
    assert not any(isinstance(x, Decimal) for r in want for x in r), "decimals hash unlike doubles"
    assert sorted(repr(plain(r)) for r in rows) == sorted(repr(plain([r[i] for i in order])) for r in want)


def test_every_oracle_has_a_query():
    assert set(oracle.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) == set(oracle.oracle_sql())


def test_the_flagship_query_has_a_stable_schema(spark):
    assert registry.entry(spark, SF).schema == registry.entry(spark, SF).schema
    assert registry.entry(spark, SF).count() == 1
