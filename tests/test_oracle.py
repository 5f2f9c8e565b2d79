"""Every registered query against its DuckDB statement on the smallest data."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ["events"]
_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


OWN = sorted(set(E.queries()) - set(E.CORPUS_QUERIES))


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(ocols)
    otypes = {c[0]: str(c[1]) for c in res.description}
    for f in df.schema.fields:
        assert _TYPES.get(f.dataType.simpleString()) == otypes[f.name], (f.name, f.dataType, otypes[f.name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["machine_id", "availability", "performance", "quality", "oee", "n_readings"]
    assert df.count() == 15
