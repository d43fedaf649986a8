"""Every registered query of the library against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from granary.plans import registry


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, con, name):
    got = registry.queries()[name](spark, data)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert rows or name == "secret_scan"  # the smallest tables may hold no secret
    if name in registry.oracle_sql():
        cursor = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted((plain([r[n] for n in names]) for r in rows), key=str) == sorted((plain(list(r)) for r in cursor.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
