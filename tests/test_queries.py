"""Every registered query of the engine runs, and equals its SQL where it has some."""

import math

import duckdb
import pytest

from tidekeep.plans.oracle import ORACLE_SQL
from tidekeep.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(table):
    """Rows with columns by name, sorted."""
    names, values = table
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return [names[k] for k in order], sorted(tuple(str(plain(r[k])) for k in order) for r in values)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("nation", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, SF)
    got = rows((found.columns, found.collect()))
    if name in ORACLE_SQL:
        asked = tables.execute(ORACLE_SQL[name])
        want = rows(([d[0] for d in asked.description], asked.fetchall()))
        assert got == want
        assert not any(isinstance(v, float) and math.isnan(v) for r in got[1] for v in r)
