"""Every query with SQL gives what its SQL gives, on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quarry.plans import batches, graphs, models, problems, reads

_spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parents[1] / "tools" / "compare.py")
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)

CORE = {k: v for m in (problems, graphs, reads, models, batches) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (problems, graphs, reads, models, batches) for k, v in m.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, sf, name):
    assert compare.compare(spark, con, sf, name, CORE[name], SQL[name]).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "vertex", "root_vertex", "depth"]
