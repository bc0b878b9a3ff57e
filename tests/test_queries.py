import pytest

from lumenq.plans import queries as core
from tests.twins import compare


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_twin(spark, data, name):
    compare(spark, data, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, data, name):
    df = core.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if "recall" in df.columns and name not in ("leaf_flat_scan", "leaf_sq_scan"):
        assert sum(r["recall"] for r in rows) / len(rows) >= 0.9, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
