"""Every registered query against its SQL, on the smallest tables."""

import pytest

from parley.plans import registry

from .helpers import same, tables

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), tables(sf_dir), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["sample_key", "interaction_id", "file_id", "split", "t_ms", "tau_ms", "label"]
