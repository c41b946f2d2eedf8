"""Every query of the package against its SQL on the same tables."""

import pytest
from compare import rows

from lodeweave.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck):
    found, wanted = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    QUERIES[name](spark, sf).toPandas()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f.name for f in entry.entry(spark).schema} == {"facet", "value", "count"}
