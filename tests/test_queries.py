"""Every query of the library's own against its SQL oracle on the smallest tables."""

import pytest
from conftest import SF, rows

from helixspark import queries_dna, queries_misc, queries_plans

QUERIES = {**queries_dna.QUERIES, **queries_plans.QUERIES, **queries_misc.QUERIES}
ORACLES = {**queries_dna.ORACLES, **queries_plans.ORACLES, **queries_misc.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
