"""Every query of the core that has SQL gives the rows of its SQL; the others run and give rows."""

import pytest
from compare import of_duck, of_spark

from scriptorium import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = of_spark(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.SQL:
        assert got == of_duck(duck, catalog.SQL[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
