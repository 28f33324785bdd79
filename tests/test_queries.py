"""Every registered query against its SQL, or against a plain reading of the tables, over the small tables."""

from pathlib import Path

import pytest
from brute import BRUTE
from oracle import difference, plain

from tracelake.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        assert difference(df, SF, sql) == ""
        return
    want = BRUTE[name](SF)
    if isinstance(want, int):
        assert df.count() == want > 0
    else:
        order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
        assert order(df.collect()) == order(want) != []


def test_entry_has_all():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in registry.queries()
