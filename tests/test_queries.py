"""Every core query with SQL gives the SQL's rows; the entry module holds together."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import SF, database, same  # noqa: E402

from marlspike.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query(spark, db, name):
    same(catalog.queries()[name](spark, SF), db, catalog.oracles()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracles())):
        assert catalog.queries()[name](spark, SF).columns
