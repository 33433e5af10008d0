import __spark_entry__ as entry
from bandlake.plans import registry


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = registry.flagship(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["path", "content"] and rows.count() > 0
