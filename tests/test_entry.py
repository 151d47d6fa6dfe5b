import __spark_entry__ as entry


def test_queries_and_sql_have_the_same_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
