import __spark_entry__ as entry


def test_names_and_smoke(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(entry.entry(spark).take(1)) == 1
