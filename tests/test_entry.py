import __spark_entry__ as entry


def test_names_and_sql_go_together():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 50


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_suppkey", "f1_macro"] and df.count() > 0
