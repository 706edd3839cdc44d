import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    df = entry.queries()["score_invoices"](spark, "/root/testdata/sf0.001")
    assert {"invoice_id", "gate_passed", "flagged"} <= set(df.columns)
    assert df.count() > 0
