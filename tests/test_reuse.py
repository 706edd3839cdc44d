"""Work that is done once: choosing first submissions, and normalising texts."""

import datetime

from pyspark.sql import functions as F

from lanewise.functions import text
from lanewise.operators import metrics, models
from lanewise.operators.scale import keep_first
from lanewise.plans import queries_metrics, queries_models
from lanewise.plans.freight_view import SUBMISSION_ORDER, FreightView


def test_first_submissions_are_chosen_once(spark, monkeypatch):
    from lanewise.operators import scale
    calls, real = [], scale.keep_first
    monkeypatch.setattr(scale, "keep_first", lambda *a: calls.append(1) or real(*a))
    view = FreightView(spark, "/root/testdata/sf0.001")
    first = view.invoices_first
    for df in (first, view.invoices, view.orders_raw):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "min(struct" not in plan       # all read the stored table
    assert view.invoices.count() == first.where("actual_billed_amount > 0").count()
    assert len(calls) == 1


def test_first_submissions_are_chosen_among_narrow_rows(spark, tmp_path):
    ddl = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    day, rows = datetime.date(1995, 1, 2), []
    for flag in ("R", "A", None):                                  # submissions that only the label tells apart, some without a number
        rows += [(1, 1, 500, 7, 3.0, 90.0, 0.1, 0.2, flag, "F", day), (None, 2, 40, 7, 3.0, 90.0, 0.1, 0.2, flag, "F", day), (2, 9, 40, None, None, 90.0, 0.1, 0.2, flag, "F", None)]
    spark.createDataFrame(rows + rows, ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    view = FreightView(spark, str(tmp_path))
    whole = keep_first(view.invoices_raw, ["invoice_id"], SUBMISSION_ORDER)
    assert view.invoices_first.columns == view.invoices_raw.columns
    assert sorted(map(repr, view.invoices_first.collect())) == sorted(map(repr, whole.collect())) and whole.count() == 3


def test_chosen_submissions_are_shuffled_without_names(spark, monkeypatch):
    from lanewise.operators import scale
    seen, real = [], scale.keep_first
    monkeypatch.setattr(scale, "keep_first", lambda df, *a: seen.extend(df.columns) or real(df, *a))
    FreightView(spark, "/root/testdata/sf0.001").invoices_first
    assert seen and not {"invoice_id", "order_id", "vendor_id"} & set(seen)


def kinds_read(df):
    return {f.split("/lanewise-")[-1].rsplit("/", 1)[0][:-33] for f in df.inputFiles()}


def test_variants_and_risk_rows_are_priced_once(spark, monkeypatch):
    view, split = FreightView(spark, "/root/testdata/sf0.001"), []
    results = queries_metrics._variant_results(view)
    assert "variant-cells" in kinds_read(results) and "raw-orders" not in kinds_read(results) and "orders" not in kinds_read(results)
    real = queries_models.splits.stratified_split
    monkeypatch.setattr(queries_models.splits, "stratified_split", lambda df, *a: split.append(kinds_read(df)) or real(df, *a))
    queries_models._risk_frame(view)
    assert split == [{"risk-rows"}]


def test_a_fit_gets_partitions_of_bounded_rows(spark):
    frame = spark.range(1000).coalesce(1)
    many = models.dealt(frame, 100)
    assert many.rdd.getNumPartitions() == 10 and many.count() == 1000 and many.distinct().count() == 1000
    assert max(many.rdd.glom().map(len).collect()) <= 200
    assert models.dealt(frame, 1000) is frame


def test_a_rule_stands_in_the_plan_once_for_each_kind(spark):
    names = {f"f{i}": "amount" for i in range(4)}
    docs = spark.createDataFrame([("d", "l", *["12.5"] * 8)], "doc_id string, layout string, " + ", ".join(f"{s}_{f} string" for f in names for s in ("gt", "pred")))
    plan = metrics.field_statuses(docs, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("inr") <= 4       # two sides, the quick match and the full one; it was one for each text and use


def test_quick_and_full_reading_of_numbers_agree(spark):
    raw = ["12.5", "Rs. 12.50", "rs.5", "rs..5", "INR 7", "₹1,234.5", "1 2", "5 kg", "7days", "3 days ", "1e3", "12\n", "", " ", "-", "abc", "+.5", "1.2.3", None]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    amount = df.select(text.norm_amount(F.col("t"))["value"]).toPandas().iloc[:, 0].tolist()
    number = df.select(text.norm_number(F.col("t"))["value"]).toPandas().iloc[:, 0].tolist()
    simple = df.select(text.parse_number_simple(F.col("t"))).toPandas().iloc[:, 0].tolist()
    clean = lambda xs: [None if x is None or x != x else x for x in xs]
    assert clean(amount) == [12.5, 12.5, 5.0, 0.5, 7.0, 1234.5, 12.0, None, None, None, 1000.0, 12.0, None, None, None, None, 0.5, None, None]
    assert clean(number) == [12.5, None, None, None, None, None, None, 5.0, 7.0, 3.0, 1000.0, 12.0, None, None, None, None, 0.5, None, None]
    assert clean(simple) == [12.5, None, 0.5, None, 7.0, 1234.5, 12.0, 5.0, 7.0, 3.0, 13.0, 12.0, None, None, None, None, 0.5, None, None]
