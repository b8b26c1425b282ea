import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from liftgauge.functions.formatting import currency, fixed2_percent, whole_number
from liftgauge.functions.scalar import round2
from liftgauge.operators.reports import combine_tests, formatted, share_range, shares
from liftgauge.params import Metrics

METRICS = Metrics()
PAIRS = (
    "arm string, position int, Metrics string, Pre double, Post double, _spread double, _n long, _known long, "
    "_total boolean, _signed boolean"
)
RESULT = "metric_order int, Metrics string, Pre double, Post double, Var double, `Var%` string, Sign string"


def table(spark, metrics):
    return spark.createDataFrame([("a", 0, m, 1.0, 2.0, 0.5, 9, 9, False, True) for m in metrics], PAIRS)


def test_combined_result_order(spark):
    day_rows = [m for m in METRICS.report_order if m != "Customers_Period"]
    people = [*METRICS.all, "Frequency%", "Recency", "Customers_Period"]
    result = combine_tests(table(spark, day_rows), table(spark, people), ["arm"], METRICS)
    found = [r.Metrics for r in result.orderBy("metric_order").collect()]
    assert found == [*METRICS.report_order, "Frequency%"]


def test_texts_round_like_the_stored_value(spark):
    values = [1.005, 0.125, 2.5, 3.5, -0.001, 1234567.5, -5.0, 0.285]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    x = F.col("x")
    rows = frame.select("x", fixed2_percent(x).alias("p"), whole_number(x).alias("w"), currency(x).alias("c")).collect()
    for r in rows:
        assert r.p == f"{r.x:.2f}%" or abs(r.x) > 1e6
        assert r.w == f"{r.x:,.0f}" and r.c == f"${r.x:,.0f}"


def test_round2_is_half_even(spark):
    frame = spark.createDataFrame([(0.125,), (0.375,), (2.67499,), (293306.93499999994,), (None,)], "x double")
    # One step: a value below the half goes down, however close it is.
    assert [r[0] for r in frame.select(round2(F.col("x"))).collect()] == [0.12, 0.38, 2.67, 293306.93, None]


def test_metric_classes_and_direction(spark):
    result = spark.createDataFrame([
        (1, "Sales_All", 1234.4, 2234.6, 1000.2, "81.03%", "Yes"),
        (2, "Transactions", 2.6, 1.4, -1.2, "-46.15%", "Yes"),
        (3, "Frequency%", 0.1234, 0.2, 0.0766, "62.07%", "No"),
        (4, "Sales_All_Period", 1e6, None, None, None, "NA"),
        (5, "Price_All", 1.0, 1.0, 0.0, "0.00%", "Yes"),
    ], RESULT)
    rows = as_dicts(formatted(result, METRICS), "Metrics")
    sales = rows["Sales_All"]
    assert (sales["Pre"], sales["Post"], sales["Var"]) == ("$1,234", "$2,235", "$1,000")
    assert sales["Var2"] == 1000.2 and sales["direction"] == "gain"
    assert rows["Transactions"]["Pre"] == "3" and rows["Transactions"]["direction"] == "decline"
    assert rows["Frequency%"]["Pre"] == "12.34%" and rows["Frequency%"]["direction"] is None
    assert rows["Sales_All_Period"]["Pre"] == "$1,000,000" and rows["Sales_All_Period"]["Post"] is None
    assert rows["Price_All"]["direction"] is None


def test_shares(spark):
    result = spark.createDataFrame([
        (1, "DaysCount_Period", 1.0, 1.0, 0.0, "", "NA"),
        (2, "Sales_All", 1.0, 3.0, 2.0, "", "No"),
        (3, "Recency", -60.0, -40.0, 20.0, "", "No"),
        (4, "Coupons_All", 0.0, 0.0, 0.0, "", "No"),
        (5, "Price_All", None, 5.0, None, "", "No"),
        (6, "Quantity_All", -5.0, 5.0, 10.0, "", "No"),
        (7, "Transactions", 1.0, 2.0, 1.0, "", "No"),
    ], RESULT)
    rows = {k: (r["Pre"], r["Post"]) for k, r in as_dicts(shares(result, []), "Metrics").items()}
    assert rows == {
        "Sales_All": (25.0, 75.0), "Recency": (40.0, 60.0), "Coupons_All": (0.0, 0.0), "Price_All": (0.0, 100.0),
        "Quantity_All": (100.0, 100.0), "Transactions": (33.33, 66.67),
    }
    bounds = share_range(shares(result, []).withColumn("arm", F.lit("a")), ["arm"]).first()
    assert (bounds.min_value, bounds.max_value) == (0.0, 100.0)


def test_recency_without_distance(spark):
    result = spark.createDataFrame([(3, "Recency", 0.0, 0.0, 0.0, "", "No")], RESULT)
    row = shares(result, []).first()
    assert (row.Pre, row.Post) == (0.0, 0.0)


@pytest.mark.parametrize("pre,post,expected", [(-10.0, -5.0, "50.00%"), (-10.0, 0.0, "NA"), (4.0, 5.0, "25.00%")])
def test_signed_change(spark, pre, post, expected):
    from liftgauge.functions.formatting import signed_change

    frame = spark.createDataFrame([(pre, post)], "a double, b double")
    assert frame.select(signed_change(F.col("a"), F.col("b"))).first()[0] == expected
