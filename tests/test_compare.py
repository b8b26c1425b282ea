from datetime import date

import pytest
from conftest import as_dicts

from liftgauge.operators.compare import real_result, rolling_mean, timeline
from liftgauge.operators.facts import daily_facts
from liftgauge.operators.labels import with_period
from liftgauge.params import Periods

SCHEMA = (
    "arm string, metric_order int, Metrics string, Pre double, Post double, Var double, `Var%` string, Sign string"
)


def result(spark, *rows):
    return spark.createDataFrame(
        [(arm, i, m, pre, post, None if post is None or pre is None else post - pre, "as test", sign)
         for i, (arm, m, pre, post, sign) in enumerate(rows)], SCHEMA)


def test_rolling_mean_counts_active_days(spark):
    days = spark.createDataFrame(
        [("a", p, date(2020, 1, d), v) for p, d, v in [
            ("Pre", 1, 1.0), ("Pre", 3, 2.0), ("Pre", 9, 6.0), ("Pre", 10, None), ("Pre", 11, 1.0),
            ("Pre", 12, 2.0), ("Pre", 13, 3.0), ("Post", 20, 5.0)]],
        "arm string, Period string, Transaction_Date date, Sales_All double",
    )
    rows = rolling_mean(days, ["arm"], "Sales_All", 3).orderBy("Transaction_Date").collect()
    assert [r.moving_average for r in rows] == [None, None, 3.0, None, None, None, 2.0, None]
    assert [r.moving_average for r in rolling_mean(days, ["arm"], "Sales_All", 1).collect()].count(None) == 1


def test_lift_over_the_control(spark):
    row = real_result(result(
        spark, ("test", "Sales_All", 100.0, 150.0, "Yes"), ("control", "Sales_All", 200.0, 220.0, "No"),
    )).first()
    assert row.Pre == 100.0 and row.Var == pytest.approx(40.0) and row.Post == pytest.approx(140.0)
    assert row["Var%"] == "40.00%" and row.Sign == "Yes"


def test_control_zero_leaves_the_test_alone(spark):
    rows = as_dicts(real_result(result(
        spark,
        ("test", "Sales_All", 100.0, 150.0, "Yes"), ("control", "Sales_All", 0.0, 220.0, "No"),
        ("test", "Coupons_All", 1.0, 3.0, "No"), ("control", "Coupons_All", 5.0, 0.0, "No"),
        ("test", "Recency", 0.0, 3.0, "No"), ("control", "Recency", 5.0, 5.0, "No"),
        ("test", "Price_All", 2.0, 3.0, "No"), ("control", "Price_All", None, 5.0, "No"),
        ("test", "Alone", 2.0, 3.0, "No"),
    )), "Metrics")
    assert rows["Sales_All"]["Post"] == 150.0 and rows["Sales_All"]["Var%"] == "as test"
    assert rows["Coupons_All"]["Var"] == 2.0
    assert rows["Recency"]["Post"] is None and rows["Recency"]["Var%"] is None
    assert rows["Price_All"]["Var"] is None
    assert "Alone" not in rows


def test_control_like_test_gives_nothing(spark):
    row = real_result(result(
        spark, ("test", "Sales_All", 100.0, 150.0, "Yes"), ("control", "Sales_All", 100.0, 150.0, "No"),
    )).first()
    assert row.Var == 0.0 and row.Post == 100.0 and row["Var%"] == "0.00%"


def test_timeline(purchases, metrics):
    periods = Periods.of("2020-01-01", "2020-01-31", "2020-02-01", "2020-02-29")
    daily = daily_facts(purchases([(1, "2020-01-05", 2, ""), (2, "2020-01-05", 3, ""), (1, "2020-03-05", 1, "")]), metrics)
    rows = timeline(with_period(daily, periods), "Quantity_All", metrics).collect()
    assert {(r.Period, r.Transaction_Date.isoformat()): r.value for r in rows} == {
        ("Pre", "2020-01-05"): 5.0, ("Out", "2020-03-05"): 1.0,
    }
