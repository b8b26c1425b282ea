import math
import random

import numpy as np
import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from liftgauge.operators.cohorts import GRID_KEYS, assign_all_cohorts, assign_arms
from liftgauge.operators.significance import customer_cells, customer_pairs
from liftgauge.operators.significance import customer_tests as table_of_cells
from liftgauge.operators.significance import day_tests
from liftgauge.params import Cohort, Metrics

METRICS = Metrics()


def features(spark, rows, keys=("arm",)):
    """Customer features from (arm, period, customer, value, frequency, recency)."""
    names = METRICS.all
    schema = "arm string, Period string, CustomerID long, " + ", ".join(f"`{m}` double" for m in names)
    schema += ", `Frequency%` double, Recency int"
    return spark.createDataFrame([(a, p, c, *([v] * len(names)), f, r) for a, p, c, v, f, r in rows], schema)


def customer_tests(rows, keys, metrics):
    return table_of_cells(customer_cells(rows, keys, metrics), keys, metrics)


def by_numpy(x, mu0, w):
    x, w = np.asarray(x, float), np.asarray(w, float)
    mean = (x * w).sum() / w.sum()
    spread = math.sqrt((w * (x - mean) ** 2).sum() / w.sum())
    return mean, (mean - mu0) / (spread / math.sqrt(len(x)))


def test_weighted_t(spark):
    values, weights, recency = [4.0, 5.0, 7.0, 9.0, 12.0], [0.1, 0.2, 0.3, 0.2, 0.4], [3, 5, 8, 1, 2]
    rows = [("a", "Pre", i, v, w, 4) for i, (v, w) in enumerate([(3.0, 0.5), (6.0, 0.25)])]
    rows += [("a", "Post", i, v, w, r) for i, (v, w, r) in enumerate(zip(values, weights, recency))]
    found = as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "Metrics")
    assert len(found) == 17
    sales = found["Sales_All"]
    assert sales["Pre"] == pytest.approx(4.0)
    mean, t = by_numpy(values, 4.0, weights)
    assert sales["Post"] == pytest.approx(mean) and sales["t_stat"] == pytest.approx(t) and sales["df"] == 4
    assert sales["Var%"] == f"{(mean / 4.0 - 1) * 100:.2f}%"
    frequency = found["Frequency%"]
    plain = (np.mean(weights) - 0.375) / (np.std(weights, ddof=1) / math.sqrt(5))
    assert frequency["Post"] == pytest.approx(np.mean(weights)) and frequency["t_stat"] == pytest.approx(plain)
    people = found["Customers_Period"]
    assert (people["Pre"], people["Post"], people["Var"], people["Sign"]) == (2.0, 5.0, 3.0, "NA")
    assert people["t_stat"] is None and people["p_value"] is None


def test_small_spread_on_a_large_mean(spark):
    values = [1e9 + d for d in (0.01, 0.02, 0.03, 0.05)]
    rows = [("a", "Pre", 1, 1e9, 1.0, 1)] + [("a", "Post", i, v, 0.5, 1) for i, v in enumerate(values)]
    found = as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "Metrics")
    _, t = by_numpy([v - 1e9 for v in values], 0.0, [0.5] * 4)
    assert found["Sales_All"]["t_stat"] == pytest.approx(t, rel=1e-3)


def test_all_rows_alike(spark):
    rows = [("a", "Pre", 1, 2.0, 0.5, 1), ("a", "Post", 1, 3.0, 0.5, 1), ("a", "Post", 2, 3.0, 0.5, 1)]
    rows += [("b", "Pre", 1, 3.0, 0.5, 1), ("b", "Post", 1, 3.0, 0.5, 1), ("b", "Post", 2, 3.0, 0.5, 1)]
    found = as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "arm", "Metrics")
    certain, same = found["a", "Sales_All"], found["b", "Sales_All"]
    assert certain["t_stat"] == math.inf and certain["p_value"] == 0.0 and certain["Sign"] == "Yes"
    assert same["t_stat"] is None and same["p_value"] is None and same["Sign"] == "No"


def test_the_order_of_summing_is_no_difference(spark):
    rows = [("a", "Pre", i, 0.1, w, 1) for i, w in enumerate([0.3, 0.7, 0.11])]
    rows += [("a", "Post", i, 0.1, w, 1) for i, w in enumerate([0.1, 0.2, 0.37, 0.9])]
    sales = as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "Metrics")["Sales_All"]
    assert sales["t_stat"] is None and sales["Sign"] == "No"


def test_one_post_row(spark):
    rows = [("a", "Pre", 1, 2.0, 0.5, 1), ("a", "Post", 1, 3.0, 0.5, 1)]
    found = as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "Metrics")
    assert found["Sales_All"]["df"] == 0 and found["Sales_All"]["Sign"] == "No"


def test_a_missing_value_undoes_the_test_but_not_the_mean(spark):
    rows = [("a", "Pre", 1, 2.0, 0.5, 1), ("a", "Pre", 2, None, 0.5, 1)]
    rows += [("a", "Post", i, v, 0.5, 1) for i, v in enumerate([8.0, 9.0, None])]
    sales = as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "Metrics")["Sales_All"]
    # The missing value's weight stays in the divisor.
    assert sales["Pre"] == pytest.approx(1.0) and sales["Post"] == pytest.approx(17 / 3)
    assert sales["t_stat"] is None and sales["Sign"] == "No"


def test_zero_gives_no_percentage(spark):
    rows = [("a", "Pre", 1, 0.0, 0.5, 1)] + [("a", "Post", i, float(i), 0.5, 1) for i in range(3)]
    assert as_dicts(customer_tests(features(spark, rows), ["arm"], METRICS), "Metrics")["Sales_All"]["Var%"] == "NA"


def test_a_period_without_rows(spark):
    found = as_dicts(customer_tests(features(spark, [("a", "Pre", 1, 1.0, 0.5, 1)]), ["arm"], METRICS), "Metrics")
    assert found["Customers_Period"]["Post"] == 0.0 and found["Sales_All"]["Post"] is None
    assert found["Sales_All"]["Sign"] == "No"
    assert customer_tests(features(spark, [("a", "Pre", 1, 1.0, 0.5, 1)]).limit(0), ["arm"], METRICS).count() == 0


def by_hand(rows, arm, period, pre_mean):
    chosen = [(v, f) for a, p, _, v, f, _ in rows if a in arm and p == period]
    known = [(v, f) for v, f in chosen if v is not None]
    return by_numpy([v for v, _ in known], pre_mean, [f for _, f in known])


def test_cohorts_merged_from_parts_are_those_of_all_their_rows(spark):
    """Groups of different sizes, weights and means, in many partitions, merged in two steps."""
    rng = random.Random(5)
    rows = [(seg, p, i, 1e6 * (seg == "big") + rng.random(), rng.choice([0.01, 0.02, 0.25]), rng.randint(0, 9))
            for seg in ("a", "b", "big") for p in ("Pre", "Post") for i in range(rng.randint(5, 60))]
    frame = features(spark, rows).withColumnRenamed("arm", "Promo_Segment").withColumn(
        "Initiative", F.when(F.col("CustomerID") % 3 == 0, "x").otherwise("y")).repartition(7)
    parted = customer_cells(frame, ["Promo_Segment", "Initiative"], METRICS)
    arms = {"all": Cohort(), "x": Cohort("All", "x")}
    found = as_dicts(table_of_cells(assign_arms(parted, arms), ["arm"], METRICS), "arm", "Metrics")
    for arm, member in (("all", lambda r: True), ("x", lambda r: r[2] % 3 == 0)):
        own = [r for r in rows if member(r)]
        pre = np.average([r[3] for r in own if r[1] == "Pre"], weights=[r[4] for r in own if r[1] == "Pre"])
        mean, t = by_hand(own, ("a", "b", "big"), "Post", pre)
        sales = found[arm, "Sales_All"]
        assert (sales["Pre"], sales["Post"], sales["t_stat"]) == (
            pytest.approx(pre, rel=1e-14), pytest.approx(mean, rel=1e-14), pytest.approx(t, rel=1e-9))
        recency = [float(r[5]) for r in own if r[1] == "Post"]
        before = np.mean([r[5] for r in own if r[1] == "Pre"])
        plain = (np.mean(recency) - before) / (np.std(recency, ddof=1) / math.sqrt(len(recency)))
        assert found[arm, "Recency"]["t_stat"] == pytest.approx(plain)
        assert found[arm, "Customers_Period"]["Post"] == len(recency)


def test_one_pass_over_the_customers_and_no_customer_is_copied(spark):
    frame = features(spark, [("a", "Pre", 1, 1.0, 0.5, 1)]).withColumns({"Promo_Segment": F.lit("s"), "Initiative": F.lit("i")})
    parted = customer_cells(frame, ["Promo_Segment", "Initiative"], METRICS)
    plan = table_of_cells(assign_all_cohorts(parted), GRID_KEYS, METRICS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    # Cohorts are made of the groups' moments, not of customers.
    assert 0 < plan.index("Generate explode") < plan.index("var_pop")


def test_bits_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(6)
    rows = [(a, p, i, rng.random() * 10 ** rng.randint(-3, 7), rng.choice([0.1, 0.3, 1 / 7]), 1)
            for a in "ab" for p in ("Pre", "Post") for i in range(400)]
    frame = features(spark, rows)
    one, other = (as_dicts(customer_pairs(customer_cells(frame.repartition(n, "CustomerID"), ["arm"], METRICS), ["arm"], METRICS), "arm", "Metrics")
                  for n in (1, 9))
    assert {k: (r["Pre"], r["Post"]) for k, r in one.items()} == {k: (r["Pre"], r["Post"]) for k, r in other.items()}


def test_only_some_metrics(spark):
    rows = [("a", "Pre", 1, 1.0, 0.5, 1), ("a", "Post", 1, 2.0, 0.25, 1), ("a", "Post", 2, 2.0, 0.75, 1)]
    only = ["Frequency%", "Customers_Period"]
    found = as_dicts(customer_pairs(customer_cells(features(spark, rows), ["arm"], METRICS, only), ["arm"], METRICS), "Metrics")
    assert set(found) == {"Frequency%", "Customers_Period"} and found["Customers_Period"]["Post"] == 2.0


def test_day_table(spark):
    names = METRICS.all
    totals = [f"{m}_day" for m in METRICS.day_totals]
    schema = "arm string, Period string, Transaction_Date date, " + ", ".join(f"`{m}` double" for m in names)
    schema += ", ActiveCustomer long, `ActiveCustomer%` double, " + ", ".join(f"{m} double" for m in totals)
    schema += ", Recency double"
    from datetime import date

    def day(period, d, value, active, share, recency):
        return ("a", period, date(2020, 1, d), *[value] * len(names), active, share, *[value * active] * 4, recency)

    days = spark.createDataFrame([
        day("Pre", 1, 2.0, 1, 0.25, -1.0), day("Pre", 2, 6.0, 3, 0.75, -3.0),
        day("Post", 3, 4.0, 2, 0.5, -1.0), day("Post", 4, 8.0, 1, 0.25, -2.0), day("Post", 5, 7.0, 1, 0.25, None),
    ], schema)
    found = as_dicts(day_tests(days, ["arm"], METRICS), "Metrics")
    assert len(found) == 21
    mean, t = by_numpy([4.0, 8.0, 7.0], 5.0, [0.5, 0.25, 0.25])
    assert found["Sales_All"]["Pre"] == pytest.approx(5.0) and found["Sales_All"]["t_stat"] == pytest.approx(t)
    assert found["DaysCount_Period"]["Post"] == 3.0 and found["Sales_All_Period"]["Post"] == 23.0
    recency = found["Recency"]
    # A day without recency leaves the mean alone but undoes the test.
    assert recency["Post"] == -1.5 and recency["Sign"] == "No" and recency["t_stat"] is None
    assert recency["Var%"] == "25.00%"
