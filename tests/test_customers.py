import pytest
from conftest import as_dicts

from liftgauge.operators.customers import active_span, customer_delta, customer_features
from liftgauge.operators.facts import daily_facts
from liftgauge.operators.labels import mark
from liftgauge.params import Cohort, Periods

EQUAL = Periods.of("2020-01-01", "2020-01-31", "2020-02-01", "2020-03-02")
POST_LONG = Periods.of("2020-01-01", "2020-01-10", "2020-01-11", "2020-02-29")


@pytest.fixture
def features(purchases, initiatives, metrics):
    def build(items, periods, *members):
        marked = mark(daily_facts(purchases(items), metrics), initiatives(*members), periods)
        return customer_features(marked, metrics, periods)

    return build


def test_frequency_and_recency(features):
    rows = as_dicts(features([
        (1, "2020-01-02", 4, "Used"), (1, "2020-01-21", 2, "Used"), (1, "2020-02-11", 6, "Used"),
        (2, "2020-02-20", 1, "Used"),
    ], EQUAL), "Period", "CustomerID")
    assert set(rows) == {("Pre", 1), ("Post", 1), ("Post", 2)}
    pre = rows["Pre", 1]
    assert pre["Frequency%"] == pytest.approx(2 / 31) and pre["Recency"] == 10
    assert pre["Quantity_All"] == 3.0 and pre["Sales_Apparel"] == 30.0 and pre["Transactions"] == 1.0
    post = rows["Post", 1]
    assert post["Frequency%"] == pytest.approx(1 / 31) and post["Recency"] == 20


def test_post_customers_outside_the_lookback_are_dropped(features):
    # The lookback is the 11 days up to 29 February.
    rows = as_dicts(features([
        (1, "2020-01-20"), (2, "2020-01-20"), (2, "2020-02-19"), (3, "2020-02-18"), (4, "2020-02-29"),
    ], POST_LONG), "Period", "CustomerID")
    assert set(rows) == {("Post", 2), ("Post", 4)}
    assert rows["Post", 2]["Recency"] == 10 and rows["Post", 2]["Frequency%"] == pytest.approx(2 / 50)


def test_lookback_counts_days_of_the_pre_period(features):
    # With overlapping periods a day labelled Pre can be the last one in the lookback.
    periods = Periods.of("2020-01-10", "2020-01-31", "2020-01-01", "2020-01-31")
    rows = as_dicts(features([(1, "2020-01-05"), (1, "2020-01-30")], periods), "Period", "CustomerID")
    assert rows["Post", 1]["Recency"] == 1


def test_segment_and_initiative_come_along(features):
    rows = as_dicts(features([(1, "2020-01-05", 1, "Used"), (1, "2020-02-05", 1, "Used")], EQUAL, 1), "Period")
    assert rows["Pre"]["Promo_Segment"] == "Promo" and rows["Pre"]["Initiative"] == "BuyOneGetOne"


def test_no_rows(features):
    assert features([(1, "2021-01-01")], EQUAL).count() == 0


def test_delta_keeps_customers_of_one_period(features):
    found = features([
        (1, "2020-01-02", 2, "Used"), (1, "2020-02-11", 3, "Used"),
        (2, "2020-01-05", 1, "Used"),
        (3, "2020-02-20", 1, "Not Used"),
    ], EQUAL)
    rows = as_dicts(customer_delta(found, {"everyone": Cohort()}), "CustomerID")
    assert len(rows[1]) == 16  # the 15 columns and the arm
    assert rows[1]["Sales_All_post"] == 30.0 and rows[1]["Sales_All_D"] == 10.0
    assert rows[1]["Frequency%_post"] == 3.23 and rows[1]["Frequency%_D"] == 0.0
    assert rows[2]["Sales_All_post"] is None and rows[2]["Sales_All_D"] is None
    assert rows[3]["Coupons_All_post"] == 0.0 and rows[3]["Coupons_All_D"] is None
    assert rows[1]["Promo_Segment"] == "All" and rows[1]["Initiative"] == "All"


def test_active_span(purchases, metrics):
    daily = daily_facts(purchases([(1, "2020-01-02"), (1, "2020-01-11"), (2, "2020-01-05")]), metrics)
    found = {r.CustomerID: r.span_days for r in active_span(daily, "CustomerID").collect()}
    assert found == {1: 10, 2: 1}
