from datetime import date

import pytest
from conftest import as_dicts
from pyspark.errors import PySparkException

from liftgauge.operators.cohorts import assign_all_cohorts, assign_arms, in_cohort
from liftgauge.operators.facts import daily_facts
from liftgauge.operators.labels import label, mark, promo_pivot, with_period
from liftgauge.params import Cohort, Periods

PERIODS = Periods.of("2020-01-01", "2020-01-31", "2020-02-01", "2020-02-29")


def test_overlap_counts_as_pre(purchases, metrics):
    overlapping = Periods.of("2020-01-01", "2020-01-20", "2020-01-10", "2020-01-31")
    rows = as_dicts(with_period(daily_facts(purchases([
        (1, "2020-01-01"), (1, "2020-01-15"), (1, "2020-01-20"), (1, "2020-01-21"), (1, "2020-01-31"), (1, "2020-02-01"),
    ]), metrics), overlapping), "Transaction_Date")
    found = [rows[d]["Period"] for d in sorted(rows)]
    assert found == ["Pre", "Pre", "Pre", "Post", "Post", "Out"]


@pytest.fixture
def labelled(purchases, initiatives, metrics):
    daily = daily_facts(purchases([
        (1, "2020-01-05", 1, "Used"), (1, "2020-02-05", 1, "Used"),
        (2, "2020-01-05", 1, "Used"), (2, "2020-02-05", 1, "Not Used"),
        (3, "2020-01-05", 1, "Not Used"), (3, "2020-02-05", 1, "Used"),
        (4, "2020-01-05", 1, "Not Used"),
        (5, "2020-05-05", 1, "Used"),
        (6, "2020-02-05", 1, "Used"), (6, "2020-05-05", 1, "Used"),
    ]), metrics)
    return label(daily, initiatives(1, 3), PERIODS)


def test_segments(labelled):
    found = {r.CustomerID: r.Promo_Segment for r in labelled.collect()}
    assert found == {1: "Promo", 2: "PromoPre", 3: "PromoPost", 4: "NoPromo", 5: "NoPromo", 6: "PromoPost"}


def test_each_customer_has_one_segment(labelled):
    assert labelled.select("CustomerID", "Promo_Segment").distinct().count() == 6


def test_initiative_is_filled_and_nothing_else(labelled):
    found = {r.CustomerID: r.Initiative for r in labelled.collect()}
    assert found[1] == "BuyOneGetOne" and found[2] == "NoInitiative"


def test_promo_pivot(labelled):
    rows = as_dicts(promo_pivot(labelled), "CustomerID")
    assert rows[6] == {"CustomerID": 6, "Out_Coupons_All": 1.0, "Post_Coupons_All": 1.0, "Pre_Coupons_All": 0.0}


def test_null_prices_stay_null(purchases, initiatives, metrics):
    daily = daily_facts(purchases([(1, "2020-01-05", 0, "Used")]), metrics)
    row = label(daily, initiatives(), PERIODS).first()
    assert row.Price_All is None and row.Initiative == "NoInitiative"


def test_a_customer_listed_twice_fails(purchases, initiatives, metrics):
    daily = daily_facts(purchases([(1, "2020-01-05"), (2, "2020-01-05")]), metrics)
    with pytest.raises(PySparkException, match="listed twice"):
        label(daily, initiatives(1, 1), PERIODS).collect()


def test_wildcards(labelled):
    def customers(promo, initiative):
        return {r.CustomerID for r in in_cohort(labelled, Cohort(promo, initiative)).collect()}

    assert customers("All", "All") == {1, 2, 3, 4, 5, 6}
    assert customers("PromoPost", "All") == {3, 6}
    assert customers("All", "BuyOneGetOne") == {1, 3}
    assert customers("PromoPost", "BuyOneGetOne") == {3}
    assert customers("All", "Nothing") == set()


def test_arms_may_overlap(labelled):
    arms = {"a": Cohort("PromoPost"), "b": Cohort("All", "BuyOneGetOne"), "c": Cohort("All", "Nothing")}
    rows = assign_arms(labelled, arms).select("arm", "CustomerID").distinct().collect()
    assert {tuple(r) for r in rows} == {("a", 3), ("a", 6), ("b", 1), ("b", 3)}


def test_all_cohorts_hold_each_row_four_times(labelled):
    grid = assign_all_cohorts(labelled)
    assert grid.count() == 4 * labelled.count()
    assert grid.where("promo_choice = 'All' AND initiative_choice = 'All'").count() == labelled.count()


def test_an_initiative_called_all_is_not_the_wildcard(spark):
    rows = spark.createDataFrame([(1, "Promo", "All"), (2, "Promo", "NoInitiative")], "CustomerID int, Promo_Segment string, Initiative string")
    grid = assign_all_cohorts(rows)
    wild = grid.where("promo_choice = 'All' AND initiative_choice = 'All' AND any_initiative")
    named = grid.where("promo_choice = 'All' AND initiative_choice = 'All' AND NOT any_initiative")
    assert sorted(r.CustomerID for r in wild.collect()) == [1, 2]
    assert [r.CustomerID for r in named.collect()] == [1]


def test_marks(purchases, initiatives, metrics):
    rows = as_dicts(mark(daily_facts(purchases([
        (1, "2020-01-10"), (1, "2020-01-20"), (1, "2020-02-03"), (1, "2020-06-01"),
    ]), metrics), initiatives(), PERIODS), "Transaction_Date")
    first, second, third, out = [rows[d] for d in sorted(rows)]
    assert [r["recency_period"] for r in (first, second, third, out)] == ["Pre", "Pre", "Post", "Out"]
    assert [r["recency_entry"] for r in (first, second, third, out)] == [1, 0, 1, 0]
    assert second["recency_step"] == 10 and out["recency_step"] == 0
    assert first["last_in_lookback"] == date(2020, 2, 3)
