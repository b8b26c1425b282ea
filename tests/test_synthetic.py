from datetime import date, timedelta

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from liftgauge.operators.synthetic import bootstrap, cohort_sizes, draw_plan, proportions, synthetic_days
from liftgauge.params import Cohort, Metrics
from liftgauge.plans.campaign import Campaign
from liftgauge.params import Periods

METRICS = Metrics()


@pytest.fixture
def days(spark):
    names = METRICS.all
    totals = [f"{m}_day" for m in METRICS.day_totals]
    schema = "arm string, Period string, Transaction_Date date, " + ", ".join(f"`{m}` double" for m in names)
    schema += ", ActiveCustomer long, `ActiveCustomer%` double, " + ", ".join(f"{m} double" for m in totals)
    schema += ", Recency double"

    def row(arm, period, d, value, active):
        values = {m: value for m in names} | {"Coupons_All": 0.0 if arm == "control" else value}
        day = date(2020, 1, 1) + timedelta(days=d)
        return (arm, period, day, *values.values(), active, 0.5, *[value * active] * 4, -1.0)

    rows = [row(arm, "Pre", d, v if d >= 5 else 1000.0, n)
            for arm, v, n in (("test", 6.0, 9), ("control", 2.0, 3)) for d in range(40)]
    rows += [row("test", "Post", 50, 7.0, 4), row("control", "Post", 50, 3.0, 2), row("control", "Post", 51, 4.0, 5)]
    return spark.createDataFrame(rows, schema)


def test_proportions_come_from_the_last_35_days(days):
    row = proportions(days, METRICS).first().asDict()
    assert row["Sales_All"] == pytest.approx(3.0) and row["ActiveCustomer"] == pytest.approx(3.0)
    assert row["Coupons_All"] == 0.0  # nothing to scale in the control


def test_synthetic_days(days):
    found = synthetic_days(days, METRICS)
    assert found.where("arm = 'test'").count() == 41
    rows = as_dicts(found.where("arm = 'control'"), "Period", "Transaction_Date")
    assert len(rows) == 42
    assert rows["Pre", date(2020, 2, 1)]["Sales_All"] == 6.0
    post = rows["Post", date(2020, 1, 1) + timedelta(days=50)]
    assert post["Sales_All"] == pytest.approx(9.0) and post["ActiveCustomer"] == pytest.approx(6.0)
    assert post["Sales_All_day"] == pytest.approx(54.0) and post["Coupons_All_day"] == 0.0
    assert post["Price_All"] == 3.0 and post["ActiveCustomer%"] == 0.5 and post["Recency"] == -1.0


def test_every_draw_takes_one_row_of_one_group(spark):
    rows = spark.range(5000).select((F.col("id") * 7 + 3).alias("CustomerID"))
    first = sorted(draw_plan(rows, "CustomerID", 2.0, digits=1).collect())
    assert [d.draw for d in first] == list(range(10_000))
    sizes = {g: n for g, n in rows.groupBy(F.substring(F.md5(F.col("CustomerID").cast("string")), 1, 1)).count().collect()}
    assert all(0 <= d._place < sizes[d._group] for d in first)
    # What a group gets is spread as the draws of a fair choice would be.
    for group, n in sizes.items():
        expected, got = 2.0 * n, sum(d._group == group for d in first)
        assert abs(got - expected) < 5 * (expected * (1 - n / 5000)) ** 0.5
    assert sorted(draw_plan(rows.repartition(13), "CustomerID", 2.0, digits=1).collect()) == first


def test_nothing_runs_before_the_draw_is_asked_for(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bootstrap", "none")
    bootstrap(spark.range(100).withColumnRenamed("id", "CustomerID"), "CustomerID", spark.range(1).select(F.lit(1.5).alias("fraction")))
    assert tracker.getJobIdsForGroup("bootstrap") in ([], ())
    spark.sparkContext.setJobGroup("", "")


def test_an_empty_pool_gives_nothing(spark):
    assert bootstrap(spark.range(0).withColumnRenamed("id", "CustomerID"), "CustomerID", 2.0).count() == 0


@pytest.mark.parametrize("fraction", [0.0, 0.5, 1.25, 3.0])
def test_bootstrap_has_the_exact_size(spark, fraction):
    pool = spark.range(501).withColumnRenamed("id", "CustomerID").withColumn("x", F.col("CustomerID") * 2)
    drawn = sorted(tuple(r) for r in bootstrap(pool, "CustomerID", fraction).collect())
    assert len(drawn) == round(501 * fraction)
    assert [d[0] for d in drawn] == list(range(len(drawn))) and all(d[2] == 2 * d[1] for d in drawn)
    assert drawn == sorted(tuple(r) for r in bootstrap(pool.repartition(7), "CustomerID", fraction).collect())
    if fraction >= 1:
        assert len({d[1] for d in drawn}) < len(drawn)  # with replacement
        other = sorted(tuple(r) for r in bootstrap(pool, "CustomerID", fraction, seed=1).collect())
        assert other != drawn


def test_draws_are_even(spark):
    pool = spark.range(100).withColumnRenamed("id", "CustomerID")
    counts = [r["count"] for r in bootstrap(pool, "CustomerID", 1000.0).groupBy("CustomerID").count().collect()]
    assert len(counts) == 100 and 850 < min(counts) and max(counts) < 1150


def test_synthetic_customers(purchases, initiatives):
    periods = Periods.of("2020-01-01", "2020-03-31", "2020-04-01", "2020-06-30")
    items = [(c, day) for c in range(1, 7) for day in ("2020-03-20", "2020-04-10")]
    items += [(9, "2020-01-02"), (9, "2020-04-10")]  # test customer, too early for the 35 days
    campaign = Campaign(
        purchases(items), initiatives(1, 2, 9), periods,
        {"test": Cohort("All", "BuyOneGetOne"), "control": Cohort("NoPromo", "NoInitiative")},
    )
    # Customer 9 bought before the switch, but not close to it.
    sizes = cohort_sizes(campaign.marked, *campaign.arms.values()).first()
    assert tuple(sizes) == (2, 4)
    rows = campaign.synthetic_customers.collect()
    count = {}
    for r in rows:
        count[r.arm, r.Period] = count.get((r.arm, r.Period), 0) + 1
    # two test against four control customers in the 35 days: half of the four control customers
    assert count == {("test", "Pre"): 3, ("test", "Post"): 3, ("control", "Pre"): 3, ("control", "Post"): 2}
    assert {r.CustomerID for r in rows if (r.arm, r.Period) == ("control", "Pre")} == {1, 2, 9}
    assert {r.CustomerID for r in rows if (r.arm, r.Period) == ("control", "Post")} <= {3, 4, 5, 6}
    assert campaign.synthetic_real_result.count() == 23


def test_one_scan_serves_the_synthetic_control(spark, purchases, initiatives):
    """Also where the periods are shorter than the days around the switch, whose labels then need more days than the analysis."""
    for periods in (Periods.of("2020-01-01", "2020-03-31", "2020-04-01", "2020-06-30"),
                    Periods.of("2020-03-25", "2020-03-31", "2020-04-01", "2020-04-07")):
        # Customer 3 used a coupon in the days around the switch, outside of the short periods.
        items = [(c, day, 1.0, "Used" if c == 3 and day < "2020-03-20" else "No")
                 for c in range(1, 8) for day in ("2020-03-10", "2020-03-28", "2020-04-02")]
        campaign = Campaign(purchases(items), initiatives(1, 2), periods, keep=False)
        scans = []
        inner = campaign._facts_within
        campaign._facts_within = lambda days: scans.append(days) or inner(days)
        assert campaign.synthetic_real_result.count() == 23 and len(scans) == 1
        assert tuple(cohort_sizes(campaign.marked, *campaign.arms.values()).first()) == (2, 4)
        kept = Campaign(purchases(items), initiatives(1, 2), periods)
        kept.marked  # noqa: B018  written once
        text = kept.synthetic_result._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "Scan ExistingRDD" not in text and "LocalTableScan" not in text
        assert sorted(kept.synthetic_result.collect(), key=str) == sorted(campaign.synthetic_result.collect(), key=str)


def test_a_control_without_customers_fails(purchases, initiatives):
    periods = Periods.of("2020-01-01", "2020-03-31", "2020-04-01", "2020-06-30")
    campaign = Campaign(purchases([(1, "2020-03-20"), (1, "2020-04-10"), (2, "2020-04-10")]), initiatives(1), periods)
    with pytest.raises(Exception, match="no customers before the switch"):
        campaign.synthetic_customers.collect()
