"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from liftgauge.catalog.setting import ARMS, METRICS, PERIODS
from liftgauge.plans.campaign import Campaign
from liftgauge.sources.sales import initiatives_from_customers, sales_from_orders

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_automatic_broadcast(spark):
    """As on tables too large to broadcast: whatever is still broadcast is so by our own choice."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def campaign(spark, no_automatic_broadcast):
    def build(keep=False):
        return Campaign(
            sales_from_orders(spark, FOLDER), initiatives_from_customers(spark, FOLDER), PERIODS["main"], ARMS,
            METRICS, keep,
        )

    return build


def plan(df, mode="simple"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def test_days_out_of_span_are_not_read(campaign):
    text = plan(campaign().marked, "formatted")
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01T00:00), LessThan(o_orderdate,1997-01-01T00:00)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in text


def test_labels_and_marks_share_one_shuffle_by_customer(campaign):
    text = plan(campaign().marked)
    by_customer = re.findall(r"Exchange hashpartitioning\(CustomerID#\d+L, \d+\)", text)
    assert len(by_customer) == 2  # the facts and the initiatives
    # two joins of the order tables, the transactions, the customer days, and those two
    assert text.count("Exchange hashpartitioning(") == 8


@pytest.mark.parametrize("name", ["customers", "days", "customer_tests", "day_tests", "result", "real_result", "grid"])
def test_no_pairwise_joins(campaign, name):
    text = plan(getattr(campaign(), name))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["customers", "days", "result", "grid", "customer_delta"])
def test_nothing_that_grows_is_broadcast(campaign, name):
    assert "BroadcastExchange" not in plan(getattr(campaign(), name))


def test_customer_rows_of_the_result_read_no_metric(campaign):
    text = plan(campaign(keep=True).result, "formatted")
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert any("CustomerID" in s and "Sales_All" not in s for s in schemas)


def test_the_customer_tests_read_the_facts_once(campaign):
    text = plan(campaign(keep=True).customer_tests)
    assert text.count("FileScan") == 1 and "Join" not in text


def test_result_with_a_hot_customer_a_hot_day_and_a_hot_transaction(spark, initiatives, no_automatic_broadcast):
    """A third of all lines belong to one customer, a third to one day, a third to one transaction."""
    n = 60_000
    i = F.col("id")
    kind = i % 3
    day = F.when(kind == 1, F.lit(date(2020, 2, 10))).otherwise(
        F.date_add(F.lit(date(2020, 1, 1)), (F.xxhash64(i) % 29).cast("int") + 29)
    )
    lines = spark.range(n).select(
        F.when(kind == 0, 7).when(kind == 2, 8).otherwise(i % 500 + 10).cast("long").alias("CustomerID"),
        F.when(kind == 2, "big").otherwise(i.cast("string")).alias("Transaction_ID"),
        F.when(kind == 2, F.lit(date(2020, 1, 15))).otherwise(day).alias("Transaction_Date"),
        F.when(i % 2 == 0, "Apparel").otherwise("Mugs").alias("Product_Category"),
        (i % 5 + 1).cast("double").alias("Quantity"),
        F.lit(2.0).alias("Avg_Price"),
        F.when(i % 11 == 0, "Used").otherwise("No").alias("Coupon_Status"),
    )
    from liftgauge.params import Cohort, Metrics, Periods

    periods = Periods.of("2020-01-01", "2020-01-31", "2020-02-01", "2020-02-29")
    campaign = Campaign(lines, initiatives(7), periods, {"test": Cohort(), "control": Cohort()}, Metrics())
    rows = {r.Metrics: r for r in campaign.result.where("arm = 'test'").collect()}
    in_periods = lines.where(F.col("Transaction_Date").between(date(2020, 1, 1), date(2020, 2, 29)))
    expected = {
        r.post: r for r in in_periods.groupBy((F.col("Transaction_Date") >= date(2020, 2, 1)).alias("post")).agg(
            F.sum(F.col("Quantity") * 2).alias("sales"), F.countDistinct("CustomerID").alias("people"),
            F.countDistinct("CustomerID", "Transaction_ID", "Transaction_Date").alias("transactions"),
        ).collect()
    }
    assert rows["Sales_All_Period"].Pre == expected[False].sales
    assert rows["Sales_All_Period"].Post == expected[True].sales
    assert rows["Customers_Period"].Post == expected[True].people
    assert rows["Transactions_Period"].Post == expected[True].transactions
