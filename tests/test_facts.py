from datetime import date

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from liftgauge.operators.facts import daily_facts, enrich, sales_by, transaction_pivot
from liftgauge.params import Metrics

DAY = "2019-03-01"


def pivot(lines, metrics):
    return transaction_pivot(enrich(lines, metrics), metrics)


def test_line_features(sales, metrics):
    rows = as_dicts(enrich(sales([
        (1, "a", DAY, "Apparel", 2.0, 5.0, "Used"),
        (2, "b", DAY, "Drinkware", 1.0, 5.0, "Clicked"),
        (3, "c", DAY, None, 1.0, 5.0, None),
    ]), metrics), "CustomerID")
    assert rows[1]["Sales"] == 10.0 and rows[1]["Coupons"] == 1
    assert (rows[1]["Year"], rows[1]["Month"]) == (2019, 3)
    assert rows[2]["Product_Category_Grouped"] == "Other" and rows[2]["Coupons"] == 0
    assert rows[3]["Product_Category_Grouped"] == "Other" and rows[3]["Coupons"] == 0


def test_pivot_cells_and_totals(sales, metrics):
    row = pivot(sales([
        (1, "a", DAY, "Apparel", 2.0, 5.0, "Used"),
        (1, "a", DAY, "Apparel", 1.0, 8.0, "Used"),
        (1, "a", DAY, "Nest-USA", 3.0, 100.0, "Not Used"),
    ]), metrics).first().asDict()
    assert row["Quantity_Apparel"] == 3.0 and row["Sales_Apparel"] == 18.0 and row["Coupons_Apparel"] == 2.0
    assert row["Avg_Price_Apparel"] == 6.5
    assert row["Sales_Other"] == 0.0 and row["Avg_Price_Other"] == 0.0
    assert row["Sales_All"] == 318.0 and row["Quantity_All"] == 6.0 and row["Price_All"] == 53.0


def test_missing_values(sales, metrics):
    rows = as_dicts(pivot(sales([
        (1, "a", DAY, "Apparel", None, 5.0, "Used"),
        (2, "b", DAY, "Apparel", 0.0, 5.0, "Used"),
        (None, "c", DAY, "Apparel", 1.0, 5.0, "Used"),
        (4, None, DAY, "Apparel", 1.0, 5.0, "Used"),
    ]), metrics), "CustomerID")
    assert set(rows) == {1, 2}
    assert rows[1]["Quantity_All"] == 0.0 and rows[1]["Price_All"] is None
    assert rows[2]["Price_All"] is None


def test_customer_day(sales, metrics):
    rows = as_dicts(daily_facts(sales([
        (1, "a", DAY, "Apparel", 1.0, 10.0, "Used"),
        (1, "a", DAY, "Other thing", 1.0, 30.0, "Used"),
        (1, "b", DAY, "Apparel", 0.0, 10.0, "Used"),
        (1, "c", DAY, "Apparel", 2.0, 10.0, "Used"),
        (1, "d", "2019-03-02", "Apparel", 2.0, 10.0, "Used"),
    ]), metrics), "Transaction_Date")
    first = rows[date(2019, 3, 1)]
    assert first["Transactions"] == 3
    assert first["Price_All"] == pytest.approx((20.0 + 10.0) / 2)  # the transaction without a price is left out
    assert first["Sales_All"] == 60.0 and first["Coupons_All"] == 4.0
    assert rows[date(2019, 3, 2)]["Transactions"] == 1


def test_sums_are_kept(sales, metrics):
    lines = sales([
        (c, f"{c}-{d}", f"2019-0{m}-0{d}", k, float(c + d), 1.5 * m, "Used")
        for c in range(1, 6) for m in range(1, 5) for d in range(1, 4) for k in ("Apparel", "Nest-USA", "Bags")
    ])
    daily = daily_facts(lines, metrics)
    expected = lines.agg(F.sum(F.col("Quantity") * F.col("Avg_Price"))).first()[0]
    assert daily.agg(F.sum("Sales_All")).first()[0] == pytest.approx(expected)
    assert sales_by(daily, "Year").first().Sales_All == pytest.approx(expected)
    assert sales_by(daily, "Month").count() == 4


def test_kept_categories_are_a_parameter(sales):
    chosen = Metrics(("Bags", "Nest-USA", "Office's"))
    row = daily_facts(sales([
        (1, "a", DAY, "Office's", 1.0, 10.0, "Used"),
        (1, "a", DAY, "Apparel", 1.0, 7.0, "Used"),
    ]), chosen).first().asDict()
    assert row["Sales_Office's"] == 10.0 and row["Sales_Other"] == 7.0 and row["Sales_Bags"] == 0.0


def test_a_hot_customer_day_and_transaction(spark, metrics):
    """A third of all lines in one transaction, another third in one customer's day."""
    n = 30_000
    lines = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("CustomerID"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("Transaction_ID"),
        F.lit(date(2019, 3, 1)).alias("Transaction_Date"),
        F.lit("Apparel").alias("Product_Category"),
        F.lit(1.0).alias("Quantity"),
        F.lit(2.0).alias("Avg_Price"),
        F.lit("Used").alias("Coupon_Status"),
    )
    hot = daily_facts(lines, metrics).where("CustomerID = 1").first()
    assert hot.Transactions == n / 3 + 1
    assert hot.Sales_All == 2 * 2.0 * n / 3
