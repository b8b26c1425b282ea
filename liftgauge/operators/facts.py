"""From sales lines to one row per customer and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgauge.functions.exact import exact_avg, exact_sum, parts, whole
from liftgauge.functions.scalar import category_bucket, coupon_used, sales_amount
from liftgauge.params import Metrics, quoted, text_literal


def enrich(sales: DataFrame, metrics: Metrics) -> DataFrame:
    """Sales lines with amount, calendar parts, coupon flag and category bucket."""
    return sales.withColumns({
        "Sales": sales_amount(),
        "Year": F.year("Transaction_Date"),
        "Month": F.month("Transaction_Date"),
        "Coupons": coupon_used(),
        "Product_Category_Grouped": category_bucket(metrics),
    })


def transaction_pivot(enriched: DataFrame, metrics: Metrics, near: tuple[str, ...] = ()) -> DataFrame:
    """One row per transaction with a column per measure and category bucket.

    The buckets are columns of one conditional aggregation: a single shuffle, combined on the map
    side, so that a transaction with very many lines still arrives as one row per map task.
    `near` are columns that customer and day decide; lines already dealt by them are not shuffled again.
    """
    measures = ("Quantity", "Avg_Price", "Sales")
    # Cut once for a line, not for each bucket.
    cut = {f"_{m}{n}": part for m in measures for n, part in enumerate(parts(m))}

    def added(measure: str, here: str) -> str:
        return whole(*(f"sum(_{measure}{n}) {here}" for n in range(3)))

    cells = []
    for name in metrics.buckets:
        here = f"FILTER (WHERE Product_Category_Grouped = {text_literal(name)})"
        cells += [
            F.expr(f"coalesce({added('Quantity', here)}, 0D)").alias(f"Quantity_{name}"),
            F.expr(f"coalesce(try_divide({added('Avg_Price', here)}, count(Avg_Price) {here}), 0D)").alias(f"Avg_Price_{name}"),
            F.expr(f"coalesce({added('Sales', here)}, 0D)").alias(f"Sales_{name}"),
            F.expr(f"double(count_if(Coupons = 1) {here})").alias(f"Coupons_{name}"),
        ]
    keys = ["CustomerID", "Transaction_ID", "Transaction_Date"]
    lines = enriched.dropna(subset=keys).withColumns({name: F.expr(part) for name, part in cut.items()})
    pivot = lines.groupBy(*keys, *near).agg(*cells)
    totals = {
        f"{measure}_All": F.expr(" + ".join(map(quoted, metrics.by_bucket(measure))))
        for measure in ("Quantity", "Sales", "Coupons")
    }
    return (
        pivot.withColumns(totals)
        .withColumn("Price_All", F.try_divide("Sales_All", "Quantity_All"))
        .withColumns({"Month": F.month("Transaction_Date"), "Year": F.year("Transaction_Date")})
    )


def total(metric: str, metrics: Metrics, over: str = "") -> Column:
    """The sum of a metric, the same for any order of its rows."""
    name = quoted(metric)
    return F.expr(f"sum({name}) {over}" if metric in metrics.counts else exact_sum(name, over))


def mean(metric: str, metrics: Metrics, over: str = "") -> Column:
    """The mean of a metric, the same for any order of its rows."""
    name = quoted(metric)
    return F.expr(f"avg({name}) {over}" if metric in metrics.counts else exact_avg(name, over))


def customer_days(pivot: DataFrame, metrics: Metrics, near: tuple[str, ...] = ()) -> DataFrame:
    """The core fact table: one row per customer and day.

    Each pivot row is a different transaction of its customer and day, so a count is the number of
    distinct transactions. The columns `near` are as in `transaction_pivot` and come last.
    """
    sums = [total(m, metrics).alias(m) for m in metrics.additive if m != "Transactions"]
    daily = pivot.groupBy("CustomerID", "Transaction_Date", *near).agg(
        F.count("Transaction_ID").alias("Transactions"),
        F.expr(exact_avg("Price_All")).alias("Price_All"),
        *sums,
    )
    return daily.select(
        "CustomerID",
        "Transaction_Date",
        F.month("Transaction_Date").alias("Month"),
        F.year("Transaction_Date").alias("Year"),
        *map(quoted, metrics.all),
        *near,
    )


def daily_facts(sales: DataFrame, metrics: Metrics, near: tuple[str, ...] = ()) -> DataFrame:
    return customer_days(transaction_pivot(enrich(sales, metrics), metrics, near), metrics, near)


def sales_by(daily: DataFrame, *keys: str) -> DataFrame:
    """Sales by year, by month, or by day."""
    return daily.groupBy(*keys).agg(F.expr(exact_sum("Sales_All")).alias("Sales_All"))
