"""Row-level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftgauge.params import OTHER, OUT, POST, PRE, Metrics, Periods, Window


def sales_amount() -> Column:
    return F.col("Quantity") * F.col("Avg_Price")


def coupon_used() -> Column:
    return F.when(F.col("Coupon_Status") == "Used", 1).otherwise(0)


def category_bucket(metrics: Metrics) -> Column:
    category = F.col("Product_Category")
    return F.when(category.isin(*metrics.kept), category).otherwise(OTHER)


def period_of(day: Column, pre: Window, post: Window) -> Column:
    """Pre, Post or Out; a day in both ranges counts as Pre."""
    return F.when(pre.contains(day), PRE).when(post.contains(day), POST).otherwise(OUT)


def period_days(periods: Periods) -> Column:
    """Length of the row's own period."""
    return F.when(F.col("Period") == PRE, periods.pre.days).when(F.col("Period") == POST, periods.post.days)


def promo_segment(pre_coupons: Column, post_coupons: Column) -> Column:
    return (
        F.when((pre_coupons != 0) & (post_coupons != 0), "Promo")
        .when(pre_coupons != 0, "PromoPre")
        .when(post_coupons != 0, "PromoPost")
        .otherwise("NoPromo")
    )


def round2(x: Column) -> Column:
    """Two decimals, half to even on the scaled value, in one step: sums do not depend on the order of their rows."""
    return F.rint(x * 100) / 100


def share(part: Column, total: Column) -> Column:
    """`part` as percent of `total`; over a zero total it is 100, and 0 where nothing is known."""
    percent = round2(F.try_divide(part, total) * 100)
    return F.coalesce(F.when((total == 0) & (part != 0), F.lit(100.0)).otherwise(percent), F.lit(0.0))


def distance_share(part: Column, total: Column) -> Column:
    """The share for negative values: 100 plus the signed percent of the total's size."""
    percent = 100 + round2(F.try_divide(part, F.abs(total)) * 100)
    return F.coalesce(F.when((total == 0) & (part != 0), F.lit(100.0)).otherwise(percent), F.lit(0.0))


def direction() -> Column:
    """Which way a significant metric went; null for the others."""
    significant = F.col("Sign") == "Yes"
    return F.when(significant & (F.col("Var") < 0), "decline").when(significant & (F.col("Var") > 0), "gain")
