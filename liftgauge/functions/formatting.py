"""Numbers as report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftgauge.params import Metrics


def fixed2_percent(x: Column) -> Column:
    return F.concat(F.call_function("format_number", x, F.lit("0.00")), F.lit("%"))


def whole_number(x: Column) -> Column:
    return F.format_number(x, 0)


def currency(x: Column) -> Column:
    return F.concat(F.lit("$"), whole_number(x))


def metric_text(x: Column, metrics: Metrics) -> Column:
    """Currency, percent or whole number, by the row's metric."""
    metric = F.col("Metrics")
    return (
        F.when(metric.isin(*metrics.currency), currency(x))
        .when(metric.isin(*metrics.percent), fixed2_percent(x * 100))
        .otherwise(whole_number(x))
    )


def relative_change(pre: Column, post: Column) -> Column:
    """Var% of the customer table."""
    return _change_text(pre, post, (F.try_divide(post, pre) - 1) * 100)


def signed_change(pre: Column, post: Column) -> Column:
    """Var% of the day table; differs from `relative_change` where pre is negative."""
    return _change_text(pre, post, F.try_divide(post - pre, F.abs(pre)) * 100)


def _change_text(pre: Column, post: Column, change: Column) -> Column:
    return F.when((pre == 0) | (post == 0), "NA").otherwise(fixed2_percent(change))
