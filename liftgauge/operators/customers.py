"""Features per customer and period, and the per-customer delta table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgauge.functions.scalar import period_days, round2
from liftgauge.operators.cohorts import assign_arms
from liftgauge.operators.facts import mean
from liftgauge.params import OUT, POST, PRE, Cohort, Metrics, Periods, named


def customer_features(marked: DataFrame, metrics: Metrics, periods: Periods) -> DataFrame:
    """Metric means, frequency and recency per period and customer.

    Segment and initiative belong to the customer, so the features are the same for every cohort
    and a cohort is a filter on this table. A post customer without a purchase in the lookback
    window has no recency and is left out.
    """
    by_customer = (
        marked.where(F.col("Period") != OUT)
        .groupBy("Period", "CustomerID", "Promo_Segment", "Initiative")
        .agg(
            *[mean(m, metrics).alias(m) for m in metrics.all],
            F.count("Transaction_Date").alias("_active_days"),
            F.max("Transaction_Date").alias("_last_day"),
            F.max("last_in_lookback").alias("_last_in_lookback"),
        )
    )
    recency = F.when(
        F.col("Period") == PRE, F.datediff(F.lit(periods.pre_end), "_last_day")
    ).otherwise(F.datediff(F.lit(periods.post_end), "_last_in_lookback"))
    return (
        by_customer.withColumns({
            "Frequency%": F.col("_active_days") / period_days(periods),
            "Recency": recency,
        })
        .where(F.col("Recency").isNotNull())
        .drop("_active_days", "_last_day", "_last_in_lookback")
    )


def active_span(dated: DataFrame, *keys: str) -> DataFrame:
    """Days from the first to the last active day of each group."""
    return dated.groupBy(*keys).agg(
        (F.datediff(F.max("Transaction_Date"), F.min("Transaction_Date")) + 1).alias("span_days")
    )


# The compared metrics, in column order, and those shown as percent.
DELTA_METRICS = ("Sales_All", "Quantity_All", "Frequency%", "Recency", "Coupons_All", "Transactions")
DELTA_PERCENT = ("Frequency%",)


def customer_delta(features: DataFrame, arms: Mapping[str, Cohort]) -> DataFrame:
    """Post value and post minus pre per customer; customers of one period only are kept.

    The full outer join of the two periods is one grouping, as each customer has at most one row
    in each.
    """
    def value(metric: str, period: str) -> Column:
        return F.max(F.when(F.col("Period") == period, named(metric)))

    both = assign_arms(features, arms).groupBy("arm", "CustomerID").agg(
        *[value(m, p).alias(f"{m}|{p}") for m in DELTA_METRICS for p in (PRE, POST)]
    )
    shown = []
    for metric in DELTA_METRICS:
        scale = 100 if metric in DELTA_PERCENT else 1
        post, pre = named(f"{metric}|{POST}"), named(f"{metric}|{PRE}")
        shown += [round2(post * scale).alias(f"{metric}_post"), round2((post - pre) * scale).alias(f"{metric}_D")]
    promo, initiative = _choice_columns(arms)
    return both.select(
        "arm", promo.alias("Promo_Segment"), initiative.alias("Initiative"), "CustomerID", *shown
    )


def _choice_columns(arms: Mapping[str, Cohort]) -> tuple[Column, Column]:
    """The cohort choice of the row's arm."""
    def pick(attribute):
        return reduce(
            lambda otherwise, item: F.when(F.col("arm") == item[0], getattr(item[1], attribute)).otherwise(otherwise),
            arms.items(),
            F.lit(None).cast("string"),
        )

    return pick("promo"), pick("initiative")
