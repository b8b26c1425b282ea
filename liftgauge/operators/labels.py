"""Labels of a customer-day row: period, promo segment, initiative, recency marks.

The customer-wide values are windows over CustomerID rather than an aggregate joined back, so that
one shuffle by customer serves them all. The facts hold one row per customer and day, so such a
window never holds more rows than there are days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from liftgauge.functions.scalar import period_of, promo_segment
from liftgauge.params import NO_INITIATIVE, OUT, POST, PRE, Periods

def _by_customer() -> WindowSpec:
    return W.partitionBy("CustomerID")


def with_period(daily: DataFrame, periods: Periods) -> DataFrame:
    return daily.withColumn("Period", period_of(F.col("Transaction_Date"), periods.pre, periods.post))


def _coupons_in(period: str) -> Column:
    return F.when(F.col("Period") == period, F.col("Coupons_All"))


def promo_pivot(dated: DataFrame) -> DataFrame:
    """Coupons used per customer in each period."""
    return dated.groupBy("CustomerID").agg(
        *[F.coalesce(F.sum(_coupons_in(p)), F.lit(0.0)).alias(f"{p}_Coupons_All") for p in (OUT, POST, PRE)]
    )


def with_promo_segment(dated: DataFrame) -> DataFrame:
    """Segment of the customer; the same on each of the customer's rows."""
    def used(period):
        return F.coalesce(F.sum(_coupons_in(period)).over(_by_customer()), F.lit(0.0))

    return (
        dated.withColumns({"_pre_coupons": used(PRE), "_post_coupons": used(POST)})
        .withColumn("Promo_Segment", promo_segment(F.col("_pre_coupons"), F.col("_post_coupons")))
        .drop("_pre_coupons", "_post_coupons")
    )


def unique_initiatives(initiatives: DataFrame) -> DataFrame:
    """One row per customer; a second one would multiply the facts and fails the job."""
    return (
        initiatives.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("Initiative").alias("_initiative"))
        .select(
            "CustomerID",
            F.when(F.col("_rows") == 1, F.col("_initiative"))
            .otherwise(F.raise_error(F.lit("a customer is listed twice in the initiatives")))
            .alias("Initiative"),
        )
    )


def with_initiative(facts: DataFrame, initiatives: DataFrame) -> DataFrame:
    """Attach the initiative. The table grows with the customers, so Spark sizes it up before broadcasting."""
    joined = facts.join(unique_initiatives(initiatives), "CustomerID", "left")
    return joined.withColumn("Initiative", F.coalesce("Initiative", F.lit(NO_INITIATIVE)))


def label(daily: DataFrame, initiatives: DataFrame, periods: Periods) -> DataFrame:
    return with_promo_segment(with_initiative(with_period(daily, periods), initiatives))


def with_recency_marks(dated: DataFrame, periods: Periods) -> DataFrame:
    """What the recency operators need to know about each customer-day.

    recency_period: the recency window of the day; recency_entry: 1 on the customer's first day in
    it; recency_step: days since the customer's previous day in it, or since `span.start` on the
    first one; last_in_lookback: the customer's last day in the lookback window.
    """
    day = F.col("Transaction_Date")
    pre, post = periods.recency
    in_order = W.partitionBy("CustomerID", "recency_period").orderBy("Transaction_Date")
    inside = F.col("recency_period") != OUT
    origin = F.lit(periods.span.start)
    return (
        dated.withColumn("recency_period", period_of(day, pre, post))
        .withColumn("_previous", F.lag("Transaction_Date").over(in_order))
        .withColumns({
            "recency_entry": F.when(inside & F.col("_previous").isNull(), 1).otherwise(0),
            "recency_step": F.when(inside, F.datediff(day, F.coalesce("_previous", origin))).otherwise(0),
            "last_in_lookback": F.max(F.when(periods.lookback.contains(day), day)).over(_by_customer()),
        })
        .drop("_previous")
    )


def with_switch_marks(dated: DataFrame, periods: Periods) -> DataFrame:
    """What the synthetic control needs to know of the days close to the switch.

    switch_segment: the customer's segment by the coupons used in those days; switch_entry: 1 on the customer's first day of
    them before the switch.
    """
    near = periods.around_switch()
    day = F.col("Transaction_Date")
    place = period_of(day, near.pre, near.post)

    def used(period):
        return F.coalesce(F.sum(F.when(place == period, F.col("Coupons_All"))).over(_by_customer()), F.lit(0.0))

    first = F.min(F.when(place == PRE, day)).over(_by_customer())
    return (
        dated.withColumns({"_near_pre": used(PRE), "_near_post": used(POST), "_near_first": first})
        .withColumns({
            "switch_segment": promo_segment(F.col("_near_pre"), F.col("_near_post")),
            "switch_entry": F.when(day == F.col("_near_first"), 1).otherwise(0),
        })
        .drop("_near_pre", "_near_post", "_near_first")
    )


def mark(daily: DataFrame, initiatives: DataFrame, periods: Periods) -> DataFrame:
    """Labels, recency marks and switch marks together, with one shuffle and one sort by customer."""
    dated = with_initiative(with_period(daily, periods), initiatives)
    return with_switch_marks(with_promo_segment(with_recency_marks(dated, periods)), periods)
