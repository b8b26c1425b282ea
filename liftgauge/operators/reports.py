"""The combined result table and what is shown of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.functions.exact import exact_avg, exact_sum
from liftgauge.functions.formatting import metric_text
from liftgauge.functions.scalar import direction, distance_share, share
from liftgauge.operators.significance import tested
from liftgauge.params import Metrics

# The rows taken over from the customer table, the row without a share.
FROM_CUSTOMERS = ("Frequency%", "Customers_Period")
WITHOUT_SHARE = "DaysCount_Period"
SIGNED = "Recency"
RESULT_COLUMNS = ("metric_order", "Metrics", "Pre", "Post", "Var", "Var%", "Sign")


def metric_order(metrics: Metrics):
    """Place in the report; a metric the order does not name comes last."""
    order = metrics.report_order
    place = F.array_position(F.lit(order), F.col("Metrics"))
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


def combine_tests(day_pairs: DataFrame, customer_pairs: DataFrame, keys: list[str], metrics: Metrics) -> DataFrame:
    """All day metrics and the two customer metrics that the day table lacks, tested together."""
    taken = customer_pairs.where(F.col("Metrics").isin(*FROM_CUSTOMERS))
    return (
        tested(day_pairs.unionByName(taken), keys)
        .withColumn("metric_order", metric_order(metrics))
        .select(*keys, *RESULT_COLUMNS)
    )


def formatted(result: DataFrame, metrics: Metrics) -> DataFrame:
    """Numbers as text, with the unformatted difference and its direction beside them."""
    return result.withColumns({
        "Var2": F.col("Var"),
        "direction": direction(),
        **{c: metric_text(F.col(c), metrics) for c in ("Pre", "Post", "Var")},
    })


def shares(result: DataFrame, keys: list[str]) -> DataFrame:
    """Pre and Post as percent of their total."""
    total = F.coalesce("Pre", F.lit(0.0)) + F.coalesce("Post", F.lit(0.0))

    def percent(column):
        signed = distance_share(F.col(column), total)
        return F.when(F.col("Metrics") == SIGNED, signed).otherwise(share(F.col(column), total))

    return result.where(F.col("Metrics") != WITHOUT_SHARE).select(
        *keys, "metric_order", "Metrics", percent("Pre").alias("Pre"), percent("Post").alias("Post")
    )


def share_range(share_table: DataFrame, keys: list[str]) -> DataFrame:
    """Axis range of the share table: from zero to the largest share."""
    return share_table.groupBy(*keys).agg(
        F.lit(0.0).alias("min_value"), F.max(F.greatest("Pre", "Post")).alias("max_value")
    )


def validation(labelled: DataFrame) -> DataFrame:
    """Means and sums per segment and period, to check the labels by eye."""
    counted, added = ("Transactions",), ("Quantity_All", "Sales_All")
    return labelled.groupBy("Promo_Segment", "Period").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in counted], *[F.expr(exact_avg(m)).alias(f"{m}_mean") for m in added],
        *[F.sum(m).alias(f"{m}_sum") for m in counted], *[F.expr(exact_sum(m)).alias(f"{m}_sum") for m in added],
    )
