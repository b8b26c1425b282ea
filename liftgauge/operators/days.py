"""Features per day and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftgauge.functions.exact import parts, whole
from liftgauge.functions.scalar import period_of
from liftgauge.params import OUT, POST, PRE, Metrics, Periods, named, quoted


def day_cube(marked: DataFrame, metrics: Metrics) -> DataFrame:
    """Sums per day, segment and initiative: all that any cohort's day table needs.

    One pass over the facts with map-side sums; the result has no more rows than days times
    segments times initiatives, whatever the number of customers. Sums that are not whole numbers are kept in their
    exact parts, so that cohorts can be added up from them.
    """
    return (
        marked.where((F.col("Period") != OUT) | (F.col("recency_period") != OUT))
        .groupBy("Promo_Segment", "Initiative", "Transaction_Date")
        .agg(
            *[F.expr(f"sum({value})").alias(name) for m in metrics.all for name, value in _added(m, metrics).items()],
            F.count(F.lit(1)).alias("_rows"),
            F.count("Price_All").alias("_priced"),
            F.sum("recency_entry").alias("_entries"),
            F.sum("recency_step").alias("_steps"),
        )
    )


def _added(metric: str, metrics: Metrics) -> dict[str, str]:
    """The whole numbers that are added up for a metric, by column name."""
    if metric in metrics.counts:
        return {metric: quoted(metric)}
    return {f"{metric}|{place}": part for place, part in enumerate(parts(quoted(metric)))}


def day_features(cube: DataFrame, keys: list[str], metrics: Metrics, periods: Periods) -> DataFrame:
    """Day table of each group in `keys`, from a cube whose rows were assigned to those groups."""
    sums = {
        m: f"sum({quoted(m)})" if m in metrics.counts
        else whole(*(f"sum({quoted(name)})" for name in _added(m, metrics)))
        for m in metrics.all
    } | {m: f"sum({m})" for m in ("_rows", "_priced", "_entries", "_steps")}
    days = cube.groupBy(*keys, "Transaction_Date").agg(*[F.expr(value).alias(m) for m, value in sums.items()])
    in_period = W.partitionBy(*keys, "Period")
    counts = {m: "_priced" if m == "Price_All" else "_rows" for m in metrics.all}
    return (
        _with_recency(days, keys, periods)
        .withColumn("Period", period_of(F.col("Transaction_Date"), periods.pre, periods.post))
        .where(F.col("Period") != OUT)
        .withColumn("Recency", F.when(F.col("Period") == PRE, F.col("_pre_recency")).otherwise(F.col("_post_recency")))
        .select(
            *keys,
            "Period",
            "Transaction_Date",
            *[F.try_divide(quoted(m), n).alias(m) for m, n in counts.items()],
            F.col("_rows").alias("ActiveCustomer"),
            (F.col("_rows") / F.sum("_rows").over(in_period)).alias("ActiveCustomer%"),
            *[named(m).alias(f"{m}_day") for m in metrics.day_totals],
            "Recency",
        )
    )


def _with_recency(days: DataFrame, keys: list[str], periods: Periods) -> DataFrame:
    """Mean recency of the customers seen so far, without a row per customer and calendar day.

    On day d, with N customers seen and S the sum of their last active days, the mean distance is
    (N * d - S) / N. Both are running sums over the days: a customer's first day adds one to N,
    every active day adds its distance from the previous one to S.
    """
    day = F.col("Transaction_Date")
    so_far = W.partitionBy(*keys).orderBy("Transaction_Date").rowsBetween(W.unboundedPreceding, 0)
    elapsed = F.datediff(day, F.lit(periods.span.start))
    pre, post = periods.recency
    window_of_day = period_of(day, pre, post)

    def mean_recency(period, window):
        def running(column):
            return F.sum(F.when(window_of_day == period, F.col(column)).otherwise(0)).over(so_far)

        seen = running("_entries")
        distance = running("_steps") - seen * elapsed
        return F.when(day <= F.lit(window.end), F.try_divide(distance.cast("double"), seen))

    return days.withColumns({"_pre_recency": mean_recency(PRE, pre), "_post_recency": mean_recency(POST, post)})


def active_runs(marked: DataFrame, periods: Periods, keys: list[str]) -> DataFrame:
    """The calendar of each customer as runs: from an active day to the day before the next one, the last to the window's end.

    `last_seen` is the run's first day, `until` its last. There is a run for each active day, however long the windows are.
    """
    pre, post = periods.recency
    window_end = F.when(F.col("recency_period") == PRE, F.lit(pre.end)).otherwise(F.lit(post.end))
    in_order = W.partitionBy(*keys, "recency_period", "CustomerID").orderBy("Transaction_Date")
    following = F.date_sub(F.lead("Transaction_Date").over(in_order), 1)
    return marked.where(F.col("recency_period") != OUT).select(
        *keys, F.col("recency_period").alias("Period"), "CustomerID", F.col("Transaction_Date").alias("last_seen"),
        F.coalesce(following, window_end).alias("until"),
    )


def customer_calendar(marked: DataFrame, periods: Periods, keys: list[str]) -> DataFrame:
    """Every day of each customer from the first active day of a recency window to its end.

    last_seen is the customer's latest active day up to that day. Each run is spread over its days by itself: the days are neither
    joined with the active ones nor filled up along a window.
    """
    runs = active_runs(marked, periods, keys)
    day = F.explode(F.sequence("last_seen", "until", F.expr("INTERVAL 1 DAY"))).alias("Transaction_Date")
    return runs.select(*keys, "Period", "CustomerID", "last_seen", day)


def calendar_recency(calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Mean day recency in the long way, row by row of the calendar."""
    distance = -F.datediff("Transaction_Date", "last_seen")
    return calendar.groupBy(*keys, "Period", "Transaction_Date").agg(F.avg(distance).alias("Recency"))
