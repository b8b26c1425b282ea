"""Timelines, and test against control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.functions.exact import exact_avg
from liftgauge.functions.formatting import fixed2_percent
from liftgauge.operators.facts import total
from liftgauge.params import CONTROL, TEST, Metrics, named, quoted


def day_sums(dated: DataFrame, metrics: Metrics) -> DataFrame:
    """Every metric summed per day and period."""
    return dated.groupBy("Transaction_Date", "Period").agg(*[total(m, metrics).alias(m) for m in metrics.all])


def timeline(dated: DataFrame, metric: str, metrics: Metrics) -> DataFrame:
    return day_sums(dated, metrics).select("Period", "Transaction_Date", named(metric).alias("value"))


def rolling_mean(days: DataFrame, keys: list[str], metric: str, rows: int) -> DataFrame:
    """Mean over the last `rows` active days; null until that many values are there."""
    frame = f"""OVER (PARTITION BY {", ".join(map(quoted, [*keys, "Period"]))} ORDER BY Transaction_Date
                     ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"""
    value = quoted(metric)
    return days.select(
        *keys,
        "Period",
        "Transaction_Date",
        F.col(value).alias("value"),
        F.expr(f"CASE WHEN count({value}) {frame} = {rows} THEN {exact_avg(value, frame)} END").alias("moving_average"),
    )


def real_result(result: DataFrame) -> DataFrame:
    """The test arm's change less the control arm's, as a result table.

    Where the control has a zero there is nothing to subtract and the test's own change stands.
    """
    is_test, is_control = F.col("arm") == TEST, F.col("arm") == CONTROL
    # One row per metric and arm, so this lookup by metric is a grouping and reads the result once.
    test = [F.max(F.when(is_test, named(c))).alias(f"test_{c}") for c in ("Pre", "Post", "Var", "Var%", "Sign")]
    control = [F.max(F.when(is_control, F.col(c))).alias(f"control_{c}") for c in ("Pre", "Post")]
    paired = (
        result.groupBy("Metrics")
        .agg(
            F.max(F.when(is_test, F.col("metric_order"))).alias("metric_order"),
            *test,
            *control,
            F.count_if(is_test).alias("_tests"),
            F.count_if(is_control).alias("_controls"),
        )
        .where((F.col("_tests") > 0) & (F.col("_controls") > 0))
    )
    nothing_to_subtract = (F.col("control_Pre") == 0) | (F.col("control_Post") == 0)
    lift = (F.try_divide("test_Post", "test_Pre") - 1) - (F.try_divide("control_Post", "control_Pre") - 1)
    pre = F.col("test_Pre")
    return paired.select(
        "metric_order",
        "Metrics",
        pre.alias("Pre"),
        F.when(nothing_to_subtract, F.col("test_Post")).otherwise(pre + pre * lift).alias("Post"),
        F.when(nothing_to_subtract, F.col("test_Var")).otherwise(pre * lift).alias("Var"),
        F.when(nothing_to_subtract, named("test_Var%")).otherwise(fixed2_percent(lift * 100)).alias("Var%"),
        F.col("test_Sign").alias("Sign"),
    )
