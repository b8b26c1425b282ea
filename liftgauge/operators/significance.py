"""Pre against post, metric by metric, with one-sample t tests.

The sample of a test is the post rows, the hypothesised mean is the pre value. Metrics stay columns while rows are
aggregated, once and into moments that can be merged; what is left becomes a row per metric, and every cohort is
merged from those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftgauge.functions.exact import parts, whole
from liftgauge.functions.formatting import relative_change, signed_change
from liftgauge.functions.student_t import with_two_sided_p
from liftgauge.params import POST, PRE, Metrics, quoted, text_literal

ALPHA = 0.05


@dataclass(frozen=True)
class Comparison:
    """Which columns are compared and how."""

    weight: str
    weighted: list[str]
    plain: list[str]
    # name of each total, and the SQL value it sums
    totals: Mapping[str, str]
    order: list[str]
    # whether Var% is taken from the size of the pre value, which differs below zero
    signed: bool
    # whether a group has few rows, as many as there are days at most
    small: bool

    def only(self, names: Sequence[str]) -> Comparison:
        """The same comparison of fewer metrics; the other columns are then not even read."""
        return replace(
            self,
            weighted=[m for m in self.weighted if m in names],
            plain=[m for m in self.plain if m in names],
            totals={m: value for m, value in self.totals.items() if m in names},
            order=[m for m in self.order if m in names],
        )


def customer_comparison(metrics: Metrics) -> Comparison:
    plain = ["Frequency%", "Recency"]
    totals = {"Customers_Period": "1"}
    return Comparison(
        "Frequency%", metrics.all, plain, totals, [*metrics.all, *plain, *totals],
        signed=False, small=False,
    )


def day_comparison(metrics: Metrics) -> Comparison:
    plain = ["ActiveCustomer", "Recency"]
    totals = {"DaysCount_Period": "1"} | {f"{m}_Period": quoted(f"{m}_day") for m in metrics.day_totals}
    return Comparison(
        "ActiveCustomer%", metrics.all, plain, totals, [*totals, *metrics.all, *plain],
        signed=True, small=True,
    )


TOTAL, WEIGHT = [f"total{n}" for n in range(3)], [f"weight{n}" for n in range(3)]


def cells(rows: DataFrame, groups: list[str], how: Comparison) -> DataFrame:
    """Moments that can be merged: a row for each group, period, weight and metric, out of one pass over the rows.

    `rows` counts the rows and `known` those with a value; the weighted sum of the values and the weights of all rows are kept in
    their exact parts. `known_weight` is the weight of the known values, `off` the weighted sum of their squared distances
    from their own mean. Rows of one weight are combined on the map side, as their weighted distances are the plain
    ones times the weight; a group has no more weights than the period has days. Totals and plain metrics have weight 1.
    """
    # Each row is a cell of its own where they are few.
    add = (lambda x: x) if how.small else (lambda x: f"sum({x})")
    values, entries = [F.expr("1L" if how.small else "count(1)").alias("rows")], []
    for position, m in enumerate(how.order):
        name, weight = quoted(m), quoted(how.weight) if m in how.weighted else "1D"
        if m in how.totals:
            name = f"double({how.totals[m]})"
        known = f"if({name} IS NULL, 0L, 1L)" if how.small else f"count({name})"
        off = "0D" if how.small or m in how.totals else f"var_pop({name}) * count({name})"
        summed = [add(part) for part in parts(f"{name} * {weight}" if m in how.weighted else name)]
        values += [F.expr(x).alias(f"_{n}{position}") for n, x in zip(("known", "off", *TOTAL), (known, off, *summed), strict=True)]
        fields = {
            "position": position, "Metrics": text_literal(m), "known": f"_known{position}",
            "known_weight": f"double({weight}) * _known{position}", "off": f"double({weight}) * coalesce(_off{position}, 0D)",
            **{n: f"coalesce(_{n}{position}, 0L)" for n in TOTAL},
            **{n: f"{part} * rows" for n, part in zip(WEIGHT, parts(f"double({weight})"), strict=True)},
        }
        entries.append("named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields.items()) + ")")
    keys = [*groups, "Period", *([how.weight] if how.weighted else [])]
    named_keys = [quoted(k) for k in keys]
    wide = rows.select(*named_keys, *values) if how.small else rows.groupBy(*named_keys).agg(*values)
    return wide.select(*groups, "Period", "rows", F.expr(f"inline(array({', '.join(entries)}))"))


def merged(parted: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of each group as one.

    Means come together by their weights; to the squared distances comes that of each part's mean from the common one, so
    that nothing is lost where the spread is small against the mean.
    """
    group = W.partitionBy(*keys, "Period", "position")
    common = F.try_divide(F.sum("_total").over(group), F.sum("known_weight").over(group))
    apart = F.expr("off + coalesce(known_weight * pow(try_divide(_total, known_weight) - _common, 2), 0D)")
    added = ["rows", "known", "known_weight", "off", *TOTAL, *WEIGHT]
    return (
        parted.withColumn("_total", F.expr(whole(*TOTAL))).withColumn("_common", common).withColumn("off", apart)
        .groupBy(*keys, "Period", "position", "Metrics").agg(*[F.sum(n).alias(n) for n in added])
    )


def moments(parted: DataFrame, keys: list[str], how: Comparison) -> DataFrame:
    """Per group, period and metric: value, spread, rows and known values.

    A missing value is left out of a weighted sum, but its weight stays in the divisor. The spread is the population form
    around that mean for weighted metrics, the sample form for the plain ones.
    """
    metric = F.col("Metrics")
    is_total, plain = metric.isin(*how.totals), metric.isin(*how.plain)
    by_weight = F.try_divide("total", "weight")
    value = F.when(is_total, F.col("total")).when(plain, F.try_divide("total", "known")).otherwise(by_weight)
    shifted = F.col("known_weight") * F.pow(F.try_divide("total", "known_weight") - by_weight, F.lit(2))
    around = F.try_divide(F.col("off") + F.coalesce(shifted, F.lit(0.0)), F.col("weight"))
    sample = F.try_divide("off", F.nullif(F.greatest(F.col("known") - 1, F.lit(0)), F.lit(0)))
    return merged(parted, keys).withColumns({"total": F.expr(whole(*TOTAL)), "weight": F.expr(whole(*WEIGHT))}).select(
        *keys, "Period", "position", "Metrics", F.when(is_total | (F.col("known") > 0), value).alias("value"),
        F.when(~is_total, F.sqrt(F.when(plain, sample).otherwise(around))).alias("spread"), "rows", "known")


def paired_values(parted: DataFrame, keys: list[str], how: Comparison) -> DataFrame:
    """Pre and post value of each metric, with what its test needs to know of the post rows."""
    post = f"FILTER (WHERE Period = '{POST}')"
    return moments(parted, keys, how).groupBy(*keys, "position", "Metrics").agg(
        F.expr(f"max(value) FILTER (WHERE Period = '{PRE}')").alias("Pre"),
        F.expr(f"max(value) {post}").alias("Post"),
        F.expr(f"max(spread) {post}").alias("_spread"),
        F.expr(f"coalesce(max(rows) {post}, 0L)").alias("_n"),
        F.expr(f"coalesce(max(known) {post}, 0L)").alias("_known"),
    ).withColumns({"_total": F.col("Metrics").isin(*how.totals), "_signed": F.lit(how.signed)})


def t_statistic(mean: Column, hypothesised: Column, spread: Column, n: Column) -> Column:
    """Infinite where all rows agree on another value, null where they agree on the hypothesis.

    Below a trillionth of the mean a difference is nothing but the order of summing.
    """
    nothing = F.abs(mean) * 1e-12
    apart = mean - hypothesised
    certain = F.when(apart > nothing, F.lit(float("inf"))).when(apart < -nothing, F.lit(float("-inf")))
    return F.when(spread <= nothing, certain).otherwise(F.try_divide(apart, spread / F.sqrt(n)))


def tested(paired: DataFrame, keys: list[str]) -> DataFrame:
    """Difference, t statistic, p-value and sign of paired values."""
    is_total = F.col("_total")
    sound = ~is_total & (F.col("_known") == F.col("_n")) & (F.col("_n") > 1)
    pre, post = F.col("Pre"), F.col("Post")
    compared = paired.withColumns({
        # A total over no rows is zero, a mean over no rows is unknown.
        "Pre": F.when(is_total, F.coalesce(pre, F.lit(0.0))).otherwise(pre),
        "Post": F.when(is_total, F.coalesce(post, F.lit(0.0))).otherwise(post),
    }).withColumns({
        "Var": post - pre,
        "Var%": F.when(F.col("_signed"), signed_change(pre, post)).otherwise(relative_change(pre, post)),
        "t_stat": F.when(sound, t_statistic(post, pre, F.col("_spread"), F.col("_n"))),
        "df": F.when(~is_total, F.col("_n") - 1),
    })
    return (
        with_two_sided_p(compared, "t_stat", "df")
        .withColumn("Sign", F.when(is_total, "NA").when(F.col("p_value") < ALPHA, "Yes").otherwise("No"))
        .select(*keys, "position", "Metrics", "Pre", "Post", "Var", "Var%", "t_stat", "df", "p_value", "Sign")
    )


def customer_cells(
    features: DataFrame, groups: list[str], metrics: Metrics, only: Sequence[str] | None = None
) -> DataFrame:
    """The customers' moments by `groups`; those by segment and initiative serve every cohort."""
    how = customer_comparison(metrics)
    return merged(cells(features, groups, how if only is None else how.only(only)), groups)


def customer_pairs(parted: DataFrame, keys: list[str], metrics: Metrics) -> DataFrame:
    """Pre and post values of groups from their customers' moments."""
    return paired_values(parted, keys, customer_comparison(metrics))


def day_pairs(days: DataFrame, keys: list[str], metrics: Metrics) -> DataFrame:
    how = day_comparison(metrics)
    return paired_values(cells(days, keys, how), keys, how)


def customer_tests(parted: DataFrame, keys: list[str], metrics: Metrics) -> DataFrame:
    """The customer test table of each group: a row per metric."""
    return tested(customer_pairs(parted, keys, metrics), keys)


def day_tests(days: DataFrame, keys: list[str], metrics: Metrics) -> DataFrame:
    """The day test table of each group: a row per metric."""
    return tested(day_pairs(days, keys, metrics), keys)
