"""A control group made to look like the test group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from liftgauge.functions.exact import exact_avg
from liftgauge.params import CONTROL, POST, PRE, TEST, Cohort, Metrics, named, quoted

# How many days set the proportion, the seed of the draw.
LAST_DAYS = 35
SEED = 45
HASH_DIGITS = 3
# Draws that are made from one row.
CHUNK = 1 << 16


def last_pre_days(days: DataFrame, n: int = LAST_DAYS) -> DataFrame:
    """The last `n` pre days of each arm."""
    latest_first = W.partitionBy("arm").orderBy(F.desc("Transaction_Date"))
    return (
        days.where(F.col("Period") == PRE)
        .withColumn("_place", F.row_number().over(latest_first))
        .where(F.col("_place") <= n)
        .drop("_place")
    )


def trailing_means(days: DataFrame, metrics: Metrics, n: int = LAST_DAYS) -> DataFrame:
    compared = [*metrics.all, "ActiveCustomer"]
    return last_pre_days(days, n).groupBy("arm").agg(*[F.expr(exact_avg(quoted(m))).alias(m) for m in compared])


def proportions(days: DataFrame, metrics: Metrics, n: int = LAST_DAYS) -> DataFrame:
    """Test over control on the last pre days, one row; zero where the control has nothing to scale."""
    compared = [*metrics.all, "ActiveCustomer"]
    means = trailing_means(days, metrics, n)

    def mean_of(arm: str, m: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, named(m)))

    return means.agg(
        *[F.coalesce(F.try_divide(mean_of(TEST, m), mean_of(CONTROL, m)), F.lit(0.0)).alias(m) for m in compared]
    )


def synthetic_days(days: DataFrame, metrics: Metrics) -> DataFrame:
    """The day table with the control replaced.

    Before the switch the control is the test arm itself; after it, the control's own days scaled to
    the test arm's size. Price, customer share and recency stay the control's.
    """
    scaled = [*metrics.additive, "ActiveCustomer"]
    factors = proportions(days, metrics).select(
        F.lit(CONTROL).alias("arm"), *[named(m).alias(f"{m}|factor") for m in scaled]
    )
    test = days.where(F.col("arm") == TEST).withColumn("ActiveCustomer", F.col("ActiveCustomer").cast("double"))
    before = test.where(F.col("Period") == PRE).withColumn("arm", F.lit(CONTROL))
    # One row: a global aggregate.
    after = days.where((F.col("arm") == CONTROL) & (F.col("Period") == POST)).join(F.broadcast(factors), "arm")
    after = after.withColumns({m: named(m) * named(f"{m}|factor") for m in scaled})
    after = after.withColumns({f"{m}_day": named(m) * F.col("ActiveCustomer") for m in metrics.day_totals})
    return test.unionByName(before).unionByName(after.select(*test.columns))


def cohort_sizes(marked: DataFrame, test: Cohort, control: Cohort) -> DataFrame:
    """How many customers of both cohorts bought close before the switch, in one row: n_test, n_control.

    Cohorts are chosen by the segment of the days around the switch. Each customer is marked on one row, so this is a count.
    """
    customers = marked.where(F.col("switch_entry") == 1).select(F.col("switch_segment").alias("Promo_Segment"), "Initiative")
    return customers.agg(
        F.count_if(test.matches()).alias("n_test"), F.count_if(control.matches()).alias("n_control"))


def _hash_number(*parts: Column) -> Column:
    """A whole number below 2**60 from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _grouped(rows: DataFrame, key: str, digits: int) -> DataFrame:
    return rows.withColumn("_group", F.substring(F.md5(named(key).cast("string")), 1, digits))


def draw_plan(rows: DataFrame, key: str, fraction: float | DataFrame, seed: int = SEED, digits: int = HASH_DIGITS) -> DataFrame:
    """(draw, _group, _place): which row of which hash group each draw takes.

    The draws fall on the pool as if its rows stood in the order of their groups, so how many a group gets is multinomial, and
    they are exactly round(fraction * n) in all. Only the groups' sizes are added up, at most 16**digits
    numbers, inside the job; no row is numbered over the whole pool and nothing is counted beforehand.
    """
    slots = 16**digits
    sizes = _grouped(rows, key, digits).groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    placed = sizes.select(
        "_group", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(everything).alias("_n"))
    # A slot is one of `slots` even stretches of the pool; a group lies over those that it touches.
    spread = placed.withColumn("_slot", F.explode(F.expr(
        f"sequence(_start * {slots}L div _n, (_start + _size - 1) * {slots}L div _n)")))
    share = fraction if isinstance(fraction, DataFrame) else rows.sparkSession.range(1).select(F.lit(float(fraction)).alias("fraction"))
    wanted = sizes.agg(F.sum("_size").alias("_n")).join(F.broadcast(share)).select(
        "_n", F.rint(F.col("fraction") * F.col("_n")).cast("long").alias("_draws"))
    chunks = wanted.where(F.col("_draws") > 0).withColumn(
        "_chunk", F.explode(F.expr(f"sequence(0L, (_draws - 1) div {CHUNK}L)"))).repartition("_chunk")
    draws = chunks.withColumn("draw", F.explode(F.expr(
        f"sequence(_chunk * {CHUNK}L, least(_draws, (_chunk + 1) * {CHUNK}L) - 1)"))).withColumn(
        "_at", F.pmod(_hash_number(F.col("draw").cast("string"), F.lit(str(seed))), F.col("_n")))
    # At most two rows for each slot and one for each group.
    return (
        draws.withColumn("_slot", F.expr(f"_at * {slots}L div _n")).drop("_n")
        .join(F.broadcast(spread.drop("_n")), "_slot")
        .where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_size")))
        .select("draw", "_group", (F.col("_at") - F.col("_start")).alias("_place"))
    )


def bootstrap(rows: DataFrame, key: str, fraction: float | DataFrame, seed: int = SEED, digits: int = HASH_DIGITS) -> DataFrame:
    """round(fraction * n) rows drawn with replacement; the same rows at every run.

    `fraction` is a number or a table of one row with a column of that name. Draw i takes place hash(i, seed) mod n,
    so the size is exact and the result does not depend on the partitioning. Places are counted within hash groups by
    `key`, which must be unique. Nothing runs before the result is asked for; an empty pool gives no rows.
    """
    within = W.partitionBy("_group").orderBy(key)
    pool = _grouped(rows, key, digits).withColumn("_place", (F.row_number().over(within) - 1).cast("long"))
    return draw_plan(rows, key, fraction, seed, digits).join(pool, ["_group", "_place"]).select("draw", *rows.columns)


def synthetic_customers(
    features: DataFrame, sizes: DataFrame, test: Cohort, control: Cohort, seed: int = SEED
) -> DataFrame:
    """The customer table with the control replaced, tagged with its arm.

    The control's pre customers become the test arm's; its post customers are redrawn to the ratio that the two cohorts'
    `sizes` (see `cohort_sizes`) have close to the switch. A control cohort without customers there fails the job.
    """
    none = F.raise_error(F.lit("the control cohort has no customers before the switch"))
    fraction = sizes.select(
        F.when(F.col("n_control") == 0, none).otherwise(F.try_divide("n_test", "n_control")).cast("double").alias("fraction"))
    own = features.where(test.matches())
    before = own.where(F.col("Period") == PRE)
    pool = features.where(control.matches() & (F.col("Period") == POST))
    after = bootstrap(pool, "CustomerID", fraction, seed).drop("draw")
    return (
        own.withColumn("arm", F.lit(TEST))
        .unionByName(before.withColumn("arm", F.lit(CONTROL)))
        .unionByName(after.withColumn("arm", F.lit(CONTROL)))
    )
