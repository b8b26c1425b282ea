"""A whole analysis: facts, labels, features, tests and comparisons of one pair of periods."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.operators.cohorts import ARM_KEYS, COHORT_GROUPS, GRID_KEYS, assign_all_cohorts, assign_arms
from liftgauge.operators.compare import real_result, rolling_mean, timeline
from liftgauge.operators.customers import customer_delta, customer_features
from liftgauge.operators.days import day_cube, day_features
from liftgauge.operators.facts import daily_facts
from liftgauge.operators.labels import label, mark, with_period
from liftgauge.operators.reports import FROM_CUSTOMERS, combine_tests, formatted, share_range, shares
from liftgauge.operators.significance import customer_cells, customer_pairs, customer_tests, day_pairs, day_tests
from liftgauge.operators.synthetic import cohort_sizes, synthetic_customers, synthetic_days
from liftgauge.params import (
    CONTROL,
    DEFAULT_ARMS,
    DEFAULT_PERIODS,
    FACTS_MONTH,
    TEST,
    Cohort,
    Metrics,
    Periods,
    Window,
)
from liftgauge.session import Store


class Campaign:
    """Tables are DataFrames; nothing but table sizes comes to the driver.

    With `keep=True` the labelled facts are written once to the shared folder, by a job that runs when they are first
    asked for. Turn it off where only one table is wanted.
    """

    def __init__(
        self,
        sales: DataFrame,
        initiatives: DataFrame,
        periods: Periods = DEFAULT_PERIODS,
        arms: Mapping[str, Cohort] = DEFAULT_ARMS,
        metrics: Metrics = Metrics(),
        keep: bool = True,
    ):
        self.sales, self.initiatives = sales, initiatives
        self.periods, self.arms, self.metrics, self.keep = periods, dict(arms), metrics, keep
        self.stored: DataFrame | None = None
        self.store = Store(initiatives.sparkSession, "campaign")

    def __enter__(self) -> Campaign:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete what the analysis, and those made of it by `with_arms`, have written; their tables are then no longer to be read."""
        self.store.close()

    @classmethod
    def from_daily(
        cls,
        daily: DataFrame,
        initiatives: DataFrame,
        periods: Periods = DEFAULT_PERIODS,
        arms: Mapping[str, Cohort] = DEFAULT_ARMS,
        metrics: Metrics = Metrics(),
        keep: bool = True,
    ) -> Campaign:
        """An analysis of customer-day facts, stored with `save_daily_bucketed` or not; sales lines are not read."""
        campaign = cls(None, initiatives, periods, arms, metrics, keep)
        campaign.stored = daily
        return campaign

    def with_periods(self, periods: Periods) -> Campaign:
        """The same facts and arms in other periods."""
        other = Campaign(self.sales, self.initiatives, periods, self.arms, self.metrics, self.keep)
        other.stored = self.stored
        return other

    def with_arms(self, arms: Mapping[str, Cohort]) -> Campaign:
        """Other arms in the same periods; labelled facts, customer features and the day cube are shared."""
        other = self.with_periods(self.periods)
        other.arms, other.store = dict(arms), self.store
        for shared in ("daily", "labelled", "marked", "customers", "cube"):
            # A cached property is filled in by its first use; what no arm changes is worked out here once.
            other.__dict__[shared] = getattr(self, shared)
        return other

    @cached_property
    def daily(self) -> DataFrame:
        """Customer-day facts of all days."""
        if self.stored is not None:
            return self.stored.drop(FACTS_MONTH)
        return daily_facts(self.sales, self.metrics)

    @cached_property
    def labelled(self) -> DataFrame:
        """Facts of all days with period, segment and initiative."""
        return label(self.daily, self.initiatives, self.periods)

    def _facts_within(self, days: Window) -> DataFrame:
        """Facts of some days only; the bound reaches the scan, as a choice of months where facts are stored by month."""
        if self.stored is not None:
            facts = self.stored
            if FACTS_MONTH in facts.columns:
                facts = facts.where(F.col(FACTS_MONTH).between(
                    F.lit(days.start.replace(day=1)), F.lit(days.end.replace(day=1)))).drop(FACTS_MONTH)
            return facts.where(days.contains(F.col("Transaction_Date")))
        return daily_facts(self.sales.where(days.contains(F.col("Transaction_Date"))), self.metrics)

    @cached_property
    def marked(self) -> DataFrame:
        """Labelled facts with recency marks, of the days that can change a result."""
        facts = mark(self._facts_within(self.periods.scanned), self.initiatives, self.periods)
        return self.store.written(facts, "marked") if self.keep else facts

    @cached_property
    def customers(self) -> DataFrame:
        """Customer features of all cohorts."""
        return customer_features(self.marked, self.metrics, self.periods)

    @cached_property
    def cube(self) -> DataFrame:
        """Day sums of all segments and initiatives."""
        return day_cube(self.marked, self.metrics)

    @cached_property
    def days(self) -> DataFrame:
        """Day features of the arms."""
        return day_features(assign_arms(self.cube, self.arms), ARM_KEYS, self.metrics, self.periods)

    @cached_property
    def customer_cells(self) -> DataFrame:
        """The customers' moments by segment and initiative, out of which every cohort's are merged."""
        return customer_cells(self.customers, COHORT_GROUPS, self.metrics)

    @cached_property
    def taken_cells(self) -> DataFrame:
        """Moments of the customer metrics alone that the combined result takes over; no other is worked out."""
        return customer_cells(self.customers, COHORT_GROUPS, self.metrics, only=FROM_CUSTOMERS)

    @cached_property
    def customer_tests(self) -> DataFrame:
        return customer_tests(assign_arms(self.customer_cells, self.arms), ARM_KEYS, self.metrics)

    @cached_property
    def day_tests(self) -> DataFrame:
        return day_tests(self.days, ARM_KEYS, self.metrics)

    @cached_property
    def result(self) -> DataFrame:
        return self._combined(self.days, assign_arms(self.taken_cells, self.arms), ARM_KEYS)

    def _combined(self, days: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
        taken = customer_pairs(people, keys, self.metrics)
        return combine_tests(day_pairs(days, keys, self.metrics), taken, keys, self.metrics)

    @cached_property
    def formatted(self) -> DataFrame:
        return formatted(self.result, self.metrics)

    @cached_property
    def shares(self) -> DataFrame:
        return shares(self.result, ARM_KEYS)

    @cached_property
    def share_range(self) -> DataFrame:
        return share_range(self.shares, ARM_KEYS)

    @cached_property
    def customer_delta(self) -> DataFrame:
        return customer_delta(self.customers, self.arms)

    @cached_property
    def real_result(self) -> DataFrame:
        return real_result(self.result)

    def timeline(self, metric: str) -> DataFrame:
        return timeline(with_period(self.daily, self.periods), metric, self.metrics)

    def test_vs_control(self, metric: str, rows: int) -> DataFrame:
        return rolling_mean(self.days, ARM_KEYS, metric, rows)

    @cached_property
    def grid(self) -> DataFrame:
        """The result table of every cohort that can be chosen, from the same passes over the facts."""
        days = day_features(assign_all_cohorts(self.cube), GRID_KEYS, self.metrics, self.periods)
        return self._combined(days, assign_all_cohorts(self.taken_cells), GRID_KEYS)

    @cached_property
    def customer_grid(self) -> DataFrame:
        """The customer test table of every cohort that can be chosen."""
        return customer_tests(assign_all_cohorts(self.customer_cells), GRID_KEYS, self.metrics)

    @cached_property
    def synthetic_days(self) -> DataFrame:
        # Read several times over, and no more rows than days.
        days = self.store.written(self.days, "days") if self.keep else self.days
        return synthetic_days(days, self.metrics)

    @cached_property
    def synthetic_customers(self) -> DataFrame:
        test, control = self.arms[TEST], self.arms[CONTROL]
        # Read twice over: for the sizes of its groups and for the draws.
        people = self.store.written(self.customers, "customers") if self.keep else self.customers
        return synthetic_customers(people, cohort_sizes(self.marked, test, control), test, control)

    @cached_property
    def synthetic_result(self) -> DataFrame:
        """The result table against the synthetic control."""
        people = customer_cells(self.synthetic_customers, ARM_KEYS, self.metrics, only=FROM_CUSTOMERS)
        return self._combined(self.synthetic_days, people, ARM_KEYS)

    @cached_property
    def synthetic_real_result(self) -> DataFrame:
        return real_result(self.synthetic_result)
