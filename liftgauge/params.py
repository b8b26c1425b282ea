"""The parameters of an analysis: two date ranges, the compared cohorts, the metric names."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = "All"
# The first day of the month, by which stored facts are partitioned.
FACTS_MONTH = "Facts_Month"

# Labels written into the result tables.
PRE, POST, OUT = "Pre", "Post", "Out"
OTHER = "Other"
NO_INITIATIVE = "NoInitiative"
PROMO_SEGMENTS = ("NoPromo", "PromoPre", "PromoPost", "Promo")


def _as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


@dataclass(frozen=True)
class Window:
    """A closed range of days."""

    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def contains(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))


@dataclass(frozen=True)
class Periods:
    """The pre and the post period, both with inclusive bounds."""

    pre_ini: date
    pre_end: date
    post_ini: date
    post_end: date

    @classmethod
    def of(cls, pre_ini, pre_end, post_ini, post_end) -> Periods:
        return cls(*map(_as_date, (pre_ini, pre_end, post_ini, post_end)))

    def __post_init__(self):
        if self.pre_end < self.pre_ini or self.post_end < self.post_ini:
            raise ValueError("a period must not end before it starts")

    @property
    def pre(self) -> Window:
        return Window(self.pre_ini, self.pre_end)

    @property
    def post(self) -> Window:
        return Window(self.post_ini, self.post_end)

    @property
    def lookback(self) -> Window:
        """Days in which a post customer must have bought to get a recency."""
        return Window(self.post_end - timedelta(days=self.pre.days), self.post_end)

    @property
    def recency(self) -> tuple[Window, Window]:
        """The pre and post windows of the day recency: the longer period is cut down.

        The cut side keeps one day more than the shorter period has.
        """
        if self.post.days > self.pre.days:
            cut_end = self.post_ini + timedelta(days=self.pre.days)
            return self.pre, Window(self.post_ini, cut_end)
        cut_start = self.pre_end - timedelta(days=self.post.days)
        return Window(cut_start, self.pre_end), self.post

    @property
    def span(self) -> Window:
        """Every day that can change a result; scans may skip the rest."""
        used = (self.pre, self.post, self.lookback, *self.recency)
        return Window(min(w.start for w in used), max(w.end for w in used))

    @property
    def scanned(self) -> Window:
        """The span, widened to the days close to the switch where a period is shorter than those."""
        near = self.around_switch()
        return Window(min(self.span.start, near.pre_ini), max(self.span.end, near.post_end))

    def around_switch(self, days: int = 35) -> Periods:
        """The last `days` pre days against the first `days` post days."""
        reach = timedelta(days=days - 1)
        return Periods(self.pre_end - reach, self.pre_end, self.post_ini, self.post_ini + reach)


@dataclass(frozen=True)
class Cohort:
    """Customers by promo segment and initiative; `All` matches every value."""

    promo: str = ALL
    initiative: str = ALL

    def __post_init__(self):
        if self.promo not in (ALL, *PROMO_SEGMENTS):
            raise ValueError(f"unknown promo segment {self.promo!r}")

    def matches(self) -> Column:
        tests = []
        if self.promo != ALL:
            tests.append(F.col("Promo_Segment") == self.promo)
        if self.initiative != ALL:
            tests.append(F.col("Initiative") == self.initiative)
        return reduce(lambda a, b: a & b, tests, F.lit(True))


TEST, CONTROL = "test", "control"
DEFAULT_ARMS = {TEST: Cohort(ALL, "BuyOneGetOne"), CONTROL: Cohort("NoPromo", NO_INITIATIVE)}
DEFAULT_PERIODS = Periods.of("2019-01-29", "2019-04-30", "2019-05-01", "2019-07-31")


@dataclass(frozen=True)
class Metrics:
    """Metric names for the product categories that keep their own columns."""

    kept: tuple[str, ...] = ("Apparel", "Nest-USA")
    buckets: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if OTHER in self.kept or len(set(self.kept)) != len(self.kept):
            raise ValueError("kept categories must be distinct and must not include 'Other'")
        object.__setattr__(self, "buckets", (*self.kept, OTHER))

    def by_bucket(self, measure: str) -> list[str]:
        return [f"{measure}_{bucket}" for bucket in self.buckets]

    @property
    def additive(self) -> list[str]:
        """Metrics that may be summed over days and customers."""
        split = [f"{m}_{b}" for b in self.buckets for m in ("Quantity", "Sales", "Coupons")]
        return ["Transactions", "Quantity_All", "Sales_All", "Coupons_All", *split]

    @property
    def counts(self) -> list[str]:
        """Metrics that are whole numbers, whose sums are exact as they are."""
        return ["Transactions", "Coupons_All", *self.by_bucket("Coupons")]

    @property
    def all(self) -> list[str]:
        split = [f"{m}_{b}" for b in self.buckets for m in ("Quantity", "Sales", "Coupons")]
        return ["Transactions", "Quantity_All", "Price_All", "Sales_All", "Coupons_All", *split]

    @property
    def day_totals(self) -> list[str]:
        return ["Transactions", "Quantity_All", "Sales_All", "Coupons_All"]

    @property
    def report_order(self) -> list[str]:
        """Row order of the combined result; Frequency% has no place in it and comes last."""
        return [
            "DaysCount_Period",
            *(f"{m}_Period" for m in self.day_totals),
            "Customers_Period",
            "ActiveCustomer",
            "Transactions",
            "Price_All",
            "Quantity_All", *self.by_bucket("Quantity"),
            "Sales_All", *self.by_bucket("Sales"),
            "Coupons_All", *self.by_bucket("Coupons"),
            "Recency",
        ]

    @property
    def currency(self) -> list[str]:
        return ["Price_All", "Sales_All_Period", "Sales_All", *self.by_bucket("Sales")]

    @property
    def percent(self) -> list[str]:
        return ["Frequency%"]


def named(name: str) -> Column:
    """A column by its literal name, whatever signs the name holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """A column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """A string value for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
