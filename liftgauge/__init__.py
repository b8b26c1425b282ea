"""Pre/post campaign measurement as Spark DataFrame jobs."""

from liftgauge.params import ALL, Cohort, Metrics, Periods

__all__ = ["ALL", "Cohort", "Metrics", "Periods"]
