"""Choosing customers: the wildcard filter, the compared arms, all cohorts at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.params import ALL, Cohort

# What a customer is chosen by.
COHORT_GROUPS = ["Promo_Segment", "Initiative"]
ARM_KEYS = ["arm"]
# The flag keeps the wildcard apart from an initiative that happens to be called All.
GRID_KEYS = ["promo_choice", "initiative_choice", "any_initiative"]


def in_cohort(labelled: DataFrame, cohort: Cohort) -> DataFrame:
    return labelled.where(cohort.matches())


def assign_arms(rows: DataFrame, arms: Mapping[str, Cohort]) -> DataFrame:
    """Rows of every arm they belong to, so that one job serves all arms."""
    hits = [F.when(cohort.matches(), F.lit(arm)) for arm, cohort in arms.items()]
    return rows.withColumn("arm", F.explode(F.array_compact(F.array(*hits))))


def assign_all_cohorts(rows: DataFrame) -> DataFrame:
    """Rows of every cohort a user can choose: each segment or All, with each initiative or All."""
    choice = [
        F.struct(
            promo.alias("promo_choice"), initiative.alias("initiative_choice"), F.lit(wildcard).alias("any_initiative"))
        for promo in (F.col("Promo_Segment"), F.lit(ALL))
        for initiative, wildcard in ((F.col("Initiative"), False), (F.lit(ALL), True))
    ]
    return rows.withColumn("_choice", F.explode(F.array(*choice))).select("*", "_choice.*").drop("_choice")
