"""Looking at an input table before using it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgauge.params import ALL, named


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, non-null and null count, from one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(named(c)).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows"),
            named(f.name).alias("non_null"),
            (F.col("rows") - named(f.name)).alias("nulls"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*entries)))


def stable_sample(df: DataFrame, key: list[str], n: int = 5, seed: int = 45) -> DataFrame:
    """`n` rows picked by a hash of their key: the same rows at every run and partitioning."""
    text = F.concat_ws("|", *[named(k).cast("string") for k in key], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *[named(k) for k in key]).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, most frequent first; nulls are left out."""
    return (
        df.where(named(column).isNotNull())
        .groupBy(named(column).alias(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), named(column))
    )


def choices(df: DataFrame, column: str) -> DataFrame:
    """The values a cohort choice may take, with the wildcard in front."""
    values = df.where(named(column).isNotNull()).select(named(column).alias("choice")).distinct()
    wildcard = df.sparkSession.createDataFrame([(ALL,)], "choice string")
    return wildcard.select(F.lit(0).alias("position"), "choice").unionByName(
        values.select(F.lit(1).alias("position"), "choice")
    )


def date_bounds(df: DataFrame, column: str = "Transaction_Date") -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
