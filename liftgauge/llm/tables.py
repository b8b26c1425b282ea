"""Reading the given tables, and a numbering that needs no task to see all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftgauge.session import written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def laid_out(df: DataFrame, order: list, label: str) -> DataFrame:
    """Write `df` in global order; `part` and `at` say where each row stands.

    The written table fixes the order of ties, so that a task run again cannot number them anew.
    """
    place = F.monotonically_increasing_id()
    return written(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}),
        label,
    )


def numbered(df: DataFrame, order: list, out: str, label: str, within: list[str] = ()) -> DataFrame:
    """Number the rows from 0 in `order`, anew for each value of `within` (which must lead `order`).

    Only one row for each partition and group is numbered by a window; the rows themselves are never
    gathered, so one group may hold any share of them.
    """
    rows = laid_out(df, order, label)
    keys = list(within)
    runs = rows.groupBy(*keys, "part").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*keys, "part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        rows.join(starts, [*keys, "part"])
        .withColumn(out, F.col("_before") + F.col("at") - F.col("_first"))
        .drop("part", "at", "_first", "_before")
    )
