"""Writing result and fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgauge.params import FACTS_MONTH


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a result table as parquet; an existing table is never replaced unasked."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_initiatives_bucketed(initiatives: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Keep the initiatives bucketed by customer; with as many buckets as the facts have, neither is moved to be joined."""
    (
        initiatives.repartition(buckets, "CustomerID")
        .write.bucketBy(buckets, "CustomerID")
        .sortBy("CustomerID")
        .option("path", path)
        .saveAsTable(table)
    )
    return initiatives.sparkSession.table(table)


def save_daily_bucketed(daily: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Keep the customer-day facts partitioned by month and bucketed by customer.

    Labels, customer features and recency all work per customer, so each later analysis of the
    table (`Campaign.from_daily`) reads the months of its span only and starts without moving the facts again.
    """
    (
        daily.withColumn(FACTS_MONTH, F.trunc("Transaction_Date", "MM"))
        .repartition(buckets, "CustomerID")
        .write.partitionBy(FACTS_MONTH)
        .bucketBy(buckets, "CustomerID")
        .sortBy("CustomerID")
        .option("path", path)
        .saveAsTable(table)
    )
    return daily.sparkSession.table(table)
