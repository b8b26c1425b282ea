"""Reading sales lines and initiatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The input columns and the date format of the text files.
SALES_CSV = T.StructType([
    T.StructField("CustomerID", T.LongType()),
    T.StructField("Transaction_ID", T.StringType()),
    T.StructField("Transaction_Date", T.StringType()),
    T.StructField("Product_Category", T.StringType()),
    T.StructField("Quantity", T.DoubleType()),
    T.StructField("Avg_Price", T.DoubleType()),
    T.StructField("Coupon_Status", T.StringType()),
])
INITIATIVES_CSV = T.StructType([
    T.StructField("CustomerID", T.LongType()),
    T.StructField("Initiative", T.StringType()),
])
CSV_DATE = "M/d/yyyy"

# The columns of the order tables that stand in for sales lines.
ORDER_TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
    "part": "p_partkey long, p_type string",
    "customer": "c_custkey long, c_mktsegment string",
}


def _strict(name: str, parsed: Column) -> Column:
    """`parsed`, where a text that is there but does not parse fails the job."""
    text = F.col(name)
    refused = F.raise_error(F.concat(F.lit(f"{name} does not parse: "), text))
    return F.coalesce(parsed, F.when(text.isNotNull(), refused)).alias(name)


def _csv_by_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns as text, found by their names in the header; further columns are not read.

    All files of a folder must have the same header; one that differs fails the job.
    """
    lines = spark.read.options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    absent = [name for name in schema.fieldNames() if name not in lines.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}; its header is {', '.join(lines.columns)}")
    return lines.select(*schema.fieldNames())


def _typed(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    return _strict(field.name, F.col(field.name).try_cast(field.dataType))


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sales lines from CSV, columns by header name; a number or date that does not parse fails the job."""
    lines = _csv_by_header(spark, path, SALES_CSV)
    day = _strict("Transaction_Date", F.try_to_date("Transaction_Date", CSV_DATE))
    return lines.select(*(day if f.name == "Transaction_Date" else _typed(f) for f in SALES_CSV))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of every line of text files, numbered from 1 within each file.

    Files are read in blocks, each in order by one task; the lines of the blocks before are added up from a row a block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("text"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return lines.join(starts, ["file", "_block"]).select("file", (F.col("_at") + F.col("_shift")).alias("line"), "text")


def split_sales_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, refused): the lines that `read_sales_csv` would take, and file, line, reason and text of the others.

    The header names the columns and is line 1 of each file; files whose header is another one are refused whole, as are
    lines with more or fewer columns or with open quotes, and those with a number or date that does not parse. Empty lines
    are neither. A line of text is one line of the table, as in `read_sales_csv`.
    """
    header = spark.read.options(header=True).csv(path).columns
    absent = [name for name in SALES_CSV.fieldNames() if name not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}; its header is {', '.join(header)}")
    places = [f"_{n}" for n in range(len(header))]
    form = ", ".join(f"{p} string" for p in places)
    malformed = "_malformed"
    cut = F.from_csv("text", f"{form}, {malformed} string", {"columnNameOfCorruptRecord": malformed})
    lines = _numbered_lines(spark, path).where(F.trim("text") != "").withColumn("_cut", cut)
    named = {name: F.col(f"_cut.{places[header.index(name)]}") for name in SALES_CSV.fieldNames()}
    is_header = reduce(
        Column.__and__, [F.col(f"_cut.{p}").eqNullSafe(F.lit(name)) for p, name in zip(places, header, strict=True)])
    other_files = lines.where((F.col("line") == 1) & ~is_header).select("file", F.lit(True).alias("_other")).distinct()
    typed, reasons = {}, [F.when(F.col("_other"), F.lit("another header")),
                          F.when(F.col(f"_cut.{malformed}").isNotNull(), F.lit("another number of columns"))]
    for field in SALES_CSV:
        text = named[field.name]
        if field.name == "Transaction_Date":
            typed[field.name] = F.try_to_date(text, CSV_DATE)
        elif isinstance(field.dataType, T.StringType):
            typed[field.name] = text
        else:
            typed[field.name] = text.try_cast(field.dataType)
        reasons.append(F.when(text.isNotNull() & typed[field.name].isNull(), F.lit(f"{field.name} does not parse")))
    judged = (
        lines.where((F.col("line") > 1) | ~is_header).join(other_files, "file", "left")
        .withColumn("reason", F.coalesce(*reasons)))
    good = judged.where(F.col("reason").isNull()).select(*[value.alias(name) for name, value in typed.items()])
    return good, judged.where(F.col("reason").isNotNull()).select("file", "line", "reason", "text")


def read_initiatives_csv(spark: SparkSession, path: str) -> DataFrame:
    """Initiatives from CSV, columns by header name."""
    return _csv_by_header(spark, path, INITIATIVES_CSV).select(*map(_typed, INITIATIVES_CSV))


def read_sales_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Sales lines from parquet, where Transaction_Date already is a date."""
    return spark.read.parquet(path).select(*SALES_CSV.fieldNames())


def rejected_dates(lines: DataFrame) -> DataFrame:
    """How many date texts `read_sales_csv` would refuse; Transaction_Date is still text here."""
    text = F.col("Transaction_Date")
    bad = text.isNotNull() & F.try_to_date(text, CSV_DATE).isNull()
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(text).alias("dated"),
        F.count_if(bad).alias("rejected"),
    )


def order_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the order tables; with its columns given, no file has to be opened to plan a query."""
    return spark.read.schema(ORDER_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def sales_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Sales lines out of lineitem, orders and part; Transaction_ID stays the numeric order key.

    The orders come first, as a bound on the days then thins out the lines before they meet the parts.
    """
    lines, orders, parts = (order_table(spark, folder, name) for name in ("lineitem", "orders", "part"))
    return (
        lines
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("CustomerID"),
            F.col("o_orderkey").alias("Transaction_ID"),
            F.col("o_orderdate").cast("date").alias("Transaction_Date"),
            F.col("p_type").alias("Product_Category"),
            F.col("l_quantity").alias("Quantity"),
            F.try_divide("l_extendedprice", "l_quantity").alias("Avg_Price"),
            F.when(F.col("l_discount") >= 0.09, "Used").otherwise("Not Used").alias("Coupon_Status"),
        )
    )


def initiatives_from_customers(spark: SparkSession, folder: str) -> DataFrame:
    return (
        order_table(spark, folder, "customer")
        .where(F.col("c_mktsegment") == "BUILDING")
        .select(F.col("c_custkey").alias("CustomerID"), F.lit("BuyOneGetOne").alias("Initiative"))
    )
