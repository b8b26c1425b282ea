"""The registered queries: each reads the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgauge.catalog import oracle as sql
from liftgauge.catalog.setting import ARMS, METRICS, PERIODS, WILDCARD_ARMS
from liftgauge.catalog.shapes import Shape, shown, shown_sql
from liftgauge.functions.exact import exact_sum
from liftgauge.functions.student_t import with_two_sided_p
from liftgauge.operators.cohorts import ARM_KEYS, assign_arms, in_cohort
from liftgauge.operators.compare import day_sums, real_result
from liftgauge.operators.customers import DELTA_METRICS, active_span
from liftgauge.operators.days import calendar_recency, customer_calendar
from liftgauge.operators.facts import enrich, sales_by, transaction_pivot
from liftgauge.operators.labels import promo_pivot, with_initiative, with_period, with_promo_segment
from liftgauge.operators.reports import formatted, shares, validation
from liftgauge.operators.significance import cells, customer_comparison, day_comparison, moments
from liftgauge.operators.synthetic import bootstrap, proportions, trailing_means
from liftgauge.params import POST, Cohort
from liftgauge.plans.campaign import Campaign
from liftgauge.session import scratch_path
from liftgauge.sources import profile
from liftgauge.sources.fact_store import FactStore
from liftgauge.sources.sales import (
    CSV_DATE,
    SALES_CSV,
    initiatives_from_customers,
    order_table,
    read_initiatives_csv,
    read_sales_csv,
    read_sales_parquet,
    rejected_dates,
    sales_from_orders,
    split_sales_csv,
)
from liftgauge.sources.sinks import save_daily_bucketed, save_table

M = METRICS.all
RESULT: Shape = {"metric_order": "i", "Metrics": "s", "Pre": 4, "Post": 4, "Var": 4, "Var%": "s", "Sign": "s"}
ARM_RESULT: Shape = {"arm": "s", **RESULT}
TEST_TABLE: Shape = {
    "arm": "s", "Metrics": "s", "Pre": 4, "Post": 4, "Var": 4, "Var%": "s", "t_stat": 5, "df": "i", "p_value": 7,
    "Sign": "s",
}
SHARES: Shape = {"metric_order": "i", "Metrics": "s", "Pre": 2, "Post": 2}
FORMATTED: Shape = {
    "metric_order": "i", "Metrics": "s", "Pre": "s", "Post": "s", "Var": "s", "Var%": "s", "Sign": "s", "Var2": 4,
    "direction": "s",
}
PLAYER: Shape = {
    "Period": "s", "CustomerID": "i", "Promo_Segment": "s", "Initiative": "s", **{m: 6 for m in M},
    "Frequency%": 9, "Recency": "i",
}
DAY: Shape = {
    "arm": "s", "Period": "s", "Transaction_Date": "d", **{m: 6 for m in M}, "ActiveCustomer": "i",
    "ActiveCustomer%": 9, **{f"{m}_day": 4 for m in METRICS.day_totals}, "Recency": 6,
}


class Tables:
    """The inputs of a query and the analysis built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def sales(self) -> DataFrame:
        return sales_from_orders(self.spark, self.folder)

    @cached_property
    def initiatives(self) -> DataFrame:
        return initiatives_from_customers(self.spark, self.folder)

    def campaign(self, periods: str = "main", keep: bool = True, arms=ARMS) -> Campaign:
        """`keep=False` suits a query that reads the labelled facts only once."""
        return Campaign(self.sales, self.initiatives, PERIODS[periods], arms, METRICS, keep)

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)


@dataclass(frozen=True)
class Query:
    shape: Shape
    run: Callable[[Tables], DataFrame]
    check: str | None

    def on_spark(self, spark: SparkSession, folder: str) -> DataFrame:
        return shown(self.run(Tables(spark, folder)), self.shape)

    @property
    def check_sql(self) -> str | None:
        return None if self.check is None else shown_sql(sql.spelled_out(self.check), self.shape)


QUERIES: dict[str, Query] = {}


def query(name: str, shape: Shape, check: str | None):
    def register(run):
        QUERIES[name] = Query(shape, run, check)
        return run

    return register


MAIN = PERIODS["main"]
LABELS = sql.labels(MAIN)
FEATURES = sql.features(MAIN)
ARMS_SQL = sql.arms()
DAYS = sql.days(MAIN)


def facts_sql(select: str) -> str:
    return sql.with_ctes(sql.FACTS, select=select)


def labels_sql(select: str) -> str:
    return sql.with_ctes(sql.FACTS, LABELS, select=select)


def players_sql(*parts: str, select: str, periods=MAIN, arms: str = ARMS_SQL) -> str:
    return sql.with_ctes(
        sql.FACTS, sql.labels(periods), sql.features(periods), arms, sql.ARMED_PLAYERS, *parts, select=select
    )


def days_sql(*parts: str, select: str, periods=MAIN, arms: str = ARMS_SQL) -> str:
    return sql.with_ctes(sql.FACTS, sql.labels(periods), arms, sql.days(periods), *parts, select=select)


def result_sql(*parts: str, select: str, periods=MAIN, arms: str = ARMS_SQL) -> str:
    return sql.with_ctes(
        sql.FACTS, sql.labels(periods), sql.features(periods), arms, sql.ARMED_PLAYERS, sql.days(periods),
        sql.customer_tests(), sql.day_tests(), sql.result(), *parts, select=select,
    )


# --- reading and profiling -------------------------------------------------------------------------


@query("initiatives_csv_scan", {"CustomerID": "i", "Initiative": "s"},
       sql.with_ctes(sql.INITIATIVES, select="SELECT * FROM inits"))
def initiatives_csv_scan(t: Tables) -> DataFrame:
    path = t.scratch("initiatives-csv")
    t.initiatives.write.option("header", True).csv(path)
    return read_initiatives_csv(t.spark, path)


SALES_LINES: Shape = {
    "CustomerID": "i", "Transaction_ID": "s", "Transaction_Date": "d", "Product_Category": "s", "Quantity": 2,
    "Avg_Price": 6, "Coupon_Status": "s",
}


@query("sales_csv_scan", SALES_LINES, sql.with_ctes(sql.SALES, select="SELECT * FROM sales"))
def sales_csv_scan(t: Tables) -> DataFrame:
    """Every line through a file whose columns stand in another order, with one more among them."""
    path = t.scratch("sales-csv")
    as_text = t.sales.withColumns({
        "Transaction_Date": F.date_format("Transaction_Date", CSV_DATE), "Product_SKU": F.lit("none")})
    as_text.select(
        "Avg_Price", "Product_SKU", "Quantity", "Coupon_Status", "Transaction_Date", "CustomerID", "Product_Category",
        "Transaction_ID",
    ).write.option("header", True).csv(path)
    return read_sales_csv(t.spark, path)


@query("sales_parquet_scan", SALES_LINES, sql.with_ctes(sql.SALES, select="SELECT * FROM sales"))
def sales_parquet_scan(t: Tables) -> DataFrame:
    path = t.scratch("sales-parquet")
    save_table(t.sales.withColumn("Product_SKU", F.lit("none")), path)
    return read_sales_parquet(t.spark, path)


@query("date_rejects", {"lines": "i", "dated": "i", "rejected": "i"}, """
SELECT count(*) AS lines, count(d) AS dated,
       count(*) FILTER (WHERE d IS NOT NULL AND try_strptime(d, '%m/%d/%Y') IS NULL) AS rejected
FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d')
                  ELSE strftime(o_orderdate, '%m/%d/%Y') END AS d FROM orders)""")
def date_rejects(t: Tables) -> DataFrame:
    # Orders in progress carry the date in another format here.
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderstatus") == "P", F.date_format(day, "yyyy-MM-dd")).otherwise(
        F.date_format(day, "MM/dd/yyyy")
    )
    return rejected_dates(order_table(t.spark, t.folder, "orders").select(text.alias("Transaction_Date")))


# Lines of the next two queries: each order, some with a date, a number or a column that is not as it should be.
ORDER_LINES = """SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 3 THEN 'another number of columns'
         WHEN o_custkey % 37 = 5 THEN 'CustomerID does not parse' WHEN o_orderstatus = 'P' THEN 'Transaction_Date does not parse'
         WHEN o_orderkey % 29 = 7 THEN 'Quantity does not parse' END AS reason, o_custkey, o_orderdate FROM orders"""


def _faulty_csv(t: Tables) -> str:
    path = t.scratch("faulty-csv")
    order, key = order_table(t.spark, t.folder, "orders"), F.col("o_orderkey")
    fields = [
        F.when(F.col("o_custkey") % 37 == 5, F.concat(F.lit("c"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")),
        key.cast("string"),
        F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
            F.date_format("o_orderdate", "MM/dd/yyyy")),
        F.lit('"Mugs, large"'),
        F.when(key % 29 == 7, F.lit("two")).otherwise(F.lit("2")),
        F.lit("1.5"),
        F.when(key % 41 == 3, F.lit("Used,more")).otherwise(F.lit("Used")),
    ]
    # Whole lines as the one column of a file whose own separator and quote do not occur, under the header.
    lines = order.select(F.concat_ws(",", *fields).alias(",".join(SALES_CSV.fieldNames())))
    lines.write.options(header=True, sep="\u0001", quote="\u0002").csv(path)
    return path


@query("sales_csv_refused", {"Transaction_ID": "i", "reason": "s"},
       f"SELECT o_orderkey AS Transaction_ID, reason FROM ({ORDER_LINES}) WHERE reason IS NOT NULL")
def sales_csv_refused(t: Tables) -> DataFrame:
    _, refused = split_sales_csv(t.spark, _faulty_csv(t))
    return refused.select(F.split("text", ",")[1].alias("Transaction_ID"), "reason")


@query("sales_csv_accepted", SALES_LINES,
       f"""SELECT o_custkey AS CustomerID, o_orderkey AS Transaction_ID, o_orderdate AS Transaction_Date,
  'Mugs, large' AS Product_Category, 2 AS Quantity, 1.5 AS Avg_Price, 'Used' AS Coupon_Status
FROM ({ORDER_LINES}) WHERE reason IS NULL""")
def sales_csv_accepted(t: Tables) -> DataFrame:
    good, _ = split_sales_csv(t.spark, _faulty_csv(t))
    return good


SALES_TYPES = {
    "CustomerID": "bigint", "Transaction_ID": "bigint", "Transaction_Date": "date", "Product_Category": "string",
    "Quantity": "double", "Avg_Price": "double", "Coupon_Status": "string",
}


@query("sales_profile", {"column": "s", "type": "s", "rows": "i", "non_null": "i"},
       sql.with_ctes(sql.SALES, select=" UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS \"rows\", count({c}) AS non_null FROM sales"
           for c, kind in SALES_TYPES.items())))
def sales_profile(t: Tables) -> DataFrame:
    return profile.column_profile(t.sales)


@query("labelled_nulls", {"column": "s", "nulls": "i"},
       sql.with_ctes(sql.FACTS, select=" UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls "
           "FROM daily LEFT JOIN inits USING (CustomerID)"
           for c in ("CustomerID", "Transaction_Date", "Sales_All", "Price_All", "Initiative"))))
def labelled_nulls(t: Tables) -> DataFrame:
    joined = t.campaign().daily.join(t.initiatives, "CustomerID", "left")
    return profile.column_profile(
        joined.select("CustomerID", "Transaction_Date", "Sales_All", "Price_All", "Initiative")
    )


@query("sales_sample", {"CustomerID": "i", "Transaction_ID": "i", "Transaction_Date": "d", "Sales_All": 4},
       facts_sql("""SELECT * FROM pivoted
ORDER BY md5(CustomerID::VARCHAR || '|' || Transaction_ID::VARCHAR || '|45'), CustomerID, Transaction_ID LIMIT 5"""))
def sales_sample(t: Tables) -> DataFrame:
    pivot = transaction_pivot(enrich(t.sales, METRICS), METRICS)
    return profile.stable_sample(pivot, ["CustomerID", "Transaction_ID"])


@query("category_counts", {"Product_Category": "s", "n": "i"},
       sql.with_ctes(sql.SALES, select="SELECT Product_Category, count(*) AS n FROM sales GROUP BY ALL"))
def category_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.sales, "Product_Category")


@query("initiative_choices", {"position": "i", "choice": "s"}, labels_sql("""
SELECT 0 AS position, 'All' AS choice UNION ALL SELECT DISTINCT 1, Initiative FROM labelled"""))
def initiative_choices(t: Tables) -> DataFrame:
    buyers = t.sales.select("CustomerID").distinct()
    return profile.choices(with_initiative(buyers, t.initiatives), "Initiative")


@query("date_bounds", {"first_date": "d", "last_date": "d"}, sql.with_ctes(sql.SALES, select="""
SELECT min(Transaction_Date) AS first_date, max(Transaction_Date) AS last_date FROM sales"""))
def date_bounds(t: Tables) -> DataFrame:
    return profile.date_bounds(t.sales)


NUMERIC_DAY = [*M, "ActiveCustomer", "ActiveCustomer%", *(f"{m}_day" for m in METRICS.day_totals), "Recency"]


@query("numeric_columns", {"column": "s", "non_null": "i"},
       days_sql(select=" UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", count({sql.q(c)}) AS non_null FROM days WHERE Period = 'Post' AND arm = 'test'"
           for c in NUMERIC_DAY)))
def numeric_columns(t: Tables) -> DataFrame:
    days = t.campaign(keep=False).days.where("Period = 'Post' AND arm = 'test'")
    return profile.column_profile(days.select(*map(sql_name, profile.numeric_columns(days))))


def sql_name(name: str):
    return F.col(f"`{name}`")


@query("result_table_sink", ARM_RESULT, result_sql(select="SELECT * FROM result"))
def result_table_sink(t: Tables) -> DataFrame:
    path = t.scratch("result")
    save_table(t.campaign().result, path, partition_by=["arm"])
    return t.spark.read.parquet(path)


# --- facts -----------------------------------------------------------------------------------------


@query("sales_line_features",
       {"CustomerID": "i", "Transaction_ID": "i", "Transaction_Date": "d", "Product_Category": "s", "Sales": 4,
        "Year": "i", "Month": "i", "Coupons": "i", "Product_Category_Grouped": "s"},
       sql.with_ctes(sql.SALES, sql.enriched(), select="SELECT * FROM enriched"))
def sales_line_features(t: Tables) -> DataFrame:
    return enrich(t.sales, METRICS)


CELLS = [f"{m}_{b}" for b in METRICS.buckets for m in ("Quantity", "Avg_Price", "Sales", "Coupons")]


@query("transaction_pivot",
       {"CustomerID": "i", "Transaction_ID": "i", "Transaction_Date": "d", "Month": "i", "Year": "i",
        **{c: 6 for c in CELLS}, "Quantity_All": 4, "Sales_All": 4, "Coupons_All": 4, "Price_All": 6},
       facts_sql("SELECT * FROM pivoted"))
def transaction_pivot_query(t: Tables) -> DataFrame:
    return transaction_pivot(enrich(t.sales, METRICS), METRICS)


@query("customer_day_facts",
       {"CustomerID": "i", "Transaction_Date": "d", "Month": "i", "Year": "i", **{m: 6 for m in M}},
       facts_sql("SELECT * FROM daily"))
def customer_day_facts(t: Tables) -> DataFrame:
    return t.campaign().daily


@query("sales_by_year", {"Year": "i", "Sales_All": 2},
       facts_sql("SELECT Year, fsum(Sales_All) AS Sales_All FROM daily GROUP BY ALL"))
def sales_by_year(t: Tables) -> DataFrame:
    return sales_by(t.campaign().daily, "Year")


@query("sales_by_month", {"Month": "i", "Sales_All": 2},
       facts_sql("SELECT Month, fsum(Sales_All) AS Sales_All FROM daily GROUP BY ALL"))
def sales_by_month(t: Tables) -> DataFrame:
    return sales_by(t.campaign().daily, "Month")


@query("sales_by_day", {"Transaction_Date": "d", "Month": "i", "Sales_All": 4},
       facts_sql("SELECT Transaction_Date, Month, fsum(Sales_All) AS Sales_All FROM daily GROUP BY ALL"))
def sales_by_day(t: Tables) -> DataFrame:
    return sales_by(t.campaign().daily, "Transaction_Date", "Month")


# --- labels and cohorts ----------------------------------------------------------------------------


def _dated(t: Tables, periods: str = "main") -> DataFrame:
    return with_period(t.campaign().daily, PERIODS[periods])


@query("period_labels", {"CustomerID": "i", "Transaction_Date": "d", "Period": "s"},
       labels_sql("SELECT * FROM dated"))
def period_labels(t: Tables) -> DataFrame:
    return _dated(t)


@query("active_span_days", {"CustomerID": "i", "Period": "s", "span_days": "i"}, labels_sql("""
SELECT CustomerID, Period, date_diff('day', min(Transaction_Date), max(Transaction_Date)) + 1 AS span_days
FROM dated GROUP BY ALL"""))
def active_span_days(t: Tables) -> DataFrame:
    return active_span(_dated(t), "CustomerID", "Period")


@query("promo_pivot", {"CustomerID": "i", "Out_Coupons_All": 2, "Post_Coupons_All": 2, "Pre_Coupons_All": 2},
       labels_sql("SELECT * FROM coupon_use"))
def promo_pivot_query(t: Tables) -> DataFrame:
    return promo_pivot(_dated(t))


@query("promo_segments", {"CustomerID": "i", "Promo_Segment": "s"}, labels_sql("SELECT * FROM segments"))
def promo_segments(t: Tables) -> DataFrame:
    return with_promo_segment(_dated(t)).groupBy("CustomerID").agg(F.first("Promo_Segment").alias("Promo_Segment"))


@query("segment_members", {"Promo_Segment": "s", "customers": "i"},
       labels_sql("SELECT Promo_Segment, count(*) AS customers FROM segments GROUP BY ALL"))
def segment_members(t: Tables) -> DataFrame:
    return promo_segments(t).groupBy("Promo_Segment").agg(F.count(F.lit(1)).alias("customers"))


@query("labelled_facts",
       {"CustomerID": "i", "Transaction_Date": "d", "Period": "s", "Promo_Segment": "s", "Initiative": "s",
        "Transactions": "i", "Sales_All": 4, "Coupons_All": 2},
       labels_sql("SELECT * FROM labelled"))
def labelled_facts(t: Tables) -> DataFrame:
    return t.campaign().labelled


@query("cohort_filter",
       {"CustomerID": "i", "Transaction_Date": "d", "Period": "s", "Sales_All": 4},
       labels_sql("""SELECT * FROM labelled WHERE Promo_Segment = 'Promo' AND Initiative = 'BuyOneGetOne'
AND Period IN ('Pre', 'Post')"""))
def cohort_filter(t: Tables) -> DataFrame:
    return in_cohort(t.campaign().labelled, Cohort("Promo", "BuyOneGetOne")).where("Period IN ('Pre', 'Post')")


@query("cohort_wildcards", {"arm": "s", "Period": "s", "customer_days": "i", "Sales_All": 2},
       sql.with_ctes(sql.FACTS, LABELS, sql.arms(WILDCARD_ARMS), select=f"""
SELECT arm, Period, count(*) AS customer_days, fsum(Sales_All) AS Sales_All
FROM labelled t JOIN arms ON {sql.IN_ARM} GROUP BY ALL"""))
def cohort_wildcards(t: Tables) -> DataFrame:
    return assign_arms(t.campaign().labelled, WILDCARD_ARMS).groupBy("arm", "Period").agg(
        F.count(F.lit(1)).alias("customer_days"), F.expr(exact_sum("Sales_All")).alias("Sales_All")
    )


@query("validation_table",
       {"Promo_Segment": "s", "Period": "s", "Transactions_mean": 5, "Quantity_All_mean": 4, "Sales_All_mean": 4,
        "Transactions_sum": "i", "Quantity_All_sum": 2, "Sales_All_sum": 2},
       labels_sql("""SELECT Promo_Segment, Period, avg(Transactions) AS Transactions_mean,
favg(Quantity_All) AS Quantity_All_mean, favg(Sales_All) AS Sales_All_mean, sum(Transactions) AS Transactions_sum,
fsum(Quantity_All) AS Quantity_All_sum, fsum(Sales_All) AS Sales_All_sum FROM labelled GROUP BY ALL"""))
def validation_table(t: Tables) -> DataFrame:
    return validation(t.campaign().labelled)


# --- features, for each of the period sets ---------------------------------------------------------


def _register_features(name: str) -> None:
    periods = PERIODS[name]

    @query(f"customer_features_{name}", PLAYER,
           sql.with_ctes(sql.FACTS, sql.labels(periods), sql.features(periods), select="SELECT * FROM players"))
    def customers(t: Tables) -> DataFrame:
        return t.campaign(name, keep=False).customers

    @query(f"day_features_{name}", DAY, days_sql(select="SELECT * FROM days", periods=periods))
    def days(t: Tables) -> DataFrame:
        return t.campaign(name, keep=False).days

    @query(f"day_recency_calendar_{name}", {"Period": "s", "Transaction_Date": "d", "Recency": 6},
           sql.with_ctes(sql.FACTS, sql.labels(periods), sql.calendar("labelled", [], periods), select="""
SELECT Period, Transaction_Date, avg(-date_diff('day', last_seen, Transaction_Date)) AS Recency
FROM calendar GROUP BY ALL"""))
    def recency(t: Tables) -> DataFrame:
        return calendar_recency(customer_calendar(t.campaign(name, keep=False).marked, periods, []), [])

    @query(f"combined_result_{name}", ARM_RESULT, result_sql(select="SELECT * FROM result", periods=periods))
    def result(t: Tables) -> DataFrame:
        return t.campaign(name).result


for _name in PERIODS:
    _register_features(_name)


def _from_stored(t: Tables) -> Campaign:
    """An analysis of facts that are stored first; nothing after that goes back to the lines."""
    kept = save_daily_bucketed(
        t.campaign(keep=False).daily, f"daily_{uuid.uuid4().hex}", t.scratch("stored-daily"), buckets=8)
    return Campaign.from_daily(kept, t.initiatives, MAIN, ARMS, METRICS)


@query("refreshed_facts",
       {"CustomerID": "i", "Transaction_Date": "d", "Month": "i", "Year": "i", **{m: 6 for m in M}},
       facts_sql("SELECT * FROM daily"))
def refreshed_facts(t: Tables) -> DataFrame:
    """Facts of a first delivery with faults, then late lines of old and new days, then corrections of transactions."""
    key = F.col("Transaction_ID")
    late, faulty = key % 7 == 3, key % 11 == 5
    lines = t.sales
    wrong = F.when(F.col("Product_Category") == "PROMO", F.date_add("Transaction_Date", 40)).otherwise(F.col("Transaction_Date"))
    store = FactStore(t.spark, t.scratch("fact-store"), METRICS, buckets=1)
    store.refresh(
        lines.where(~late).withColumns({
            "Quantity": F.when(faulty, F.col("Quantity") * 3).otherwise(F.col("Quantity")),
            "Transaction_Date": F.when(faulty, wrong).otherwise(F.col("Transaction_Date")),
        }), "first")
    store.refresh(lines.where(late & ~faulty), "late")
    store.refresh(lines.where(faulty), "corrections", corrects=True)
    return store.daily()


@query("stored_result_main", ARM_RESULT, result_sql(select="SELECT * FROM result"))
def stored_result_main(t: Tables) -> DataFrame:
    return _from_stored(t).result


@query("stored_result_other_arms", ARM_RESULT,
       result_sql(select="SELECT * FROM result", arms=sql.arms(WILDCARD_ARMS)))
def stored_result_other_arms(t: Tables) -> DataFrame:
    return _from_stored(t).with_arms(WILDCARD_ARMS).result


@query("stored_result_post_long", ARM_RESULT,
       result_sql(select="SELECT * FROM result", periods=PERIODS["post_long"]))
def stored_result_post_long(t: Tables) -> DataFrame:
    return _from_stored(t).with_periods(PERIODS["post_long"]).result


@query("day_features_wildcards", DAY,
       days_sql(select="SELECT * FROM days", arms=sql.arms(WILDCARD_ARMS)))
def day_features_wildcards(t: Tables) -> DataFrame:
    return t.campaign(keep=False, arms=WILDCARD_ARMS).days


@query("customer_calendar",
       {"Period": "s", "CustomerID": "i", "calendar_days": "i", "days_since_seen": "i", "last_seen": "d"},
       sql.with_ctes(sql.FACTS, LABELS, sql.calendar("labelled", [], MAIN), select="""
SELECT Period, CustomerID, count(*) AS calendar_days,
       sum(date_diff('day', last_seen, Transaction_Date)) AS days_since_seen, max(last_seen) AS last_seen
FROM calendar GROUP BY ALL"""))
def customer_calendar_query(t: Tables) -> DataFrame:
    calendar = customer_calendar(t.campaign(keep=False).marked, MAIN, [])
    return calendar.groupBy("Period", "CustomerID").agg(
        F.count(F.lit(1)).alias("calendar_days"),
        F.sum(F.datediff("Transaction_Date", "last_seen")).alias("days_since_seen"),
        F.max("last_seen").alias("last_seen"),
    )


# --- weighted means and tests ----------------------------------------------------------------------


LONG_VALUES: Shape = {"arm": "s", "Period": "s", "Metrics": "s", "value": 4}


def _values_sql(source: str, how) -> str:
    w = sql.q(how.weight)
    parts = []
    for m in how.order:
        if m in how.totals:
            value = f"fsum({how.totals[m].replace('`', chr(34))})"
        elif m in how.plain:
            value = f"favg({sql.q(m)})"
        else:
            value = f"fsum({sql.q(m)} * {w}) / fsum({w})"
        parts.append(f"SELECT arm, Period, '{m}' AS Metrics, {value} AS value FROM {source} GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("customer_weighted_means", LONG_VALUES,
       players_sql(select=_values_sql("armed_players", customer_comparison(METRICS))))
def customer_weighted_means(t: Tables) -> DataFrame:
    return moments(assign_arms(t.campaign(keep=False).customer_cells, ARMS), ARM_KEYS, customer_comparison(METRICS))


@query("day_weighted_means", LONG_VALUES, days_sql(select=_values_sql("days", day_comparison(METRICS))))
def day_weighted_means(t: Tables) -> DataFrame:
    how = day_comparison(METRICS)
    return moments(cells(t.campaign(keep=False).days, ARM_KEYS, how), ARM_KEYS, how)


@query("customer_tests", TEST_TABLE, players_sql(sql.customer_tests(), select="SELECT * FROM customer_tests"))
def customer_tests_query(t: Tables) -> DataFrame:
    return t.campaign(keep=False).customer_tests


@query("day_tests", TEST_TABLE, days_sql(sql.day_tests(), select="SELECT * FROM day_tests"))
def day_tests_query(t: Tables) -> DataFrame:
    return t.campaign(keep=False).day_tests


@query("day_tests_post_long", TEST_TABLE,
       days_sql(sql.day_tests(), select="SELECT * FROM day_tests", periods=PERIODS["post_long"]))
def day_tests_post_long(t: Tables) -> DataFrame:
    return t.campaign("post_long", keep=False).day_tests


CHOICE = "split_part(arm, '/', 1) AS promo_choice, split_part(arm, '/', 2) AS initiative_choice, *"
CHOICE_SHAPE: Shape = {"promo_choice": "s", "initiative_choice": "s"}


@query("customer_test_grid", {**CHOICE_SHAPE, **{k: v for k, v in TEST_TABLE.items() if k != "arm"}},
       players_sql(sql.customer_tests(), select=f"SELECT {CHOICE} FROM customer_tests", arms=sql.grid_arms()))
def customer_test_grid(t: Tables) -> DataFrame:
    return t.campaign(keep=False).customer_grid


@query("cohort_grid", {**CHOICE_SHAPE, **RESULT},
       result_sql(select=f"SELECT {CHOICE} FROM result", arms=sql.grid_arms()))
def cohort_grid(t: Tables) -> DataFrame:
    return t.campaign().grid


# The tail of the t distribution for the customers' deviation from the mean of their day.
@query("student_t_tail", {"Transaction_Date": "d", "df": "i", "t_stat": 6, "p_value": 7},
       facts_sql(f"""SELECT *, {sql.series('df', 't_stat')} AS p_value FROM (
  SELECT Transaction_Date, count(*) - 1 AS df,
         (avg(Sales_All) - 200000) / nullif(stddev_samp(Sales_All) / sqrt(count(*)), 0) AS t_stat
  FROM daily GROUP BY ALL)"""))
def student_t_tail(t: Tables) -> DataFrame:
    spread = F.stddev_samp("Sales_All") / F.sqrt(F.count("Sales_All"))
    per_day = t.campaign().daily.groupBy("Transaction_Date").agg(
        (F.count("Sales_All") - 1).alias("df"),
        F.try_divide(F.avg("Sales_All") - 200000, spread).alias("t_stat"),
    )
    return with_two_sided_p(per_day, "t_stat", "df")


# --- reports ---------------------------------------------------------------------------------------


@query("formatted_result", {"arm": "s", **FORMATTED}, result_sql(sql.formatted(), select="SELECT * FROM formatted"))
def formatted_result(t: Tables) -> DataFrame:
    return t.campaign().formatted


@query("result_shares", {"arm": "s", **SHARES}, result_sql(sql.shares(), select="SELECT * FROM shares"))
def result_shares(t: Tables) -> DataFrame:
    return t.campaign().shares


@query("share_range", {"arm": "s", "min_value": 2, "max_value": 2}, result_sql(sql.shares(), select="""
SELECT arm, 0 AS min_value, max(greatest(Pre, Post)) AS max_value FROM shares GROUP BY ALL"""))
def share_range_query(t: Tables) -> DataFrame:
    return t.campaign().share_range


DELTA: Shape = {
    "arm": "s", "Promo_Segment": "s", "Initiative": "s", "CustomerID": "i",
    **{f"{m}{end}": 2 for m in DELTA_METRICS for end in ("_post", "_D")},
}


def _delta_sql() -> str:
    shown_columns = []
    for m in DELTA_METRICS:
        scale = 100 if m == "Frequency%" else 1
        post, pre = f"b.{sql.q(m)}", f"a.{sql.q(m)}"
        shown_columns += [
            f"round_even({post} * {scale} * 100, 0) / 100 AS {sql.q(m + '_post')}",
            f"round_even(({post} - {pre}) * {scale} * 100, 0) / 100 AS {sql.q(m + '_D')}",
        ]
    return f"""SELECT arm, arms.promo AS Promo_Segment, arms.initiative AS Initiative, CustomerID,
  {', '.join(shown_columns)}
FROM (SELECT * FROM armed_players WHERE Period = 'Pre') a
FULL JOIN (SELECT * FROM armed_players WHERE Period = 'Post') b USING (arm, CustomerID) JOIN arms USING (arm)"""


@query("customer_delta", DELTA, players_sql(select=_delta_sql()))
def customer_delta_query(t: Tables) -> DataFrame:
    return t.campaign(keep=False).customer_delta


@query("customers_who_spent_more", {"CustomerID": "i", "Sales_All_D": 2}, players_sql(select=f"""
SELECT * FROM ({_delta_sql()}) WHERE arm = 'test' AND Sales_All_D > 0 ORDER BY Sales_All_D DESC, CustomerID"""))
def customers_who_spent_more(t: Tables) -> DataFrame:
    delta = t.campaign(keep=False).customer_delta
    return delta.where("arm = 'test' AND Sales_All_D > 0").orderBy(F.desc("Sales_All_D"), "CustomerID")


# --- timelines and test against control ------------------------------------------------------------


@query("day_sums", {"Transaction_Date": "d", "Period": "s", **{m: 4 for m in M}},
       labels_sql(f"SELECT Transaction_Date, Period, {', '.join(f'fsum({sql.q(m)}) AS {sql.q(m)}' for m in M)} "
                  "FROM dated GROUP BY ALL"))
def day_sums_query(t: Tables) -> DataFrame:
    return day_sums(_dated(t), METRICS)


def _register_timeline(metric: str) -> None:
    @query(f"timeline_{metric.lower()}", {"Period": "s", "Transaction_Date": "d", "value": 4},
           labels_sql(f"SELECT Period, Transaction_Date, fsum({metric}) AS value FROM dated GROUP BY ALL"))
    def timeline(t: Tables) -> DataFrame:
        return t.campaign().timeline(metric)


for _metric in ("Sales_All", "Quantity_All", "Coupons_All", "Transactions"):
    _register_timeline(_metric)


def _register_rolling(metric: str, rows: int) -> None:
    frame = f"(PARTITION BY arm, Period ORDER BY Transaction_Date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    name = sql.q(metric)

    @query(f"test_vs_control_{metric.lower()}_{rows}",
           {"arm": "s", "Period": "s", "Transaction_Date": "d", "value": 5, "moving_average": 5},
           days_sql(select=f"""SELECT arm, Period, Transaction_Date, {name} AS value,
  CASE WHEN count({name}) OVER {frame} = {rows} THEN favg({name}) OVER {frame} END AS moving_average FROM days"""))
    def rolling(t: Tables) -> DataFrame:
        return t.campaign(keep=False).test_vs_control(metric, rows)


for _metric, _rows in (("Sales_All", 1), ("Sales_All", 7), ("Sales_All", 14), ("Transactions", 14), ("Recency", 7)):
    _register_rolling(_metric, _rows)


@query("real_result", RESULT, result_sql(sql.real(), select="SELECT * FROM real_result"))
def real_result_query(t: Tables) -> DataFrame:
    return t.campaign().real_result


@query("real_result_post_long", RESULT,
       result_sql(sql.real(), select="SELECT * FROM real_result", periods=PERIODS["post_long"]))
def real_result_post_long(t: Tables) -> DataFrame:
    return t.campaign("post_long").real_result


@query("real_result_formatted", FORMATTED,
       result_sql(sql.real(), sql.formatted("real_result", ""), select="SELECT * FROM formatted"))
def real_result_formatted(t: Tables) -> DataFrame:
    return formatted(t.campaign().real_result, METRICS)


@query("real_result_shares", SHARES,
       result_sql(sql.real(), sql.shares("real_result", ""), select="SELECT * FROM shares"))
def real_result_shares(t: Tables) -> DataFrame:
    return shares(t.campaign().real_result, [])


# --- synthetic control -----------------------------------------------------------------------------


SCALED = [*M, "ActiveCustomer"]


@query("trailing_day_means", {"arm": "s", **{m: 4 for m in SCALED}},
       days_sql(sql.proportions(), select="SELECT * FROM trailing_means"))
def trailing_day_means(t: Tables) -> DataFrame:
    return trailing_means(t.campaign(keep=False).days, METRICS)


@query("test_control_proportions", {m: 7 for m in SCALED},
       days_sql(sql.proportions(), select="SELECT * FROM proportions"))
def test_control_proportions(t: Tables) -> DataFrame:
    return proportions(t.campaign(keep=False).days, METRICS)


@query("synthetic_days", {**DAY, "ActiveCustomer": 6},
       days_sql(sql.proportions(), sql.synthetic_days(), select="SELECT * FROM synthetic_days"))
def synthetic_days_query(t: Tables) -> DataFrame:
    return t.campaign().synthetic_days


@query("bootstrap_customers", {"draw": "i", "CustomerID": "i", "Sales_All": 6, "Frequency%": 9},
       players_sql(sql.bootstrap("(SELECT * FROM armed_players WHERE arm = 'control' AND Period = 'Post')",
                                 "CustomerID", "1.5", "redrawn"), select="SELECT * FROM redrawn"))
def bootstrap_customers(t: Tables) -> DataFrame:
    pool = in_cohort(t.campaign().customers.where(F.col("Period") == POST), ARMS["control"])
    return bootstrap(pool, "CustomerID", 1.5)


@query("synthetic_customers", {"arm": "s", **PLAYER},
       players_sql(sql.synthetic_customers(MAIN), select="SELECT * FROM synthetic_customers"))
def synthetic_customers_query(t: Tables) -> DataFrame:
    return t.campaign().synthetic_customers


SYNTHETIC_RESULT = (
    sql.FACTS, LABELS, FEATURES, ARMS_SQL, sql.ARMED_PLAYERS, DAYS, sql.proportions(), sql.synthetic_days(),
    sql.synthetic_customers(MAIN), sql.customer_tests("synthetic_customers"), sql.day_tests("synthetic_days"),
    sql.result(),
)


@query("synthetic_result", ARM_RESULT, sql.with_ctes(*SYNTHETIC_RESULT, select="SELECT * FROM result"))
def synthetic_result(t: Tables) -> DataFrame:
    return t.campaign().synthetic_result


@query("synthetic_real_result", RESULT,
       sql.with_ctes(*SYNTHETIC_RESULT, sql.real(), select="SELECT * FROM real_result"))
def synthetic_real_result(t: Tables) -> DataFrame:
    return real_result(t.campaign().synthetic_result)
