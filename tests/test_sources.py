import json
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from liftgauge.operators.facts import daily_facts
from liftgauge.session import Store, shared_dir, written
from liftgauge.sources import fact_store, profile
from liftgauge.sources.fact_store import FactStore
from liftgauge.sources.sales import read_initiatives_csv, read_sales_csv, read_sales_parquet, rejected_dates, split_sales_csv
from liftgauge.sources.sinks import save_daily_bucketed, save_initiatives_bucketed, save_table

HEADER = "CustomerID,Transaction_ID,Transaction_Date,Product_Category,Quantity,Avg_Price,Coupon_Status\n"


@pytest.fixture
def tables(spark):
    """Names of tables that are dropped after the test, however it ends."""
    made = []
    yield lambda name: made.append(name) or name
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_csv(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(HEADER + "17850,16679,1/1/2019,Nest-USA,1,153.71,Used\n17850,16680,12/31/2019,Bags,2,5,\n")
    rows = read_sales_csv(spark, str(tmp_path / "sales.csv")).collect()
    assert [r.Transaction_Date.isoformat() for r in rows] == ["2019-01-01", "2019-12-31"]
    assert rows[0].Transaction_ID == "16679" and rows[0].Avg_Price == 153.71 and rows[1].Coupon_Status is None
    (tmp_path / "init.csv").write_text("CustomerID,Initiative\n12347,BuyOneGetOne\n")
    assert read_initiatives_csv(spark, str(tmp_path / "init.csv")).first().CustomerID == 12347


def test_csv_columns_are_found_by_name(spark, tmp_path):
    lines = [(17850, "16679", "1/1/2019", "Bags", 2.0, 99.5, "Used")]
    shuffled = "Avg_Price,Product_SKU,Quantity,CustomerID,Coupon_Status,Transaction_Date,Transaction_ID,Product_Category\n"
    for name, mark in (("plain", ""), ("marked", "\ufeff")):
        path = tmp_path / f"{name}.csv"
        path.write_text(mark + shuffled + "99.5,x,2,17850,Used,1/1/2019,16679,Bags\n", encoding="utf-8")
        row = read_sales_csv(spark, str(path)).first()
        assert (row.CustomerID, row.Transaction_ID, row.Quantity, row.Avg_Price) == (17850, "16679", 2.0, 99.5)
        assert row.Transaction_Date.isoformat() == "2019-01-01" and len(row) == len(lines[0])


def test_csv_refuses_a_missing_column_and_bad_numbers(spark, tmp_path):
    (tmp_path / "short.csv").write_text("CustomerID,Name\n1,x\n")
    with pytest.raises(ValueError, match="no column Initiative"):
        read_initiatives_csv(spark, str(tmp_path / "short.csv"))
    (tmp_path / "bad.csv").write_text(HEADER + "1,a,1/1/2019,Bags,two,1,Used\n")
    with pytest.raises(PySparkException):
        read_sales_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_csv_refuses_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "init"
    folder.mkdir()
    (folder / "a.csv").write_text("CustomerID,Initiative\n1,x\n")
    (folder / "b.csv").write_text("Initiative,CustomerID\nx,2\n")
    with pytest.raises(Exception, match="header"):
        read_initiatives_csv(spark, str(folder)).collect()


def test_a_bad_date_fails_and_can_be_counted(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(HEADER + "1,a,2019-01-01,Bags,1,1,Used\n1,b,01/02/2019,Bags,1,1,Used\n1,c,,Bags,1,1,Used\n")
    with pytest.raises(PySparkException):
        read_sales_csv(spark, str(path)).collect()
    text = spark.read.option("header", True).csv(str(path))
    assert tuple(rejected_dates(text).first()) == (3, 2, 1)


def test_parquet_and_partitioned_sink(spark, sales, tmp_path):
    lines = sales([(1, "a", "2019-01-01", "Bags", 1.0, 2.0, "Used"), (2, "b", "2019-01-02", "Bags", 1.0, 2.0, "Used")])
    save_table(lines.withColumn("extra", F.lit(1)), str(tmp_path / "sales"), partition_by=["Transaction_Date"])
    assert read_sales_parquet(spark, str(tmp_path / "sales")).columns == lines.columns
    with pytest.raises(PySparkException):
        save_table(lines, str(tmp_path / "sales"))


def test_profile(spark):
    frame = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "x", 1.0)], "a int, b string, c double")
    rows = {r.column: (r.type, r.rows, r.non_null, r.nulls) for r in profile.column_profile(frame).collect()}
    assert rows == {"a": ("int", 3, 3, 0), "b": ("string", 3, 2, 1), "c": ("double", 3, 1, 2)}
    assert [tuple(r) for r in profile.value_counts(frame, "b").collect()] == [("x", 2)]
    assert profile.numeric_columns(frame) == ["a", "c"]
    choices = profile.choices(frame, "b").orderBy("position").collect()
    assert [r.choice for r in choices] == ["All", "x"]
    assert tuple(profile.date_bounds(frame, "a").first()) == (1, 3)


def test_sample_is_stable(spark):
    frame = spark.range(1000)
    first = profile.stable_sample(frame, ["id"]).collect()
    assert len(first) == 5 and first == profile.stable_sample(frame.repartition(9), ["id"]).collect()
    assert first != profile.stable_sample(frame, ["id"], seed=1).collect()


def test_bucketed_facts_are_not_shuffled_by_customer_again(spark, sales, metrics, initiatives, tmp_path, tables):
    from liftgauge.operators.labels import label
    from liftgauge.params import Periods

    daily = daily_facts(sales([
        (c, f"t{c}", "2019-01-01", "Bags", 1.0, 2.0, "Used") for c in range(50)
    ]), metrics)
    kept = save_daily_bucketed(daily, tables("daily_bucketed_test"), str(tmp_path / "daily"), buckets=4)
    labelled = label(kept, initiatives(1, 2), Periods.of("2019-01-01", "2019-01-31", "2019-02-01", "2019-02-28"))
    assert labelled.count() == 50
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(CustomerID" in line]
    # only the small initiatives table is shuffled, if anything
    assert len(shuffles) <= 1


def test_an_analysis_of_stored_facts_reads_the_months_of_its_span(spark, sales, metrics, initiatives, tmp_path, tables):
    from liftgauge.params import Cohort, Periods
    from liftgauge.plans.campaign import Campaign

    lines = sales([(c, f"t{c}{m}", f"2019-0{m}-05", "Bags", 1.0, 2.0, "Used") for c in range(9) for m in range(1, 7)])
    kept = save_daily_bucketed(daily_facts(lines, metrics), tables("daily_months_test"), str(tmp_path / "daily"), buckets=2)
    periods = Periods.of("2019-02-01", "2019-02-28", "2019-03-01", "2019-03-31")
    arms = {"test": Cohort(), "control": Cohort("Promo")}
    stored = Campaign.from_daily(kept, initiatives(1, 2), periods, arms, metrics, keep=False)
    plan = stored.marked._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "Facts_Month" in line)
    assert "Facts_Month" in scan and "2019-02-01" in scan and "2019-03-01" in scan
    raw = Campaign(lines, initiatives(1, 2), periods, arms, metrics, keep=False)
    assert sorted(stored.result.collect(), key=str) == sorted(raw.result.collect(), key=str)
    other = stored.with_arms({"test": Cohort("Promo"), "control": Cohort()})
    assert other.cube is stored.cube and other.result.count() == raw.result.count()


def test_labels_of_bucketed_tables_need_no_exchange(spark, sales, metrics, initiatives, tmp_path, tables):
    from liftgauge.params import Periods
    from liftgauge.plans.campaign import Campaign

    lines = sales([(c, f"t{c}{m}", f"2019-0{m}-05", "Bags", 1.0, 2.0, "Used") for c in range(40) for m in range(1, 7)])
    periods = Periods.of("2019-02-01", "2019-02-28", "2019-03-01", "2019-03-31")
    daily = save_daily_bucketed(daily_facts(lines, metrics), tables("daily_joined_test"), str(tmp_path / "daily"), buckets=4)
    listed = save_initiatives_bucketed(initiatives(*range(9)), tables("initiatives_test"), str(tmp_path / "initiatives"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        campaign = Campaign.from_daily(daily, listed, periods, metrics=metrics, keep=False)
        assert "Exchange" not in campaign.marked._jdf.queryExecution().executedPlan().toString()
        raw = Campaign(lines, initiatives(*range(9)), periods, metrics=metrics, keep=False)
        assert sorted(map(tuple, campaign.marked.collect())) == sorted(map(tuple, raw.marked.select(*campaign.marked.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


SHUFFLED = "Coupon_Status,CustomerID,Extra,Transaction_ID,Transaction_Date,Product_Category,Quantity,Avg_Price"


def test_refused_lines_are_listed_with_file_line_and_reason(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    good = [f"Used,{i},x,t{i},3/{i % 28 + 1}/2019,\"Bags, large\",2,1.5" for i in range(400)]
    first = [SHUFFLED, *good]
    first[7] = "Used,a7,x,t7,3/1/2019,Bags,2,1.5"
    first[200] = "Used,8,x,t8,2019-03-01,Bags,2,1.5"
    first[201] = "Used,9,x,t9,3/1/2019,Bags,2"
    first[202] = "Used,9,x,t9,3/1/2019,Bags,2,1.5,7"
    first[300] = ""
    first[399] = "Used,10,x,t10,3/1/2019,Bags,many,1.5"
    first.append("Used,,x,,,,,")
    (folder / "a.csv").write_text("\n".join(first) + "\n")
    (folder / "b.csv").write_text(SHUFFLED + "\nUsed,1,x,t1,3/1/2019,Bags,2,\n")
    (folder / "c.csv").write_text(SHUFFLED.replace("Extra", "Other") + "\nUsed,1,x,t1,3/1/2019,Bags,2,1.5\n")
    (folder / "d.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        kept, refused = split_sales_csv(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5  # files are cut into blocks
        found = sorted((r.file[-5:], r.line, r.reason, r.text) for r in refused.collect())
        number = "another number of columns"
        assert found == [
            ("a.csv", 8, "CustomerID does not parse", first[7]), ("a.csv", 201, "Transaction_Date does not parse", first[200]),
            ("a.csv", 202, number, first[201]), ("a.csv", 203, number, first[202]),
            ("a.csv", 400, "Quantity does not parse", first[399]),
            ("c.csv", 1, "another header", SHUFFLED.replace("Extra", "Other")),
            ("c.csv", 2, "another header", "Used,1,x,t1,3/1/2019,Bags,2,1.5"),
        ]
        rows = kept.collect()
        assert len(rows) == 400 - 6 + 2 and kept.schema == read_sales_csv(spark, str(folder / "b.csv")).schema
        assert {r.Product_Category for r in rows} == {"Bags, large", "Bags", None}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    with pytest.raises(Exception, match="does not parse|header"):
        read_sales_csv(spark, str(folder)).collect()
    with pytest.raises(ValueError, match="has no column"):
        (tmp_path / "e.csv").write_text("a,b\n1,2\n")
        split_sales_csv(spark, str(tmp_path / "e.csv"))


def test_refreshed_facts_are_those_of_a_rebuild(spark, sales, metrics, tmp_path):
    rng = random.Random(2)

    def some(n, months):
        return [(rng.randint(1, 30), f"t{rng.randint(1, 400)}-{m}", f"2019-0{m}-0{rng.randint(1, 9)}", rng.choice(["Apparel", "Bags"]),
                 float(rng.randint(1, 5)), rng.randint(100, 999) / 100, rng.choice(["Used", "No"]))
                for m in (rng.choice(months) for _ in range(n))]

    first, late = some(300, (1, 2, 3)), some(60, (3, 4))
    store = FactStore(spark, str(tmp_path / "store"), metrics, buckets=3)
    with pytest.raises(ValueError, match="no facts"):
        store.daily()
    one = store.refresh(sales(first), "first")
    again = store.refresh(sales(first), "first")
    assert again == one
    old = store.daily()
    two = store.refresh(sales(late), "late")
    # Months and buckets that no late line touches are where they were.
    assert {c for c in one.runs if two.runs[c] == one.runs[c]} == {c for c in one.runs if not c.startswith("2019-03")}
    # All lines of some transactions, corrected: other amounts, one on a day of another month, one gone to nothing.
    wrong = sorted({(c, t) for c, t, *_ in first})[:12]
    corrected = [(c, t, f"2019-0{1 + i % 4}-05", "Apparel", 9.0, 1.25, "Used") for i, (c, t) in enumerate(wrong)]
    store.refresh(sales(corrected), "fixes", corrects=True)
    rest = [x for x in first + late if (x[0], x[1]) not in wrong]
    rebuilt = daily_facts(sales(rest + corrected), metrics)
    assert sorted(map(tuple, store.daily().select(*rebuilt.columns).collect())) == sorted(map(tuple, rebuilt.collect()))
    assert old.count() == daily_facts(sales(first), metrics).count()  # a reader of before still reads what was then
    assert store.lines().count() == len(rest) + len(corrected)
    plan = store.daily().where("Facts_Month = DATE'2019-02-01'")._jdf.queryExecution().executedPlan().toString()
    assert "Facts_Month" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    store.vacuum()
    assert store.lines().count() == len(rest) + len(corrected) and len(store.folder.names("manifests")) == 1
    assert set(store.folder.names("facts")) == {f"run={r}" for r in store.manifest().runs.values()}
    # A refresh that meets another one's manifest fails and leaves the store as it was.
    store.folder.put(f"manifests/{store.manifest().version + 1:012d}.json", store.manifest().text())
    with pytest.raises(RuntimeError, match="another one"):
        store.refresh(sales(late), "more")
    with pytest.raises(ValueError, match="another schema"):
        store.refresh(sales(late).withColumn("more", F.lit(1)), "other")


def test_a_refresh_moves_few_lines(spark, sales, metrics, tmp_path, monkeypatch):
    monkeypatch.setattr(fact_store, "PART_LINES", 20)
    days = [f"2019-0{m}-0{d}" for m in (1, 2, 3) for d in range(1, 6)]
    first = [(c, f"t{c}-{day}", day, "Bags", 1.0 + n, 2.5, "Used") for c in range(12) for day in days for n in range(2)]
    late = [(c, f"late{c}", "2019-02-03", "Apparel", 3.0, 1.25, "No") for c in range(12)] + [(3, "new", "2019-04-01", "Bags", 1.0, 1.0, "No")]
    # One transaction of January moves to March and another one of March changes; the customer without lines before is new.
    fixes = [(2, "t2-2019-01-02", "2019-03-09", "Bags", 7.0, 0.5, "No"), (4, "t4-2019-03-01", "2019-03-01", "Bags", 8.0, 0.5, "No"),
             (99, "t99", "2019-02-08", "Bags", 1.0, 1.0, "No"), (99, "t99", "2019-02-08", "Bags", 1.0, 1.0, "No")]
    fixed = {(c, t) for c, t, *_ in fixes}
    store = FactStore(spark, str(tmp_path / "store"), metrics, buckets=2)

    def new_lines(before, after):
        (run,) = {r for found in after.line_runs.values() for r in found} - {r for found in before.line_runs.values() for r in found}
        return spark.read.parquet(f"{store.path}/lines/run={run}").count()

    def is_rebuild_of(lines):
        rebuilt = daily_facts(sales(lines), metrics)
        assert sorted(map(tuple, store.daily().select(*rebuilt.columns).collect())) == sorted(map(tuple, rebuilt.collect()))
        assert sorted(map(tuple, store.lines().select(*sales(lines).columns).collect())) == sorted(map(tuple, sales(lines).collect()))

    one = store.refresh(sales(first), "first")
    two = store.refresh(sales(late), "late")
    assert new_lines(one, two) == len(late)
    is_rebuild_of(first + late)
    # Lines are shuffled once on their way to the facts, in several parts of a month.
    facts = store._facts(store._read("lines", two.line_schema, two.line_runs))
    assert facts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert store._dealt(*[store._read("lines", two.line_schema, two.line_runs)] * 2, "CustomerID").select("_part").distinct().count() > 1
    three = store.refresh(sales(fixes), "fixes", corrects=True)
    kept = [x for x in first + late if (x[0], x[1]) not in fixed]
    is_rebuild_of(kept + fixes)
    # Only the months and buckets that lose lines are written anew, the others keep their files.
    lost = {cell for cell, found in two.line_runs.items() if not set(found) <= set(three.line_runs.get(cell, ()))}
    assert 1 <= len(lost) <= 2 and {cell[:7] for cell in lost} == {"2019-01", "2019-03"}
    assert new_lines(two, three) < len(kept)
    assert not store.folder.names("gone")
    # Many small batches do not pile up.
    monkeypatch.setattr(fact_store, "MOST_RUNS", 2)
    more = [(1, "more", "2019-02-01", "Bags", 1.0, 1.0, "No")]
    four = store.refresh(sales(more), "more")
    assert max(map(len, four.line_runs.values())) <= 3 and [len(r) for c, r in four.line_runs.items() if c not in three.line_runs or r != three.line_runs[c]] == [1]
    store.vacuum()
    is_rebuild_of(kept + fixes + more)
    # A manifest from before lines had runs of their own.
    old = json.loads(four.text())
    del old["line_runs"]
    assert fact_store.Manifest.of(json.dumps(old)).line_runs == {cell: [run] for cell, run in four.runs.items()}


def test_a_store_deletes_what_it_holds(spark, sales, metrics, initiatives):
    from liftgauge.params import Periods
    from liftgauge.plans.campaign import Campaign

    shared = Path(shared_dir(spark).removeprefix("file:"))
    lines = sales([(c, f"t{c}{m}", f"2019-0{m}-05", "Bags", 1.0, 2.0, "Used") for c in range(9) for m in range(1, 7)])
    periods = Periods.of("2019-02-01", "2019-02-28", "2019-03-01", "2019-03-31")
    before = set(shared.rglob("*"))
    with Campaign(lines, initiatives(1, 2), periods, metrics=metrics) as campaign:
        assert campaign.result.count() == 23 and campaign.with_arms(campaign.arms).result.count()
        assert set(shared.rglob("*")) > before
    assert set(shared.rglob("*")) == before
    with Store(spark) as outer:
        table = written(lines, "lines")
        with Store(spark) as inner:
            kept = outer.written(written(lines.limit(3), "few"), "kept")
            assert Path(inner.path.removeprefix("file:")).exists()
        assert not Path(inner.path.removeprefix("file:")).exists()
        assert kept.count() == 3 and table.count() == 54
    assert set(shared.rglob("*")) == before
