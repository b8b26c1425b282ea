"""Customer-day facts that are kept up to date: only the months and buckets that new lines touch are made anew."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgauge.operators.facts import daily_facts
from liftgauge.params import FACTS_MONTH, Metrics

BUCKET = "Facts_Bucket"
CELL = [FACTS_MONTH, BUCKET]
LINE_KEYS = ["CustomerID", "Transaction_ID", "Transaction_Date"]
PART = "_part"
#: A cell with more lines is dealt in several parts.
PART_LINES = 1 << 19
#: The lines of a cell that lie in so many runs are put together when the next batch touches it.
MOST_RUNS = 16


def _with_cell(columns: T.StructType) -> T.StructType:
    return columns.add(FACTS_MONTH, T.DateType()).add(BUCKET, T.IntegerType())


class Folder:
    """Files below a path, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        folder = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that is there whole or not at all; False if it is there already."""
        half = self._at(f".{name.rpartition('/')[2]}-{uuid.uuid4().hex}")
        stream = self._fs.create(half, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._at(name)
        self._fs.mkdirs(target.getParent())
        done = not self._fs.exists(target) and self._fs.rename(half, target)
        if not done:
            self._fs.delete(half, False)
        return done

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Manifest:
    """Which runs hold the lines and the facts of each month and bucket, and which batches are in them."""

    version: int
    batches: tuple[str, ...]
    # "month/bucket" to the run that wrote its facts
    runs: dict[str, str]
    line_schema: str
    fact_schema: str
    # "month/bucket" to the runs that its lines lie in
    line_runs: dict[str, list[str]]

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"batches": list(self.batches)})

    @classmethod
    def of(cls, text: str) -> Manifest:
        got = json.loads(text)
        # Older manifests have one run for both.
        got.setdefault("line_runs", {cell: [run] for cell, run in got["runs"].items()})
        return cls(**got | {"batches": tuple(got["batches"])})


class FactStore:
    """Sales lines and the facts made of them, side by side, by month and by a hash bucket of the customer.

    `refresh` adds a batch of lines. It reads the lines and rewrites the facts of those months and buckets alone that the batch
    touches, as a customer's day lies in one of them, into new folders, and then puts down the next manifest. Lines that
    are there stay in their files; they are rewritten only where a correction takes some away, or where they lie in many files.
    A reader takes the newest manifest and so sees all of a batch or nothing; a refresh that ends early leaves only
    folders that `vacuum` clears. Of two refreshes at once one fails and can be run again.
    """

    def __init__(self, spark: SparkSession, path: str, metrics: Metrics = Metrics(), buckets: int = 64):
        self.spark, self.path, self.metrics, self.buckets = spark, path, metrics, buckets
        self.folder = Folder(spark, path)

    def manifest(self) -> Manifest | None:
        names = self.folder.names("manifests")
        return Manifest.of(self.folder.read(f"manifests/{names[-1]}")) if names else None

    def daily(self) -> DataFrame:
        """The customer-day facts with the month they are partitioned by, for `Campaign.from_daily`."""
        now = self.manifest()
        if now is None:
            raise ValueError(f"{self.path} holds no facts yet")
        return self._read("facts", now.fact_schema, {cell: [run] for cell, run in now.runs.items()}).drop(BUCKET)

    def lines(self) -> DataFrame:
        now = self.manifest()
        if now is None:
            raise ValueError(f"{self.path} holds no lines yet")
        return self._read("lines", now.line_schema, now.line_runs).drop(*CELL)

    def _read(self, kind: str, schema: str, runs: dict[str, list[str]]) -> DataFrame:
        columns = _with_cell(T.StructType.fromJson(json.loads(schema)).add("run", T.StringType()))
        if not runs:
            return self.spark.createDataFrame([], columns).drop("run")
        base = f"{self.path}/{kind}"
        paths = [f"{base}/run={run}/{FACTS_MONTH}={month}/{BUCKET}={bucket}"
                 for (month, bucket), run in ((cell.split("/"), run) for cell, found in runs.items() for run in found)]
        return self.spark.read.schema(columns).option("basePath", base).parquet(*paths).drop("run")

    def _placed(self, lines: DataFrame) -> DataFrame:
        return lines.dropna(subset=LINE_KEYS).withColumns({
            FACTS_MONTH: F.trunc("Transaction_Date", "MM"),
            BUCKET: F.pmod(F.hash("CustomerID"), F.lit(self.buckets)).cast("int"),
        })

    def _write(self, rows: DataFrame, kind: str, run: str) -> None:
        rows.write.partitionBy(*CELL).parquet(f"{self.path}/{kind}/run={run}")

    def _cells(self, rows: DataFrame) -> set[str]:
        """At most months times buckets."""
        return {f"{r[0]}/{r[1]}" for r in rows.select(*CELL).distinct().collect()}

    def _written_cells(self, kind: str, run: str) -> set[str]:
        return {f"{month.partition('=')[2]}/{bucket.partition('=')[2]}"
                for month in self.folder.names(f"{kind}/run={run}") if "=" in month
                for bucket in self.folder.names(f"{kind}/run={run}/{month}")}

    def _dealt(self, lines: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
        """`rows` shuffled by cell and, as far as the cells of `lines` are large, by a hash of `keys`: the column PART."""
        most = lines.groupBy(*CELL).count().agg(F.max("count")).first()[0] or 0
        return rows.withColumn(PART, F.pmod(F.hash(*keys), F.lit(1 + most // PART_LINES))).repartition(*CELL, PART)

    def _facts(self, lines: DataFrame) -> DataFrame:
        """The facts of whole cells. One shuffle deals the lines as the transactions, the days and the files need them; the
        lines of a customer's day meet in one task, which adds them up as they come.
        """
        dealt = self._dealt(lines, lines, "CustomerID", "Transaction_Date")
        return daily_facts(dealt, self.metrics, (*CELL, PART)).drop(PART)

    def _corrected(self, lines: DataFrame, gone: DataFrame, incoming: DataFrame) -> DataFrame:
        """`incoming` and those of the lines whose cell and transaction are not in `gone`, dealt once for that and the files."""
        keys = LINE_KEYS[:2]
        rows = (
            lines.select(*incoming.columns).withColumn("_kind", F.lit("there"))
            .unionByName(gone.withColumn("_kind", F.lit("gone")), allowMissingColumns=True)
            .unionByName(incoming.withColumn("_kind", F.lit("new"))))
        here = Window.partitionBy(*CELL, PART, *keys)
        return (
            self._dealt(lines, rows, *keys)
            .withColumn("_gone", F.max(F.col("_kind") == "gone").over(here))
            .where((F.col("_kind") == "new") | (F.col("_kind") == "there") & ~F.col("_gone"))
            .select(*incoming.columns))

    def refresh(self, lines: DataFrame, batch: str, corrects: bool = False) -> Manifest:
        """Add the lines of a batch, new days and late ones alike.

        With `corrects`, the batch holds all lines of its transactions as they should be: what is there of those
        transactions (customer and transaction id), on whatever day, goes. A batch that is in already changes nothing,
        so a refresh can be repeated. Lines without customer, transaction or date are left out, as everywhere.
        """
        before = self.manifest() or Manifest(0, (), {}, "", "", {})
        if batch in before.batches:
            return before
        if before.line_schema and json.loads(before.line_schema) != json.loads(lines.schema.json()):
            raise ValueError(f"the lines of batch {batch} have another schema than those of the store")
        run = uuid.uuid4().hex
        incoming = self._placed(lines)
        # A cell that holds much is split over tasks at run time, which a plain repartitioning would not do.
        rows = incoming.hint("rebalance", *CELL)
        # Of these cells all lines are written anew.
        anew = {cell for cell, r in before.line_runs.items() if len(r) >= MOST_RUNS}
        if anew or corrects and before.line_runs:
            touched = self._cells(incoming)
            anew &= touched
            there = lambda cells: self._read("lines", lines.schema.json(), {c: before.line_runs[c] for c in cells})
            if corrects:
                buckets = {cell.rpartition("/")[2] for cell in touched}
                near = there(cell for cell in before.line_runs if cell.rpartition("/")[2] in buckets)
                found = near.join(incoming.select(*LINE_KEYS[:2]).distinct(), LINE_KEYS[:2], "left_semi")
                gone = found.select(*CELL, *LINE_KEYS[:2]).distinct()
                # Both the cells and the lines to be left out come of it.
                gone.write.parquet(f"{self.path}/gone/run={run}")
                gone = self.spark.read.schema(gone.schema).parquet(f"{self.path}/gone/run={run}")
                anew |= self._cells(gone)
                if anew:
                    rows = self._corrected(there(anew), gone, incoming)
            elif anew:
                rows = there(anew).select(*incoming.columns).unionByName(incoming).hint("rebalance", *CELL)
        self._write(rows, "lines", run)
        self.folder.delete(f"gone/run={run}")
        added = self._written_cells("lines", run)
        line_runs = {cell: r for cell, r in before.line_runs.items() if cell not in anew}
        line_runs |= {cell: [*line_runs.get(cell, ()), run] for cell in sorted(added)}
        # A transaction has one date and a customer one bucket, so all lines of a customer's day are in one cell.
        facts = self._facts(self._read("lines", lines.schema.json(), {cell: line_runs[cell] for cell in added}))
        self._write(facts, "facts", run)
        # A cell whose lines have all moved elsewhere is not there any more.
        runs = {cell: r for cell, r in before.runs.items() if cell not in added | anew}
        runs |= dict.fromkeys(sorted(self._written_cells("facts", run)), run)
        after = Manifest(before.version + 1, (*before.batches, batch), runs, lines.schema.json(),
                         facts.drop(*CELL).schema.json(), line_runs)
        if not self.folder.put(f"manifests/{after.version:012d}.json", after.text()):
            raise RuntimeError(f"{self.path} was refreshed by another one in the meantime; batch {batch} is not in it")
        return after

    def vacuum(self) -> None:
        """Delete older manifests and all runs that the newest one does not name. Nobody may be reading them any more."""
        now = self.manifest()
        live = {
            "lines": {run for found in now.line_runs.values() for run in found} if now else set(),
            "facts": set(now.runs.values()) if now else set(),
            "gone": set(),
        }
        for kind, runs in live.items():
            for name in self.folder.names(kind):
                if name.partition("=")[2] not in runs:
                    self.folder.delete(f"{kind}/{name}")
        for name in self.folder.names("manifests")[:-1]:
            self.folder.delete(f"manifests/{name}")
