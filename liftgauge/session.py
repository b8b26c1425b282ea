"""Session settings and the written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("liftgauge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # One session runs many different queries; their compiled stages should not push each other out.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Recording the Python call site of every column costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            configured = tempfile.mkdtemp(prefix="liftgauge-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


class Store:
    """A folder for written tables, below the shared one, that goes when its owner closes it.

    Within `with Store(spark):` everything that `written` and `scratch_path` make belongs to the store and is deleted
    at the block's end, so what is to stay has to be written to another store before. Deletion goes through Spark's own file systems. What is made
    outside of any block belongs to the session and goes when the program ends.
    """

    def __init__(self, spark: SparkSession, label: str = "store"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        # Held here, as a stopped session no longer hands them out.
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._outer: list[Token] = []

    def __enter__(self) -> Store:
        self._outer.append(_CURRENT.set(self))
        return self

    def __exit__(self, *_) -> None:
        _CURRENT.reset(self._outer.pop())
        self.close()

    def new_path(self, label: str) -> str:
        return f"{self.path}/{label}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """Write a table once and read it back."""
        path = self.new_path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete all that the store holds; a table read from it can no longer be used."""
        folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self._conf).delete(folder, True)


_CURRENT: ContextVar[Store | None] = ContextVar("liftgauge-store", default=None)
_SESSIONS: dict[str, Store] = {}


def _session_store(spark: SparkSession) -> Store:
    name = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if name not in _SESSIONS:
        _SESSIONS[name] = Store(spark, "session")
    return _SESSIONS[name]


@atexit.register
def _close_sessions() -> None:
    for store in _SESSIONS.values():
        # The JVM may be gone before us, and its folder then stays.
        with contextlib.suppress(Exception):
            store.close()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the store of the block, else in that of the session."""
    return (_CURRENT.get() or _session_store(spark)).new_path(label)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back, in the store of the block or else of the session.

    Several results read it, each only its own columns, and a lost executor costs no recomputation
    of what came before.
    """
    return (_CURRENT.get() or _session_store(df.sparkSession)).written(df, label)
