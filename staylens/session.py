"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar
from types import TracebackType
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Where the tables lie that ``staged`` gave out, and the workspace that owns new ones.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_OPEN: ContextVar[Workspace | None] = ContextVar("workspace", default=None)


def build_session(name: str = "staylens", cpus: int | None = None) -> SparkSession:
    """A session with runtime re-planning on; ``cpus`` asks for a local one.

    On a cluster the master, memory and partition counts come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="staylens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/staylens/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Model fitting makes several passes over its input. Reading a written table keeps those
    passes cheap and identical, and a lost executor costs a re-read, not the whole lineage.
    The open ``Workspace`` owns the table; without one it stays until someone deletes it.
    ``rows_per_file`` bounds the rows of a file (0: no bound), for readers that unpack them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    owner = _OPEN.get()
    if owner is not None:
        # Known before it is written: a write that fails leaves files too.
        owner.paths.add(path)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Owns the tables staged while it is open and removes them when it closes.

    What the caller gets must be written (``staged``) and kept (``keep``): a plan that reads a removed table
    fails. A kept table belongs to the workspace around this one, if there is one. ``release`` removes a
    table early, once the last table made from it is written. Errors remove everything.

        with Workspace(spark) as work:
            counts = staged(per_word(texts), "counts")
            return work.keep(staged(weights(counts), "weights"))
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: set[str] = set()

    def __enter__(self) -> Workspace:
        self._outer = _OPEN.get()
        self._token = _OPEN.set(self)
        return self

    def __exit__(
        self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        _OPEN.reset(self._token)
        for path in sorted(self.paths):
            remove_path(self.spark, path)
        self.paths.clear()

    def keep(self, table: DataFrame) -> DataFrame:
        """Hand a staged table to the workspace around this one, or to the caller."""
        path = _PATHS.get(table)
        if path is None:
            raise ValueError("only a table that staged() returned can be kept")
        if path in self.paths:
            self.paths.remove(path)
            if self._outer is not None:
                self._outer.paths.add(path)
        return table

    def release(self, *tables: DataFrame) -> None:
        """Remove staged tables that nothing reads any more; those of other owners stay."""
        for table in tables:
            path = _PATHS.get(table)
            if path in self.paths:
                self.paths.remove(path)
                remove_path(self.spark, path)
