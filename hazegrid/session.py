"""Session set-up and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "hazegrid", cpus: str | int = "*", partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own.

    ``shared`` becomes ``spark.checkpoint.dir``, the folder for written intermediate tables.
    """
    builder = SparkSession.builder.master(f"local[{cpus}]")
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers on machines that see this folder import the package, whatever folder Spark was started in.

    A cluster whose machines do not see it gets the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder of its own; a cluster without it is an error, because a machine-local folder would
    be lost with its machine.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="hazegrid-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


_written: list[str] = []
_passing = threading.local()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, remembered for ``release``."""
    path = f"{shared_root(spark)}/hazegrid/{label}-{uuid.uuid4().hex}"
    getattr(_passing, "written", _written).append(path)
    return path


def delete_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(configuration).delete(location, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What this thread writes under ``shared_path`` inside is deleted at the end: for jobs that go on, batch by batch."""
    _passing.written = []
    try:
        yield
    finally:
        paths = _passing.written
        del _passing.written
        delete_paths(spark, paths)


def release(spark: SparkSession) -> int:
    """Delete everything this process has written under ``shared_path`` so far; returns how many paths that were.

    For the end of a job, when no table that reads from there is needed any more.
    """
    paths = _written.copy()
    _written.clear()
    delete_paths(spark, paths)
    return len(paths)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used (a) to fix values that depend on task layout, so a lost executor cannot change them, and (b) on
    small aggregates, so that the join planner sees their exact size and broadcasts them only when they
    are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
