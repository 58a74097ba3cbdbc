"""Session helpers: a tuned local session, and the folder used to cut lineage."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "popstat", cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's executors, once, so that they need no copy of it.

    The driver's archive is served by Spark to executors that start later, too.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="popstat-package-"), "popstat.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder is made only in local mode, where there is one machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = named or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="popstat-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A fresh path below the shared folder; see :func:`delete_scratch` and :func:`temporary_tables`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _written.setdefault(spark.sparkContext.applicationId, [[]])
    scopes[max(len(scopes) - 1 - outlive, 0)].append(path)
    return path


#: Paths by application: those of the whole session, then those of each open temporary_tables().
_written: dict[str, list[list[str]]] = {}


def scratch_paths(spark: SparkSession) -> list[str]:
    """What this session has written below the shared folder and not deleted."""
    return [path for scope in _written.get(spark.sparkContext.applicationId, []) for path in scope]


def delete_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete what this session wrote below the shared folder, or only ``paths`` of it; call it when its results have been used or saved.

    Gives the number of folders deleted. Tables made from them can no longer be read. Spark
    is asked to drop the shuffles and broadcasts of plans that nothing refers to any more.
    """
    scopes, deleted = _written.get(spark.sparkContext.applicationId, []), 0
    for name in scratch_paths(spark) if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    for scope in scopes:
        scope[:] = [] if paths is None else [name for name in scope if name not in set(paths)]
    gc.collect()
    spark._jvm.System.gc()
    return deleted


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end, but for those written to outlive it.

    What is returned from inside must be such a table, or not read any other.
    """
    scopes = _written.setdefault(spark.sparkContext.applicationId, [[]])
    scopes.append([])
    try:
        yield
    finally:
        delete_scratch(spark, scopes[-1])
        scopes.pop()


#: Rows and bytes of a batch that Spark hands a Python worker, at most.
SMALL_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand Python workers small batches, so that long texts take little memory on either side.

    Spark's own are of 10,000 rows: the executor fills one for each task, and the worker holds one while it reads the next.
    """
    before = {name: spark.conf.get(name, None) for name in SMALL_BATCH}
    for name, value in SMALL_BATCH.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_lineage(df: DataFrame, compression: str | None = None, outlive: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``outlive`` the innermost :func:`temporary_tables`.

    A lost executor then costs no recomputation of what came before, later steps
    read only the columns they use, and the optimizer knows the size.
    """
    path = scratch_path(df.sparkSession, "stage", outlive)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
