"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import os
import pathlib
import shutil
import tempfile
import uuid
import weakref

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Scale settings: adaptive execution sizes shuffles and splits skewed join partitions at
# run time, so no fixed partition count is tied to a data size.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "bidscope", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the cluster names none (a local test session) a temporary one is taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="bidscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str, replaces: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several later steps read the same costly rows: the text work runs once, the
    lineage is cut durably, and each reader still prunes columns and pushes filters. The write's own
    shuffle files go when it ends; so do the staged tables in ``replaces``, which nothing reads after it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/bidscope/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    for old in replaces:
        _remove(_STAGED.pop(old))
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = path
    return out


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _remove(path: str) -> None:
    store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.delete_dir(folder)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores ahead of per-row text work, where the input has too few files.

    A few large unsplittable files would otherwise keep the work in a few tasks. An input with
    at least as many files as the cluster has cores is left alone, so large data never moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application, unless their path already has it."""
    context = spark.sparkContext
    package = pathlib.Path(__file__).resolve().parent
    on_path = {pathlib.Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if package.parent in on_path or context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="bidscope-package-")  # the driver's own; the engine sends the file on
    archive = shutil.make_archive(f"{folder}/bidscope", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
