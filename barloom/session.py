"""Session helpers: a default session for local work and lineage cuts for multi-pass jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "barloom") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the cluster declares as shared, whatever its scheme (a mounted
    volume is a ``file:`` path too). Only a local session without the setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    if getattr(spark.sparkContext, "_barloom_folder", None) is None:
        spark.sparkContext._barloom_folder = tempfile.mkdtemp(prefix="barloom-")
    return spark.sparkContext._barloom_folder


def _stage_paths(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if getattr(context, "_barloom_stages", None) is None:
        context._barloom_stages = []
    return context._barloom_stages


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several passes read one dataset (bars feeding features, pivots and overlays). Unlike
    ``checkpoint()`` the last stage runs once, later reads prune columns, and the planner knows the
    size. The files survive a lost executor. They stay until ``stages`` or ``clear_stages`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _stage_paths(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """The stages written inside are deleted at the end: for jobs whose results are stored by then."""
    paths = _stage_paths(spark)
    before = len(paths)
    try:
        yield
    finally:
        for path in paths[before:]:
            _delete(spark, path)
        del paths[before:]


def clear_stages(spark: SparkSession) -> None:
    """Delete the stages of this application, once everything that reads them is written."""
    for path in _stage_paths(spark):
        _delete(spark, path)
    _stage_paths(spark).clear()
