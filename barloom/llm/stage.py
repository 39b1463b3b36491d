"""Tables written between the passes of one operator, below the folder the cluster names in spark.checkpoint.dir.

A stage survives lost executors and lets later passes read only the columns they need. Stages of one application share
a folder, so that ``clear`` (or the owner of the folder) can remove them together once the results are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barloom.session import shared_folder

FILE_ROWS = 1 << 15
BROADCAST_ROWS = 1 << 18


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/barloom-llm-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written once and read back. Where it is known to have about ``rows`` rows at most, a small table is a few files,
    not one file for each shuffle partition. Not for wide rows, or for joins with them: they would meet in one task."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(groups_for(rows, FILE_ROWS))
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join with another large table, that Spark must not broadcast. Spark takes a table for as large as its files, and
    an explode for as large as its input, so a table of any size may look small; broadcast, all of it goes through the driver.
    ``rows``: about how many rows it has at most, if known; a few are left to Spark's choice."""
    return df if rows is not None and rows <= BROADCAST_ROWS else df.hint("merge")


def again(df: DataFrame) -> DataFrame:
    """The same stage as a relation of its own, for grouping it together with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._stage_path)


def drop(df: DataFrame) -> None:
    """Delete a stage that no result reads any more."""
    _delete(df.sparkSession, df._stage_path)


def clear(spark: SparkSession) -> None:
    """Delete all stages of this application."""
    _delete(spark, _folder(spark))


def groups_for(rows: int, per_group: int) -> int:
    """How many groups of about ``per_group`` rows hold ``rows`` rows."""
    return max(1, -(-rows // per_group))
