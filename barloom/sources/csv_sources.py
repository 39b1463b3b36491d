"""CSV sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions.scalars import floor_div, long, NS_PER_MINUTE, NS_PER_DAY, wall_clock_ns, yyyymmdd


def _read(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """Read by header name with the declared types; unknown columns are dropped.

    The header is the only part read up front. Only the needed columns are parsed
    (``columnPruning``), and a cell of the wrong type fails the job.
    """
    header = spark.read.option("header", True).csv(path).columns
    if not header:
        raise ValueError(f"{path} is empty.")
    missing = [c for c in (required or schema.fieldNames()) if c not in header]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}.")
    declared = {f.name: f for f in schema.fields}
    full = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in header])
    rows = (
        spark.read.schema(full)
        .option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
        .csv(path)
    )
    return rows


def read_minute_csv(spark: SparkSession, path: str) -> DataFrame:
    """S01."""
    return _read(spark, path, schemas.RAW_MINUTE).select(*schemas.RAW_MINUTE.fieldNames())


def read_tick_csv(
    spark: SparkSession, path: str, sequence: str | None = None, symbol_column: str | None = None
) -> DataFrame:
    """Ticks with ``symbol`` (the file stem, or a column) and the 1-based ``row_no`` of the row in its file.

    With ``sequence`` the file carries its own row number. Without it the number follows from the
    split offset and the place inside the split; numbering is per split plus the rows of earlier
    splits of that file, so a file of any size is numbered in parallel.
    """
    names = schemas.RAW_TICK.fieldNames()
    rows = _read(spark, path, schemas.RAW_TICK, names)
    stem = F.col(symbol_column) if symbol_column else F.regexp_extract(
        F.col("_metadata.file_path"), r"([^/]+)\.csv[^/]*$", 1
    )
    needed = F.lit(False)
    for c in schemas.RAW_TICK_REQUIRED:
        needed = needed | F.col(c).isNull()
    # A filter, so that the check runs whatever columns are read later.
    rows = rows.where(F.when(needed, F.raise_error(F.lit("A required tick value is blank.")).cast("boolean")).otherwise(F.lit(True)))
    if sequence is not None:
        return rows.select(*names, stem.alias("symbol"), F.col(sequence).cast("long").alias("row_no"))
    placed = rows.select(
        *names, stem.alias("symbol"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )
    counts = placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file", "block").orderBy("place")
    return (
        placed.withColumn("n", F.row_number().over(inside)).join(offsets, ["file", "block"])
        .select(*names, "symbol", (F.col("n") + F.col("offset")).alias("row_no"))
    )


def read_reference_minute_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reference minutes with natural ``session_date`` and ``minute_key`` from the ``+08:00`` wall clock."""
    rows = _read(spark, path, schemas.RAW_REFERENCE_MINUTE)
    bad = F.raise_error(F.concat(F.lit("Unexpected zone suffix in "), F.col("bob"))).cast("long")
    local = F.when(F.col("bob").endswith("+08:00"), wall_clock_ns(F.col("bob"))).otherwise(bad)
    return rows.withColumn("local_ns", local).select(
        "symbol", yyyymmdd(floor_div(F.col("local_ns"), NS_PER_DAY)).alias("session_date"),
        floor_div(F.col("local_ns"), NS_PER_MINUTE).alias("minute_key"), "bob", "eob", *schemas.PARITY_FIELDS,
    )
