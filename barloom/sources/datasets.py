"""Parquet datasets: scans with pruning (S04-S11), the year-partitioned writer (K01) and profiles."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions.ordered import chunk_of
from barloom.functions.scalars import floor_div

ORDER = {
    "bars": ("bar_id",), "trades": ("event_order",), "features": ("bar_id",), "structures": ("start_bar_id", "structure_id"),
    "events": ("event_bar_id", "event_order", "event_id"), "parity": ("bar_local_id",),
}
ORDER_SPAN = 1 << 18
_REQUIRED = {
    "bars": schemas.BARS.fieldNames(), "trades": schemas.TRADES.fieldNames(), "features": schemas.FEATURES.fieldNames(),
    "structures": schemas.structure_columns(), "events": list(schemas.EVENT_COLUMNS),
    "parity": ["symbol", "session_date", "bar_local_id", "status"],
}


def year_of(session_date: Column) -> Column:
    return floor_div(session_date, 10000)


def write_dataset(
    df: DataFrame, path: str, kind: str, by: Sequence[str] = ("symbol",), order_span: int = ORDER_SPAN
) -> None:
    """Hive-style ``by.../year=`` folders whose files hold contiguous stretches of the order column.

    Rows are rebalanced by (by, year, stretch): a hot symbol is spread over its stretches, small
    groups share a task, and unlike a range exchange nothing is sampled, so the input runs once.
    """
    missing = [c for c in _REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"A {kind} dataset lacks columns {missing}.")
    order = ORDER[kind]
    dated = df.withColumn("year", year_of(F.col("session_date"))).withColumn(
        "__stretch", chunk_of(F.col(order[0]), order_span)
    )
    placed = dated.hint("rebalance", *[F.col(c) for c in (*by, "year", "__stretch")])
    placed.sortWithinPartitions(*by, "year", *order).drop("__stretch").write.mode("overwrite").partitionBy(
        *by, "year"
    ).parquet(path)


def scan(
    spark: SparkSession,
    path: str | Sequence[str],
    years: Iterable[int] | None = None,
    columns: Sequence[str] | None = None,
    where: Column | None = None,
    schema: T.StructType | None = None,
    sort: Sequence[str] = (),
) -> DataFrame:
    """Partition pruning by year, filter pushdown and column projection.

    Nothing is sorted unless asked for. A column that is not stored is an error.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)
    if years is not None:
        df = df.where(F.col("year").isin(*[int(y) for y in years]))
    if where is not None:
        df = df.where(where)
    df = df.drop("year") if columns is None else df.select(*columns)
    return df.orderBy(*sort) if sort else df


def scan_legacy_bars(spark: SparkSession, path: str, years: Iterable[int] | None = None) -> DataFrame:
    """Older bar files; ``ts_et_ns`` is read as ``ts_local_ns``, absent columns become NaN or null."""
    # Old and new names in one schema: no footer is opened to merge schemas, an absent column reads as null.
    names = [*schemas.BARS.fields, T.StructField("ts_et_ns", T.LongType()), T.StructField("year", T.LongType())]
    df = spark.read.schema(T.StructType(names)).parquet(path)
    if years is not None:
        df = df.where(F.col("year").isin(*[int(y) for y in years]))

    def column(field: T.StructField) -> Column:
        found = [F.col(field.name)]
        if field.name == "ts_local_ns":
            found.append(F.col("ts_et_ns"))
        if isinstance(field.dataType, T.DoubleType):
            found.append(F.lit(float("nan")))
        return F.coalesce(*found).alias(field.name)

    return df.select(*[column(f) for f in schemas.BARS.fields])


def scan_structures(spark: SparkSession, root: str, kind: str, **options) -> DataFrame:
    """``<root>/dataset=structures/kind=<kind>``, else the older ``<root>/kind=<kind>``."""
    paths = [f"{root}/dataset=structures/kind={kind}", f"{root}/kind={kind}"]
    for path in paths:
        try:
            return scan(spark, path, **options)
        except Exception as error:  # the reader reports a missing path as an analysis error
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"No {kind} dataset below {root}.")


def structure_bundle(spark: SparkSession, root: str, kinds: Sequence[str], **options) -> DataFrame:
    """S09."""
    out = None
    for kind in kinds:
        part = scan_structures(spark, root, kind, **options)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _range(column: str) -> list[Column]:
    return [F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}")]


def _years() -> Column:
    # Distinct years, not rows: the set is small by nature.
    return F.array_sort(F.collect_set(year_of(F.col("session_date")))).alias("years")


def profile_bars(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """K02. Sessions are counted from a pre-aggregated (key, session) table, so a hot symbol is no hot task."""
    sessions = bars.groupBy(*by, "session_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("bar_id").alias("lo"), F.max("bar_id").alias("hi")
    )
    return sessions.groupBy(*by).agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("session_count"), F.min("lo").alias("min_bar_id"),
        F.max("hi").alias("max_bar_id"), *_range("session_date"), _years(),
    )


def profile_trades(trades: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """K03."""
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), *_range("event_order"), *_range("ts_utc_ns"), *_range("session_date"),
        _years(),
    )


def profile_features(features: DataFrame, by: Sequence[str] = ("symbol", "feature_key")) -> DataFrame:
    """K04."""
    return features.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), *_range("bar_id"), *_range("session_date"), _years()
    )


def profile_structures(structures: DataFrame, by: Sequence[str] = ("symbol", "kind")) -> DataFrame:
    """K05."""
    state = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_count")
    return structures.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), *_range("start_bar_id"), *_range("session_date"), state("candidate"),
        state("confirmed"), state("invalidated"), _years(),
    )


def profile_events(events: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """K06."""
    kind = lambda s: F.count_if(F.col("event_type") == s).alias(f"{s}_count")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), *_range("event_bar_id"), *_range("session_date"),
        *[kind(k) for k in ("created", "updated", "confirmed", "invalidated", "replaced")], _years(),
    )


def profile_parity(rows: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """K07."""
    from barloom.operators.parity import parity_summary

    stats = rows.groupBy(*by).agg(*_range("bar_local_id"), *_range("session_date"))
    return parity_summary(rows, by).join(stats, list(by))


def write_profile(profile: DataFrame, path: str, provenance: dict[str, object] | None = None) -> None:
    """Store a profile as JSON lines next to its dataset. A profile has one row per key; none is an error."""
    checked = profile
    for name, value in (provenance or {}).items():
        literal = value if isinstance(value, (str, int, float, bool)) else json.dumps(value, sort_keys=True)
        checked = checked.withColumn(name, F.lit(literal))
    if not checked.head(1):
        raise ValueError("A dataset without rows has no profile.")
    checked.write.mode("overwrite").json(path)
