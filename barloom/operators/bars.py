"""Bars from trades, session filters and N-minute families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, with_ordinal
from barloom.functions.scalars import NS_PER_MINUTE, floor_div, long, minute_of_day, minute_text, no_nan


def timeframe_minutes(timeframe: str) -> int:
    if not timeframe.endswith("m") or not timeframe[:-1].isdigit() or int(timeframe[:-1]) < 1:
        raise ValueError(f"A timeframe is written like '5m', got {timeframe!r}.")
    return int(timeframe[:-1])


def eligible_trade() -> Column:
    return (F.col("event_action") == "published") & F.col("price").isNotNull() & (F.col("size") > 0)


def bars_from_trades(
    trades: DataFrame,
    by: Sequence[str] = ("symbol",),
    minutes: int = 1,
    eligible_only: bool = True,
) -> DataFrame:
    """OHLCV per local-time bucket. Pure partial aggregation: a hot symbol is combined map-side."""
    rows = trades.where(eligible_trade()) if eligible_only else trades
    first = lambda c: F.min_by(c, "event_order")
    last = lambda c: F.max_by(c, "event_order")
    width = minutes * NS_PER_MINUTE
    bucket = floor_div(F.col("ts_local_ns"), width)
    grouped = rows.groupBy(*by, bucket.alias("bucket")).agg(
        # Plain long and double buffers keep this a hash aggregate; a struct buffer would sort the trades.
        first("ts_utc_ns").alias("ts_utc_ns"), first("session_id").alias("session_id"),
        first("session_date").alias("session_date"),
        first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        last("price").alias("close"), F.sum("size").alias("volume"), F.sum("turnover_delta").alias("turnover"),
        last("open_interest").alias("open_interest"),
    )
    return grouped.select(
        floor_div(F.col("ts_utc_ns"), NS_PER_MINUTE).alias("bar_id"), *by, F.lit(f"{minutes}m").alias("timeframe"),
        "ts_utc_ns", (F.col("bucket") * long(width)).alias("ts_local_ns"), "session_id", "session_date", "open", "high", "low", "close", "volume", "turnover", "open_interest",
    )


def minute_view_from_trades(trades: DataFrame, by: Sequence[str] = ("symbol",), minutes: int = 1) -> DataFrame:
    """B01 without the eligibility filter, in the naming of the reference minute source."""
    return minute_view(bars_from_trades(trades, by, minutes, eligible_only=False), by, minutes)


def minute_view(bars: DataFrame, by: Sequence[str] = ("symbol",), minutes: int = 1) -> DataFrame:
    """B10."""
    minute = floor_div(F.col("ts_local_ns"), NS_PER_MINUTE)
    return bars.select(
        *by, "session_date", minute.alias("minute_key"), minute_text(minute).alias("bob"),
        minute_text(minute + minutes).alias("eob"), "open", "high", "low", "close",
        F.col("turnover").alias("amount"), "volume", F.col("open_interest").alias("position"),
    )


def filter_session_profile(bars: DataFrame, session_profile: str, drop_gap: bool = False) -> DataFrame:
    """``rth`` keeps the regular hours; ``eth_full`` keeps all rows (optionally not 17:00-18:00)."""
    minute = minute_of_day(F.col("ts_local_ns"))
    if session_profile == "rth":
        return bars.where(minute.between(rules.RTH_OPEN_MINUTE, rules.RTH_CLOSE_MINUTE - 1))
    if session_profile != "eth_full":
        raise ValueError(f"Unknown session profile {session_profile!r}.")
    return bars.where(~minute.between(rules.ETH_OPEN_MINUTE - 60, rules.ETH_OPEN_MINUTE - 1)) if drop_gap else bars


def minutes_since_anchor(local_ns: Column, session_profile: str) -> Column:
    """B04."""
    minute = minute_of_day(local_ns)
    if session_profile == "rth":
        return minute - rules.RTH_OPEN_MINUTE
    evening = rules.ETH_OPEN_MINUTE
    return F.when(minute >= evening, minute - evening).otherwise(minute + (1440 - evening))


def aggregate_minutes(
    bars: DataFrame, minutes: int, session_profile: str, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Complete N-minute buckets within a session; incomplete buckets are not emitted."""
    since = minutes_since_anchor(F.col("ts_local_ns"), session_profile)
    staged = bars.withColumn("since", since).withColumn("bucket", floor_div(F.col("since"), minutes))
    first = lambda c: F.min_by(c, "bar_id").alias(c)
    grouped = staged.groupBy(*by, "session_date", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), (F.max_by("since", "bar_id") - F.min_by("since", "bar_id")).alias("width"),
        F.min("bar_id").alias("bar_id"), first("ts_utc_ns"), first("ts_local_ns"), first("session_id"), first("open"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_id").alias("close"), F.sum("volume").alias("volume"),
        F.coalesce(F.sum(no_nan(F.col("turnover"))), F.lit(0.0)).alias("turnover"),
        F.max_by("open_interest", "bar_id").alias("open_interest"),
    )
    complete = grouped.where((F.col("rows") == minutes) & (F.col("width") == minutes - 1))
    return complete.select(
        "bar_id", *by, F.lit(f"{minutes}m").alias("timeframe"), "ts_utc_ns", "ts_local_ns", "session_id",
        "session_date", "open", "high", "low", "close", "volume", "turnover", "open_interest",
    )


def derive_family(
    minute_bars: DataFrame, session_profile: str, timeframe: str, by: Sequence[str] = ("symbol",), drop_gap: bool = False
) -> DataFrame:
    """A (session profile, timeframe) view of 1-minute bars, with ``session_profile`` as a column."""
    minutes = timeframe_minutes(timeframe)
    kept = filter_session_profile(minute_bars, session_profile, drop_gap)
    family = kept if minutes == 1 else aggregate_minutes(kept, minutes, session_profile, by)
    return family.withColumn("session_profile", F.lit(session_profile))


def index_bars(
    bars: DataFrame, series: Sequence[str] = schemas.SERIES, span: int = CHUNK_ROWS
) -> DataFrame:
    """Add the dense ``bar_index`` that all bounded row frames are chunked by."""
    if "bar_index" in bars.columns:
        return bars
    return with_ordinal(bars, series, "bar_id", "bar_index", span)
