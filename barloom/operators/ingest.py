"""Raw rows to canonical bars and trades, and the checks that guard them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, drop_halo, running, spread_halo
from barloom.functions.scalars import (
    NS_PER_DAY, NS_PER_MINUTE, NS_PER_SECOND, days_of, floor_div, local_to_utc_ns, long, session_date_of,
    wall_clock_ns,
)


def canonical_minute_bars(raw: DataFrame, timeframe: str = "1m") -> DataFrame:
    """Raw minute rows to bars; the session rolls at 18:00 local."""
    utc = wall_clock_ns(F.col("ts_event"))
    local = wall_clock_ns(F.col("ET_datetime"))
    session = session_date_of(local, rules.SESSION_ROLL_HOURS)
    return raw.select(
        floor_div(utc, NS_PER_MINUTE).alias("bar_id"), "symbol", F.lit(timeframe).alias("timeframe"),
        utc.alias("ts_utc_ns"), local.alias("ts_local_ns"), session.alias("session_id"),
        session.alias("session_date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.lit(float("nan")).alias("turnover"), F.lit(float("nan")).alias("open_interest"),
    )


def raw_minute_problems(raw: DataFrame, expected_symbol: str | None = None) -> DataFrame:
    """One row of counts; every count must be zero except ``row_count``."""
    missing = [c for c in schemas.RAW_MINUTE.fieldNames() if c not in raw.columns]
    if missing:
        raise ValueError(f"Raw minute rows lack columns: {missing}")
    null_count = sum(
        (F.count_if(F.col(c).isNull()) for c in schemas.RAW_MINUTE.fieldNames()), long(0)
    )
    foreign = F.count_if(F.col("symbol") != F.lit(expected_symbol)) if expected_symbol else long(0)
    return raw.agg(
        F.count(F.lit(1)).alias("row_count"), null_count.alias("null_values"),
        F.greatest(F.count_distinct("symbol") - 1, long(0)).alias("extra_symbols") if not expected_symbol
        else foreign.alias("extra_symbols"),
    )


def misaligned_rows(bars: DataFrame) -> DataFrame:
    """Rows whose UTC timestamp is not on a minute boundary."""
    return bars.where(F.pmod("ts_utc_ns", long(NS_PER_MINUTE)) != 0)


def require_aligned(bars: DataFrame) -> DataFrame:
    """N04 inside a job: the first row off the minute fails it."""
    off = F.pmod("ts_utc_ns", long(NS_PER_MINUTE)) != 0
    return bars.where(F.when(off, F.raise_error(F.lit("Minute bars are not aligned to the minute.")).cast("boolean")).otherwise(F.lit(True)))


def series_violations(bars: DataFrame, series: Sequence[str] = schemas.SERIES, rows: int = CHUNK_ROWS) -> DataFrame:
    """Counts per series of duplicate ids, session dates that go back, and NaN prices."""
    series = list(series)
    prices = ("open", "high", "low", "close")
    bad_price = F.lit(False)
    for c in prices:
        bad_price = bad_price | F.isnan(c) | F.col(c).isNull()
    per_id = bars.groupBy(*series, "bar_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("session_date").alias("low_session"),
        F.max("session_date").alias("high_session"), F.count_if(bad_price).alias("bad_prices"),
    )
    seen = running(per_id, series, ["bar_id"], {"top_session": ("max", F.col("high_session"))}, inclusive=False)
    return seen.groupBy(*series).agg(
        F.sum(F.when(F.col("copies") > 1, F.col("copies") - 1).otherwise(0)).alias("duplicate_bar_ids"),
        F.count_if(F.col("low_session") < F.col("top_session")).alias("sessions_going_back"),
        F.sum("bad_prices").alias("nan_prices"),
    )


def require_clean(violations: DataFrame, *counts: str) -> DataFrame:
    """Raise inside the job when any of the count columns is not zero."""
    broken = F.lit(False)
    for c in counts:
        broken = broken | (F.col(c) > 0)
    return violations.where(
        F.when(broken, F.raise_error(F.concat(F.lit("Data check failed: "), F.to_json(F.struct(*counts))))
               .cast("boolean")).otherwise(F.lit(True))
    )


def cumulative_delta(current: Column, previous: Column) -> Column:
    """Difference of a cumulative counter; the first row and a reset give the counter itself."""
    return F.when(previous.isNull() | (current < previous), current).otherwise(current - previous)


def tick_deltas(ticks: DataFrame, keys: Sequence[str] = ("symbol", "TradingDay"), rows: int = CHUNK_ROWS) -> DataFrame:
    """N06 on raw ticks with a dense 1-based ``row_no`` per key: adds ``size`` and ``turnover_delta``."""
    spread, w = spread_halo(ticks, keys, "row_no", before=1, after=0, rows=rows)
    out = spread.withColumns(
        {
            "size": cumulative_delta(F.col("Volume"), F.lag("Volume").over(w)),
            "turnover_delta": cumulative_delta(F.col("Turnover"), F.lag("Turnover").over(w)),
        }
    )
    return drop_halo(out, "row_no", rows)


def is_trade(price: Column, size: Column) -> Column:
    """N07."""
    return price.isNotNull() & (size > 0)


def exchange_local_ns(trading_day: Column, update_time: Column, millisec: Column) -> Column:
    """Evening rows belong to the calendar day before the trading day."""
    evening = F.substring(update_time, 1, 2).cast("long") >= rules.EVENING_HOUR
    day = days_of(trading_day) - F.when(evening, long(1)).otherwise(long(0))
    seconds = (
        F.substring(update_time, 1, 2).cast("long") * 3600
        + F.substring(update_time, 4, 2).cast("long") * 60
        + F.substring(update_time, 7, 2).cast("long")
    )
    return day * long(NS_PER_DAY) + seconds * long(NS_PER_SECOND) + millisec * long(1_000_000)


def trades_from_ticks(
    ticks: DataFrame,
    exchange: str,
    zone: str = "Asia/Shanghai",
    keys: Sequence[str] = ("symbol", "TradingDay"),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Raw ticks with ``symbol`` (the file stem) and ``row_no`` to normalised trades."""
    local = exchange_local_ns(F.col("TradingDay"), F.col("UpdateTime"), F.col("UpdateMillisec"))
    ref = F.concat_ws(
        "|", F.col("TradingDay").cast("string"), "symbol", "UpdateTime",
        F.col("UpdateMillisec").cast("string"), F.col("row_no").cast("string"),
    )
    kept = tick_deltas(ticks, keys, rows).where(is_trade(F.col("LastPrice"), F.col("size")))
    staged = kept.withColumns({"ts_local_ns": local, "source_event_ref": ref})
    return staged.select(
        F.sha2(F.concat(F.col("symbol"), F.lit(".csv|"), F.col("source_event_ref")), 256).alias("event_id"),
        F.col("row_no").alias("event_order"), "symbol", F.col("symbol").alias("instrument_id"),
        F.lit(exchange).alias("exchange"), local_to_utc_ns(F.col("ts_local_ns"), zone).alias("ts_utc_ns"),
        "ts_local_ns", F.col("TradingDay").alias("session_id"), F.col("TradingDay").alias("session_date"),
        F.lit("published").alias("event_action"), "source_event_ref", F.col("LastPrice").alias("price"), "size",
        "turnover_delta", F.col("OpenInterest").alias("open_interest"), F.col("BidPrice1").alias("bid_price_1"),
        F.col("BidVolume1").alias("bid_size_1"), F.col("AskPrice1").alias("ask_price_1"),
        F.col("AskVolume1").alias("ask_size_1"),
    )


def _foreign() -> Column:
    return (F.trim("InstrumentID") != "") & (F.col("InstrumentID") != F.col("symbol"))


def foreign_instruments(ticks: DataFrame) -> DataFrame:
    """Rows whose non-blank InstrumentID is not the symbol of their file."""
    return ticks.where(_foreign())


def require_own_instrument(ticks: DataFrame) -> DataFrame:
    """N10 inside a job: the first foreign row fails it, without a pass of its own."""
    message = F.concat(F.lit("A tick file holds rows of another instrument: "), F.col("InstrumentID"))
    return ticks.where(F.when(_foreign(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
