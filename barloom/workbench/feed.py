"""Market data derived from the given ``events`` table, the same way in Spark and in the oracle SQL.

``events`` is read as a feed: event type = symbol, value = price, ``props.k`` = traded size, event id
= arrival order.

* ``ticks`` - raw ticks per (symbol, trading day) with cumulative volume and turnover.
* ``trades`` - ticks normalised (N06-N09).
* ``dense_trades`` / ``dense_bars`` - four events per minute from 14:00 local on, every 97th minute
  empty, so that bars have real ranges, sessions change and some families are incomplete.
* ``hour_bars`` - trades per local hour.
* ``contract_bars`` - four-event bars of three contract months. ``reference_minutes`` - hour bars
  with some rows missing and some values changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ordered import running
from barloom.functions.scalars import NS_PER_DAY, NS_PER_MINUTE, NS_PER_SECOND, floor_div, local_to_utc_ns, long, minute_text, yyyymmdd
from barloom.operators import bars as b
from barloom.operators import ingest
from barloom.session import cut_lineage

ZONE = "Asia/Shanghai"
EXCHANGE = "SHFE"
DENSE_START_NS = 1_704_117_600 * NS_PER_SECOND  # 2024-01-01 14:00 wall clock
SERIES = ["symbol", "session_profile", "timeframe"]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall-clock micros, size and price in cents next to the event columns."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("symbol"), "value", micros.alias("micros"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir)
    ms = floor_div(F.col("micros"), 1000)
    of_day = F.pmod(ms, long(86_400_000))
    second = floor_div(of_day, 1000)
    day = yyyymmdd(floor_div(ms + 6 * 3_600_000, 86_400_000))
    staged = e.select(
        "event_id", "symbol", "value", "k", "cents", day.alias("TradingDay"),
        F.format_string(
            "%02d:%02d:%02d", floor_div(second, 3600), floor_div(F.pmod(second, long(3600)), 60), F.pmod(second, long(60))
        ).alias("UpdateTime"),
        F.pmod(of_day, long(1000)).alias("UpdateMillisec"),
    )
    keyed = running(
        staged, ["symbol", "TradingDay"], ["event_id"],
        {
            "row_no": ("count", F.lit(1)), "volume": ("sum", F.col("k")), "turnover": ("sum", F.col("k") * F.col("cents")),
            "oi": ("sum", F.col("k") - 49),
        },
    )
    return keyed.select(
        "TradingDay", F.col("symbol").alias("InstrumentID"), "UpdateTime", "UpdateMillisec",
        F.when(F.pmod("event_id", long(53)) != 0, F.col("value")).alias("LastPrice"),
        F.col("volume").cast("double").alias("Volume"), (F.col("value") - 0.5).alias("BidPrice1"),
        F.lit(1.0).alias("BidVolume1"), (F.col("value") + 0.5).alias("AskPrice1"), F.lit(2.0).alias("AskVolume1"),
        F.col("value").alias("AveragePrice"), F.col("turnover").cast("double").alias("Turnover"),
        (F.col("oi") + 10000).cast("double").alias("OpenInterest"), "symbol", "row_no",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.trades_from_ticks(ticks(spark, sf_dir), EXCHANGE, ZONE)


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bars_from_trades(trades(spark, sf_dir), minutes=60).withColumn("session_profile", F.lit("eth_full"))


def _spread_over_minutes(keyed: DataFrame, place: str) -> DataFrame:
    """Trades four to a minute by their place in the series, leaving out every 97th minute."""
    n = F.col(place) - 1
    minute = floor_div(n, 4)
    local = (
        long(DENSE_START_NS) + (minute + floor_div(minute, 96)) * long(NS_PER_MINUTE)
        + F.pmod(n, long(4)) * long(15 * NS_PER_SECOND)
    )
    session = yyyymmdd(floor_div(local + long(6 * 3600 * NS_PER_SECOND), NS_PER_DAY))
    size = (F.col("k") + 1).cast("double")
    return keyed.withColumn("ts_local_ns", local).select(
        F.col(place).alias("event_order"), "symbol", local_to_utc_ns(F.col("ts_local_ns"), ZONE).alias("ts_utc_ns"),
        "ts_local_ns", session.alias("session_id"), session.alias("session_date"),
        F.lit("published").alias("event_action"), F.col("value").alias("price"), size.alias("size"),
        (size * F.col("cents")).alias("turnover_delta"),
        (F.col("oi") + 10000).cast("double").alias("open_interest"),
    )


def _placed(e: DataFrame) -> DataFrame:
    return running(
        e.select("symbol", "event_id", "value", "k", "cents"), ["symbol"], ["event_id"],
        {"place": ("count", F.lit(1)), "oi": ("sum", F.col("k") - 49)},
    )


def dense_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_over_minutes(_placed(raw_events(spark, sf_dir)), "place")


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-minute bars with ``session_profile``; the input of most structure queries."""
    return b.bars_from_trades(dense_trades(spark, sf_dir)).withColumn("session_profile", F.lit("eth_full"))


def contract_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir)
    month = F.element_at(F.array(*[F.lit(s) for s in ("ag2405", "ag2406", "ag2407")]), (F.pmod("user_id", long(3)) + 1).cast("int"))
    return b.bars_from_trades(_spread_over_minutes(_placed(e.withColumn("symbol", month)), "place"))


def hour_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour bars in the naming of the reference source, stored once: both sides of a comparison read it."""
    return cut_lineage(b.minute_view(b.bars_from_trades(trades(spark, sf_dir), minutes=60), minutes=60))


def reference_minutes(view: DataFrame) -> DataFrame:
    """The second source: the hour view with every 7th hour missing and every 5th hour's volume changed."""
    hour = floor_div(F.col("minute_key"), 60)
    return view.where(F.pmod(hour, long(7)) != 0).withColumns(
        {
            "volume": F.col("volume") + F.when(F.pmod(hour, long(5)) == 0, 3.0).otherwise(0.0),
            "close": F.col("close") + F.when(F.pmod(hour, long(11)) == 0, 0.25).otherwise(0.0),
            "session_date": yyyymmdd(floor_div(F.col("minute_key"), 1440)),
        }
    )
