"""Front-contract choice and the stitched continuous series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import floor_div

_CONTRACT = r"^([A-Za-z]+)(\d{4})$"


def contract_root(symbol: Column) -> Column:
    """Lower-case root of ``<letters><yymm>``, null for any other symbol."""
    return F.when(symbol.rlike(_CONTRACT), F.lower(F.regexp_extract(symbol, _CONTRACT, 1)))


def contract_month(symbol: Column) -> Column:
    return F.when(symbol.rlike(_CONTRACT), F.regexp_extract(symbol, _CONTRACT, 2).cast("long"))


def component_bars(bars: DataFrame, root: str, timeframe: str = "1m") -> DataFrame:
    """Contract bars of one root and timeframe."""
    return bars.where((contract_root(F.col("symbol")) == root.lower()) & (F.col("timeframe") == timeframe))


def contract_session_stats(bars: DataFrame) -> DataFrame:
    """C01."""
    root = contract_root(F.col("symbol"))
    return bars.where(root.isNotNull()).groupBy(root.alias("root"), "session_date", "symbol").agg(
        F.max_by("open_interest", "ts_utc_ns").alias("final_open_interest"), F.sum("volume").alias("total_volume"),
        F.min_by("open_interest", "ts_utc_ns").alias("first_open_interest"),
    )


def selection_stats(stats: DataFrame) -> DataFrame:
    """What was known before the session opened. One row per contract and session, so plain windows."""
    w = Window.partitionBy("root", "symbol").orderBy("session_date")
    return stats.select(
        "root", "session_date", "symbol",
        F.coalesce(F.lag("final_open_interest").over(w), "first_open_interest").alias("selection_open_interest"),
        F.coalesce(F.lag("total_volume").over(w), F.lit(0.0)).alias("selection_volume"),
    )


def month_distance(session_date: Column, month: Column, month_rank: str = "documented") -> Column:
    """Months to expiry, expired contracts last. ``as_coded`` compares yymm with yyyymm."""
    if month_rank not in ("documented", "as_coded"):
        raise ValueError(f"Unknown month_rank {month_rank!r}.")
    now = floor_div(session_date, 100)
    due = month + 200000 if month_rank == "documented" else month
    return F.when(due >= now, due - now).otherwise(now - due + 10000)


def select_front_contracts(bars: DataFrame, month_rank: str = "documented") -> DataFrame:
    """Per root and session the contract with the largest (open interest, volume, nearness, symbol).

    The ranking is a ``max_by`` aggregate, so it combines map-side.
    """
    stats = selection_stats(contract_session_stats(bars))
    rank = F.struct(
        "selection_open_interest", "selection_volume",
        (-month_distance(F.col("session_date"), contract_month(F.col("symbol")), month_rank)).alias("near"),
        "symbol",
    )
    return stats.groupBy("root", "session_date").agg(F.max(rank).alias("best")).select(
        "root", "session_date", F.col("best.symbol").alias("selected_symbol"),
        F.col("best.selection_open_interest"), F.col("best.selection_volume"),
    )


def stitch_continuous(bars: DataFrame, selections: DataFrame) -> DataFrame:
    """The chosen contract's bars per session. AQE broadcasts the selections only while they are small."""
    chosen = selections.select("root", "session_date", F.col("selected_symbol").alias("symbol"))
    return (
        bars.join(chosen, ["session_date", "symbol"])
        .withColumn("symbol", F.concat("root", F.lit(".v.0")))
        .select(*bars.columns)
    )
