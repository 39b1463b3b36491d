"""Small stored indexes that tell which part of a dataset a read needs, before any of it is opened.

The session index holds the bar counts of a family per session with their running total: the first and last session of a
window follow from it, so only those sessions are derived. The extent index holds, per dataset, kind, symbol, year and
stretch of the order column, the smallest start and the largest end: what overlaps a window lies in the years and
stretches whose extent does, as in an interval list. Both grow with sessions and stretches, not with rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.ordered import chunk_of, running
from barloom.functions.scalars import NS_PER_SECOND, long
from barloom.operators.bars import derive_family
from barloom.operators.windows import WindowSpec
from barloom.sources.datasets import ORDER, ORDER_SPAN, year_of

FAMILY = ("session_profile", "timeframe")


def session_counts(minute_bars: DataFrame, families: Sequence[tuple[str, str]], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars per session of each (profile, timeframe) with the number of bars before the session.

    Only times are read: the prices of the derived bars are pruned. Sessions must follow each other in bar ids, as a
    running total over sessions is a place in the series only then; sessions that interleave are an error.
    """
    counted = None
    for session_profile, timeframe in families:
        family = derive_family(minute_bars, session_profile, timeframe, by)
        one = family.groupBy(*by, "session_date").agg(
            F.count(F.lit(1)).alias("bars"), F.min("bar_id").alias("first_bar_id"), F.max("bar_id").alias("last_bar_id"),
            F.min("ts_utc_ns").alias("first_ts_ns"), F.max("ts_utc_ns").alias("last_ts_ns"),
        ).withColumns({"session_profile": F.lit(session_profile), "timeframe": F.lit(timeframe)})
        counted = one if counted is None else counted.unionByName(one)
    totals = {"bars_before": ("sum", F.col("bars")), "__end": ("max", F.col("last_bar_id"))}
    # Dates are yyyymmdd, so a chunk is a year.
    placed = running(counted, [*by, *FAMILY], ["session_date"], totals, inclusive=False, span=10_000)
    mixed = F.raise_error(F.concat(F.lit("Sessions interleave at "), F.col("session_date").cast("string"))).cast("long")
    apart = F.col("__end").isNull() | (F.col("__end") < F.col("first_bar_id"))
    return placed.withColumn("bars_before", F.when(apart, F.coalesce("bars_before", long(0))).otherwise(mixed)).drop("__end")


@dataclass(frozen=True)
class SessionSpan:
    """The sessions that a window lies in, and how many bars the series has before them."""

    first_session: int
    last_session: int
    bars_before: int

    @property
    def years(self) -> range:
        return range(self.first_session // 10_000, self.last_session // 10_000 + 1)


def window_sessions(index: DataFrame, spec: WindowSpec) -> SessionSpan | None:
    """The sessions of one series that hold the window, from its rows of the session index; None if it has none.

    A session that may hold the selected bars counts as selected as a whole, so the span is never too short.
    """
    before, after = F.col("bars_before"), F.col("bars_before") + F.col("bars") - 1
    left, right = spec.left_bars, spec.right_bars
    if spec.center_bar_id is not None:
        hit = (F.col("first_bar_id") <= spec.center_bar_id) & (F.col("last_bar_id") >= spec.center_bar_id)
    elif spec.session_date is not None:
        hit = F.col("session_date") == spec.session_date
    else:
        left = right = 0
        hit = F.lit(True) if spec.start_time is None else (
            (F.col("first_ts_ns") <= long(spec.end_time * NS_PER_SECOND)) & (F.col("last_ts_ns") >= long(spec.start_time * NS_PER_SECOND)))
    low, high = index.where(hit).agg(F.min(before) - left - spec.buffer_bars, F.max(after) + right + spec.buffer_bars).first()
    if low is None:
        return None
    inside = index.where((after >= low) & (before <= high))
    return SessionSpan(*inside.agg(F.min("session_date"), F.max("session_date"), F.min(before)).first())


EXTENT = (
    "part", "kind_group", "symbol", "year", "stretch", "rows", "low", "high", "low_index", "high_index", "low_ts_ns", "high_ts_ns", "low_session",
    "high_session",
)


def extents(df: DataFrame, part: str, kind_group: str = "", span: int = ORDER_SPAN) -> DataFrame:
    """The extent rows of one dataset. ``low`` and ``high`` are bar ids: of the bars themselves, or start and end of objects and events."""
    order = ORDER[part][0]
    low, high = ("bar_id", F.col("bar_id")) if part == "bars" else ("start_bar_id", F.coalesce("end_bar_id", "start_bar_id"))
    extra = {f"{side}_{name}": pick(column) if part == "bars" else F.max(F.lit(None).cast("long"))
             for side, pick in (("low", F.min), ("high", F.max)) for name, column in (("index", "bar_index"), ("ts_ns", "ts_utc_ns"))}
    found = df.groupBy("symbol", year_of(F.col("session_date")).alias("year"), chunk_of(F.col(order), span).alias("stretch")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(low).alias("low"), F.max(high).alias("high"), F.min("session_date").alias("low_session"),
        F.max("session_date").alias("high_session"), *[c.alias(n) for n, c in extra.items()])
    return found.withColumns({"part": F.lit(part), "kind_group": F.lit(kind_group)}).select(*EXTENT)


def selected(spec: WindowSpec) -> Column:
    """Whether an extent of bars can hold the bars that a window is selected by."""
    if spec.center_bar_id is not None:
        return (F.col("low") <= spec.center_bar_id) & (F.col("high") >= spec.center_bar_id)
    if spec.session_date is not None:
        return (F.col("low_session") <= spec.session_date) & (F.col("high_session") >= spec.session_date)
    if spec.start_time is not None:
        return (F.col("low_ts_ns") <= long(spec.end_time * NS_PER_SECOND)) & (F.col("high_ts_ns") >= long(spec.start_time * NS_PER_SECOND))
    return F.lit(True)


def meets(low: int, high: int, column: str = "") -> Column:
    """Whether an extent overlaps the bar ids, or with ``column`` 'index' the bar indexes, from ``low`` to ``high``."""
    tail = f"_{column}" if column else ""
    return (F.col(f"low{tail}") <= high) & (F.col(f"high{tail}") >= low)


def places(found: DataFrame, span: int = ORDER_SPAN) -> dict[tuple[str, str], Column]:
    """Per (part, kind) of the given extents a filter with literal years and the order column's range; one small read.

    A dataset without a row here has nothing to read. The years of a dataset are a small set by nature.
    """
    rows = found.groupBy("part", "kind_group").agg(F.collect_set("year").alias("years"), F.min("stretch").alias("a"), F.max("stretch").alias("z"))
    return {
        (r.part, r.kind_group): F.col("year").isin(*sorted(r.years)) & F.col(ORDER[r.part][0]).between(r.a, r.z + span - 1)
        for r in rows.collect()
    }
