"""Replay of structure changes and bar playback inside a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import running
from barloom.functions.scalars import NS_PER_MINUTE, long
from barloom.operators import overlays as ov
from barloom.operators.bars import timeframe_minutes
from barloom.operators.lifecycle import reduce_states, states_after_each_event
from barloom.operators.windows import _ROW, events_in_window, object_visible, overlaps, window_range


def base_cursor(bars: DataFrame, window: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """The bar before the window per series, null when the window starts the series."""
    series = list(series)
    span = window_range(window, series)
    earlier = bars.join(span, series).where(F.col("bar_id") < F.col("min_bar_id"))
    last = earlier.groupBy(*series).agg(F.max("bar_id").alias("base_bar_id"))
    return span.join(last, series, "left")


def _base_rows(
    objects: DataFrame, events: DataFrame, bars: DataFrame, window: DataFrame, series: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Structures visible as of the bar before the window: from the log, and objects that the log says nothing of."""
    series = list(series)
    key = [*series, "structure_id"]
    cursor = base_cursor(bars, window, series).where(F.col("base_bar_id").isNotNull())
    seen = events.join(cursor.select(*series, "base_bar_id"), series).where(F.col("event_bar_id") <= F.col("base_bar_id"))
    live = reduce_states(seen.drop("base_bar_id"), series)
    spans = cursor.select(*series, "min_bar_id", "max_bar_id", "base_bar_id")
    near = lambda df: df.join(spans, series).where(overlaps(F.col("min_bar_id"), F.col("max_bar_id")))
    plain = near(objects).where(object_visible(F.col("base_bar_id"))).select(*series, *_ROW)
    return near(live).select(*series, *_ROW), plain.join(live.select(*key), key, "left_anti")


def replay_base(
    objects: DataFrame, events: DataFrame, bars: DataFrame, window: DataFrame, series: Sequence[str] = schemas.SERIES
) -> DataFrame:
    """Structures visible as of the bar before the window, nothing where there is no such bar."""
    live, plain = _base_rows(objects, events, bars, window, series)
    return live.unionByName(plain)


def overlay_versions(
    objects: DataFrame, events: DataFrame, bars: DataFrame, window: DataFrame, data_version: str,
    series: Sequence[str] = schemas.SERIES, structure_version: str = rules.PIVOT.structure_version,
    overlay_version: str = rules.OVERLAY_VERSION, layers: Sequence[str] | None = None, drawings: ov.Drawings | None = None,
) -> DataFrame:
    """Every overlay of the window with the event it is valid from (``from_*``) and the bar it ends at (``to_bar_id``).

    An overlay of a structure holds from one event of it to the next, a ghost from its event on. Structures that the log
    says nothing of before the window hold from the start, with ``from_bar_id`` null. ``replay_overlay_base`` and
    ``replay_deltas`` are cuts of this table, which is as long as the log of the window.

    A structure keeps its bars for life, so all its events overlap the window or none does; the state after each event
    therefore comes from the events in the window alone.
    """
    series = list(series)
    near = events_in_window(events, window, series=series)
    place = {"from_bar_id": F.col("event_bar_id"), "from_order": F.col("event_order"), "from_event_id": F.col("event_id")}
    order = Window.partitionBy(*series, "structure_id").orderBy("event_bar_id", "event_order", "event_id")
    kept = [*place, "to_bar_id"]
    after = states_after_each_event(near, series).withColumns({**place, "to_bar_id": F.lead("event_bar_id").over(order)})
    never = F.lit(None)
    plain = _base_rows(objects, events, bars, window, series)[1].withColumns(
        {"from_bar_id": never.cast("long"), "from_order": never.cast("long"), "from_event_id": never.cast("string"), "to_bar_id": never.cast("long")})
    columns = [*series, *_ROW, *kept]
    rows = after.where(F.col("state").isNotNull()).select(*columns).unionByName(plain.select(*columns))
    drawn = ov.project_structures(rows, bars, data_version, structure_version, overlay_version, series, drawings, kept)
    ghosts = ov.project_events(
        near.withColumns({**place, "to_bar_id": never.cast("long")}), bars, data_version, rules.PIVOT.rulebook_version, structure_version,
        overlay_version, series, kept)
    both = drawn.unionByName(ghosts).join(window_range(window, series), series)
    shown = ov.overlays_in_window(both, F.col("min_bar_id"), F.col("max_bar_id"), layers, drawings)
    return ov.render_keys(shown.drop("min_bar_id", "max_bar_id"), drawings)


def replay_overlay_base(versions: DataFrame, bars: DataFrame, window: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """Overlays and ghosts valid as of the bar before the window, nothing where there is no such bar.

    Of the rulebook's kinds there are none, as all their bars precede the event that makes them known; only a kind
    that reaches ahead of its events can overlap a window before it begins.
    """
    series = list(series)
    cursor = base_cursor(bars, window, series).where(F.col("base_bar_id").isNotNull()).select(*series, "base_bar_id")
    begun = F.col("from_bar_id").isNull() | (F.col("from_bar_id") <= F.col("base_bar_id"))
    lasts = F.col("to_bar_id").isNull() | (F.col("to_bar_id") > F.col("base_bar_id"))
    return versions.join(cursor, series).where(begun & lasts).drop("base_bar_id", "from_bar_id", "from_order", "from_event_id", "to_bar_id")


def replay_deltas(
    objects: DataFrame, events: DataFrame, bars: DataFrame, window: DataFrame, series: Sequence[str] = schemas.SERIES,
    overlay_version: str = rules.OVERLAY_VERSION, layers: Sequence[str] | None = None, data_version: str = "",
    drawings: ov.Drawings | None = None, versions: DataFrame | None = None,
) -> DataFrame:
    """Per event of the window what leaves the picture and what enters or changes, with the overlay rows themselves.

    ``versions`` is the table of ``overlay_versions`` where it is stored already.
    """
    series = list(series)
    key = [*series, "structure_id"]
    if versions is None:
        versions = overlay_versions(objects, events, bars, window, data_version, series, overlay_version=overlay_version, layers=layers, drawings=drawings)
    after = states_after_each_event(events_in_window(events, window, series=series), series)
    order = Window.partitionBy(*key).orderBy("event_bar_id", "event_order", "event_id")
    ghostly = F.col("meta.replay_event_type").isNotNull()
    overlay = F.struct(*[c for c in versions.columns if c not in (*series, "from_bar_id", "from_order", "from_event_id", "to_bar_id")])
    begun = versions.where(F.col("from_event_id").isNotNull()).select(*series, F.col("from_event_id").alias("event_id"), ghostly.alias("ghostly"), overlay.alias("overlay"))
    # A structure has one overlay at most after an event, and an event one ghost at most.
    entering = begun.groupBy(*series, "event_id").agg(
        F.first(F.when(~F.col("ghostly"), F.col("overlay")), ignorenulls=True).alias("now"),
        F.first(F.when(F.col("ghostly"), F.col("overlay")), ignorenulls=True).alias("ghost"))
    base = replay_base(objects, events, bars, window, series).select(*key, F.lit(True).alias("in_base"))
    at_base = replay_overlay_base(versions, bars, window, series).where(~ghostly).select(
        *series, F.col("source_structure_id").alias("structure_id"), F.col("overlay_id").alias("base_overlay_id"))
    visible = F.col("state").isNotNull()
    staged = after.join(entering, [*series, "event_id"], "left").join(base, key, "left").join(at_base, key, "left").withColumns({
        "visible": visible, "visible_before": F.lag(visible).over(order),
        "drawn_before": F.when(F.row_number().over(order) == 1, F.col("base_overlay_id")).otherwise(F.lag("now.overlay_id").over(order)),
    })
    was = F.coalesce("visible_before", "in_base", F.lit(False))
    row = F.struct(
        "structure_id", "kind", "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchor_bar_ids", "session_id",
        "session_date", "reason_codes", "explanation_codes",
    )
    return staged.select(
        *series, "event_id", "event_bar_id", "event_order", "event_type", "structure_id",
        F.when(was & ~F.col("visible"), F.col("structure_id")).alias("remove_structure_id"),
        F.when(F.col("visible"), row).alias("upsert_structure"),
        F.when(F.col("now").isNull(), F.col("drawn_before")).alias("remove_overlay_id"),
        F.array_compact(F.array("now.overlay_id", "ghost.overlay_id")).alias("upsert_overlay_ids"),
        F.array_compact(F.array("now", "ghost")).alias("upsert_overlays"),
    )


def playback_steps(
    family: DataFrame,
    window: DataFrame,
    minute_bars: DataFrame,
    timeframe: str,
    series: Sequence[str] = schemas.SERIES,
) -> DataFrame:
    """One step per bar (1m), or one per constituent minute with the partial bar so far.

    ``minute_bars`` are the 1-minute bars of the same symbol and profile. A bar that is not made of
    exactly N aligned minutes is skipped. The steps of a bar are windowed per bar, at most N rows.
    """
    series = list(series)
    minutes = timeframe_minutes(timeframe)
    shown = ["open", "high", "low", "close"]
    if minutes <= 1:
        return window.select(
            *series, F.concat(F.lit("bar:"), F.col("bar_id").cast("string")).alias("step_id"),
            F.col("bar_id").alias("source_bar_id"), F.col("ts_utc_ns").alias("source_time_ns"), "bar_id", *shown,
            F.col("bar_id").alias("as_of_bar_id"), F.lit(True).alias("closes_display_bar"),
        )
    keys = [s for s in series if s != "timeframe"]
    # Each family bar lists its N minute timestamps: an equi-join, bounded by N per bar.
    times = F.transform(
        F.sequence(F.lit(0), F.lit(minutes - 1)), lambda i: F.col("ts_utc_ns") + i.cast("long") * long(NS_PER_MINUTE)
    )
    slots = window.select(*series, "bar_id", F.posexplode(times).alias("slot", "source_time_ns"))
    source = minute_bars.select(
        *keys, F.col("ts_utc_ns").alias("source_time_ns"), F.col("bar_id").alias("source_bar_id"), *shown
    )
    bucket = Window.partitionBy(*series, "bar_id")
    so_far = bucket.orderBy("source_time_ns").rowsBetween(Window.unboundedPreceding, 0)
    steps = slots.join(source, [*keys, "source_time_ns"]).withColumns(
        {
            "found": F.count(F.lit(1)).over(bucket), "run_open": F.first("open").over(so_far),
            "run_high": F.max("high").over(so_far), "run_low": F.min("low").over(so_far),
        }
    ).where(F.col("found") == minutes)
    played = steps.groupBy(*series, "bar_id").agg(F.lit(True).alias("played"))
    closed = running(
        window.select(*series, "bar_id").join(played, [*series, "bar_id"]), series, ["bar_id"],
        {"previous_bar_id": ("max", F.col("bar_id"))}, inclusive=False,
    ).select(*series, "bar_id", "previous_bar_id")
    base = base_cursor(family, window, series).select(*series, "base_bar_id")
    closes = F.col("slot") == minutes - 1
    return steps.join(closed, [*series, "bar_id"]).join(base, series).select(
        *series, F.concat(F.lit("bar:"), F.col("source_bar_id").cast("string")).alias("step_id"), "source_bar_id",
        "source_time_ns", "bar_id", F.col("run_open").alias("open"), F.col("run_high").alias("high"),
        F.col("run_low").alias("low"), "close",
        F.when(closes, F.col("bar_id")).otherwise(F.coalesce("previous_bar_id", "base_bar_id")).alias("as_of_bar_id"),
        closes.alias("closes_display_bar"),
    )
