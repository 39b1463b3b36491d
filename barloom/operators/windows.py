"""Window reads: bar windows, visible structures and events, structure detail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions.scalars import NS_PER_SECOND, long
from barloom.operators.bars import index_bars
from barloom.operators.lifecycle import position, reduce_states, visible_events

_ROW = (
    "structure_id", "kind", "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "session_id", "session_date",
    "anchor_bar_ids", "explanation_codes",
)

# The datasets that the structures of a kind were built from.
STRUCTURE_REFS = {"leg_up": ["pivot"], "leg_down": ["pivot"], "major_lh": ["leg"]}


def structure_rows(df: DataFrame, series: Sequence[str], payload: T.DataType) -> DataFrame:
    """Structure rows with links and payload; rows of an object dataset carry neither, so they are null there."""
    extra = {"predecessor_structure_id": T.StringType(), "successor_structure_id": T.StringType(), "payload": payload}
    return df.select(*series, *_ROW, *[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in extra.items()])


@dataclass(frozen=True)
class WindowSpec:
    """Exactly one selector: a center bar, a session, or a time range in seconds."""

    center_bar_id: int | None = None
    session_date: int | None = None
    start_time: int | None = None
    end_time: int | None = None
    left_bars: int = 0
    right_bars: int = 0
    buffer_bars: int = 0

    def __post_init__(self) -> None:
        timed = self.start_time is not None or self.end_time is not None
        if timed and (self.start_time is None or self.end_time is None):
            raise ValueError("A time window needs both start_time and end_time.")
        if (self.center_bar_id is not None) + (self.session_date is not None) + timed > 1:
            raise ValueError("Give one selector only.")
        if timed and self.start_time > self.end_time:
            raise ValueError("start_time must not be after end_time.")
        if min(self.left_bars, self.right_bars, self.buffer_bars) < 0:
            raise ValueError("Bar counts must not be negative.")


def window_bounds(bars: DataFrame, spec: WindowSpec, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """First and last ``bar_index`` of the window, one row per series that has the selected bars.

    ``bars`` carries ``bar_index``; the bounds are one aggregate, no global ordering.
    """
    at = F.col("bar_index")
    if spec.center_bar_id is not None:
        hit, left, right = F.col("bar_id") == spec.center_bar_id, spec.left_bars, spec.right_bars
    elif spec.session_date is not None:
        hit, left, right = F.col("session_date") == spec.session_date, spec.left_bars, spec.right_bars
    elif spec.start_time is not None:
        hit = F.col("ts_utc_ns").between(long(spec.start_time * NS_PER_SECOND), long(spec.end_time * NS_PER_SECOND))
        left = right = 0
    else:
        hit, left, right = F.lit(True), 0, 0
    pad = spec.buffer_bars
    return bars.where(hit).groupBy(*series).agg(
        (F.min(at) - left - pad).alias("from_index"), (F.max(at) + right + pad).alias("to_index")
    )


def select_window(bars: DataFrame, spec: WindowSpec, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """The window's bars. The bounds table has one row per series; AQE decides how to join it."""
    indexed = index_bars(bars, series)
    bounds = window_bounds(indexed, spec, series)
    return (
        indexed.join(bounds, list(series))
        .where(F.col("bar_index").between(F.col("from_index"), F.col("to_index")))
        .drop("from_index", "to_index")
    )


def window_range(window: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    return window.groupBy(*series).agg(F.min("bar_id").alias("min_bar_id"), F.max("bar_id").alias("max_bar_id"))


def overlaps(min_bar_id: Column | int, max_bar_id: Column | int) -> Column:
    return (F.coalesce("end_bar_id", "start_bar_id") >= min_bar_id) & (F.col("start_bar_id") <= max_bar_id)


def object_visible(as_of: Column | int) -> Column:
    """W04."""
    known = F.coalesce("confirm_bar_id", "start_bar_id")
    return (F.col("start_bar_id") <= as_of) & (
        (F.col("state") == "candidate") | ((F.col("state") == "confirmed") & (known <= as_of))
    )


def in_window(df: DataFrame, window: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """Objects or events that overlap the window of their series."""
    return (
        df.join(window_range(window, series), list(series))
        .where(overlaps(F.col("min_bar_id"), F.col("max_bar_id")))
        .drop("min_bar_id", "max_bar_id")
    )


def structures_in_window(
    objects: DataFrame,
    events: DataFrame,
    window: DataFrame,
    as_of_bar_id: int | None = None,
    as_of_event_id: str | None = None,
    series: Sequence[str] = schemas.SERIES,
) -> DataFrame:
    """Structures visible at the cursor. Rows from the event log win over object rows."""
    series = list(series)
    key = [*series, "structure_id"]
    payload = events.schema["payload_after"].dataType
    near = structure_rows(in_window(objects, window, series), series, payload)
    if as_of_bar_id is None and as_of_event_id is None:
        return near.where(F.col("state") != "invalidated")
    # A structure keeps its bars for life, so the log is cut to the window before it is reduced, and reduced once.
    seen = in_window(visible_events(events, as_of_bar_id, as_of_event_id, series), window, series)
    if as_of_event_id is not None:
        cursor = events.where(F.col("event_id") == as_of_event_id).groupBy(*series).agg(
            F.min("event_bar_id").alias("cursor")
        )
        others = near.join(in_window(events, window, series).select(*key).distinct(), key, "left_anti")
        shown = others.join(cursor, series).where(object_visible(F.col("cursor"))).drop("cursor")
    else:
        shown = near.where(object_visible(as_of_bar_id))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*[c for c in df.columns if c not in series]).alias(name))

    live = structure_rows(reduce_states(seen, series), series, payload)
    both = side(live, "live").join(side(shown.select(*live.columns), "object"), key, "full_outer")
    return both.select(*series, F.coalesce("live", "object").alias("row")).select(*series, "row.*")


def events_in_window(
    events: DataFrame,
    window: DataFrame,
    as_of_bar_id: int | None = None,
    as_of_event_id: str | None = None,
    series: Sequence[str] = schemas.SERIES,
) -> DataFrame:
    """W05."""
    seen = (
        events if as_of_bar_id is None and as_of_event_id is None
        else visible_events(events, as_of_bar_id, as_of_event_id, series)
    )
    return in_window(seen, window, series)


def structure_detail(
    structure_ids: DataFrame,
    objects: DataFrame,
    events: DataFrame,
    bars: DataFrame,
    as_of_bar_id: int | None = None,
    as_of_event_id: str | None = None,
    series: Sequence[str] = schemas.SERIES,
) -> DataFrame:
    """The asked structures at the cursor with their anchor bars and confirm bar.

    ``structure_ids`` holds (series, structure_id). Hidden or unknown ids are absent from the result.
    """
    series = list(series)
    key = [*series, "structure_id"]
    own_events = events.join(structure_ids, key, "left_semi")
    own_objects = objects.join(structure_ids, key, "left_semi")
    if as_of_bar_id is None and as_of_event_id is None:
        live = reduce_states(own_events, series)
        fallback = own_objects.join(live.select(*key), key, "left_anti")
    else:
        # The event cursor may belong to another structure, so it is found in the whole log.
        if as_of_event_id is not None:
            cursor = events.where(F.col("event_id") == as_of_event_id).groupBy(*series).agg(
                F.min(position()).alias("cursor")
            )
            seen = own_events.join(cursor, series).where(position() <= F.col("cursor")).drop("cursor")
            bound = cursor.select(*series, F.col("cursor.event_bar_id").alias("as_of"))
        else:
            seen = own_events.where(F.col("event_bar_id") <= as_of_bar_id)
            bound = None
        live = reduce_states(seen, series)
        plain = own_objects.join(events.select(*key).distinct(), key, "left_anti")
        fallback = (
            plain.where(object_visible(as_of_bar_id)) if bound is None
            else plain.join(bound, series).where(object_visible(F.col("as_of"))).drop("as_of")
        )
    payload = events.schema["payload_after"].dataType
    rows = structure_rows(live, series, payload).unionByName(structure_rows(fallback, series, payload))
    built_from = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, v))) for k, v in STRUCTURE_REFS.items()], F.array().cast("array<string>"))
    rows = rows.withColumn("structure_refs", built_from)
    bar = F.struct("bar_id", "ts_utc_ns", "session_id", "session_date", "open", "high", "low", "close")
    at = bars.select(*series, F.col("bar_id").alias("anchor"), bar.alias("bar"))
    refs = own_objects.select(*key, "feature_refs", "rulebook_version")
    anchors = rows.select(*key, F.posexplode("anchor_bar_ids").alias("n", "anchor")).join(at, [*series, "anchor"])
    # At most three anchors per structure.
    anchors = anchors.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "bar"))), lambda x: x["bar"]).alias("anchor_bars")
    )
    confirm = bars.select(*series, F.col("bar_id").alias("confirm_bar_id"), bar.alias("confirm_bar"))
    return (
        rows.join(anchors, key, "left").join(confirm, [*series, "confirm_bar_id"], "left").join(refs, key, "left")
    )


def widen_for_anchors(
    bars: DataFrame, window: DataFrame, structures: DataFrame, series: Sequence[str] = schemas.SERIES
) -> DataFrame:
    """Bars out to the first and last anchor of the given structures."""
    series = list(series)
    reach = structures.groupBy(*series).agg(
        F.min(F.array_min("anchor_bar_ids")).alias("anchor_min"), F.max(F.array_max("anchor_bar_ids")).alias("anchor_max")
    )
    bounds = window_range(window, series).join(reach, series, "left").select(
        *series, F.least("min_bar_id", "anchor_min").alias("lo"), F.greatest("max_bar_id", "anchor_max").alias("hi")
    )
    return bars.join(bounds, series).where(F.col("bar_id").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def add_missing_anchor_bars(
    bars: DataFrame, window: DataFrame, structures: DataFrame, series: Sequence[str] = schemas.SERIES
) -> DataFrame:
    """The window plus the single bars that structures anchor on outside it."""
    series = list(series)
    wanted = structures.select(*series, F.explode("anchor_bar_ids").alias("bar_id")).distinct()
    missing = wanted.join(window.select(*series, "bar_id"), [*series, "bar_id"], "left_anti")
    return window.unionByName(bars.join(missing, [*series, "bar_id"], "left_semi").select(*window.columns))
