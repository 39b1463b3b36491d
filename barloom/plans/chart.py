"""The chart window: one read that answers bars, lines, structures, events, overlays, replay and playback."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.operators import features, overlays, replay, windows
from barloom.plans import indexes
from barloom.plans.chain import StructureChain, union_all, widen_events
from barloom.session import cut_lineage


PARTS = ("bars", "structures", "events", "overlays", "ema_lines", "replay_base", "replay_overlays", "replay_deltas", "playback")


@dataclass(frozen=True)
class ChartRequest:
    """What a chart asks for. ``parts`` names the parts of the answer to build, none: all that the other fields ask for."""

    window: windows.WindowSpec
    as_of_bar_id: int | None = None
    as_of_event_id: str | None = None
    layers: tuple[str, ...] = ()
    ema_lengths: tuple[int, ...] = ()
    include_replay: bool = False
    seed: str = "window"
    drawings: overlays.Drawings = field(default_factory=dict)
    parts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if unknown := sorted({*self.parts} - {*PARTS}):
            raise ValueError(f"Unknown chart parts {unknown}.")

    def wants(self, *names: str) -> bool:
        return not self.parts or any(n in self.parts for n in names)


def ema_lines(
    bars: DataFrame, window: DataFrame, lengths: Sequence[int], seed: str = "window", series: Sequence[str] = schemas.SERIES
) -> DataFrame:
    """EMA values of the window's bars, seeded at its first bar or at the start of the history."""
    if seed not in ("window", "history"):
        raise ValueError(f"Unknown seed {seed!r}.")
    if seed == "window":
        source = window.drop("bar_index")
        return features.ema(source, lengths, series).drop("bar_index")
    lines = features.ema(bars, lengths, series).drop("bar_index")
    return lines.join(window.select(*series, "bar_id"), [*series, "bar_id"], "left_semi")


def chart_window(
    chain: StructureChain,
    minute_bars: DataFrame,
    timeframe: str,
    request: ChartRequest,
    data_version: str,
    series: Sequence[str] = schemas.SERIES,
) -> dict[str, DataFrame]:
    """W10 over a chain in memory. Its log and objects are stored first, as several parts read them; the parts themselves
    are lazy. For stored datasets use ``stored_chart_window``, which reads the window's part of them only."""
    return _parts(
        chain.bars, cut_lineage(chain.all_objects()), cut_lineage(chain.all_events()), minute_bars, timeframe, request, data_version, list(series)
    )


def stored_inputs(
    spark: SparkSession, root: str, window: windows.WindowSpec, symbols: Sequence[str] = (), kinds: Sequence[str] | None = None,
    series: Sequence[str] = schemas.SERIES, from_start: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, objects and events of a ``structure_job`` folder that a chart of the window can need.

    The window becomes literal filters on symbol, year, bar index and bar ids, so partitions and row groups are pruned.
    The chart shows bars out to the anchors of what overlaps the window; objects and events overlap those bars, as replay
    plays over them, and bars reach out to their anchors and one further, where replay starts. With ``from_start`` bars
    begin with the series. Years and stretches come from the stored extents; folders outside them are never opened.
    ``kinds`` are all stored ones unless given. A selector that no series has is a ``KeyError``.
    """
    def only(df: DataFrame) -> DataFrame:
        return df.where(F.col("symbol").isin(*symbols)) if symbols else df

    extents = only(spark.read.parquet(f"{root}/extents"))
    of_bars = extents.where(F.col("part") == "bars")
    stored = extents.where(F.col("part") != "bars")
    if kinds is not None:
        stored = stored.where(F.col("kind_group").isin(*kinds))

    def bars_at(where: Column) -> DataFrame:
        place = indexes.places(of_bars.where(where)).get(("bars", ""), F.lit(False))
        return only(spark.read.parquet(f"{root}/bars/data")).where(place)

    def overlapping(low: int, high: int) -> dict[tuple[str, str], DataFrame]:
        """Per part and kind the rows that overlap the bars, opened only where an extent does."""
        ends = F.col("end_bar_id").isNull() & (F.col("start_bar_id") >= low) | (F.col("end_bar_id") >= low)
        return {
            (part, kind): only(spark.read.parquet(f"{root}/{part}/kind_group={kind}/data")).where(place & (F.col("start_bar_id") <= high) & ends)
            for (part, kind), place in indexes.places(stored.where(indexes.meets(low, high))).items()
        }

    def anchored(low: int, high: int) -> tuple[int, int]:
        """First and last anchor of what overlaps the bars, these included."""
        found = overlapping(low, high).values()
        if not found:
            return low, high
        ends = [df.select(F.array_min("anchor_bar_ids").alias("a"), F.array_max("anchor_bar_ids").alias("z")) for df in found]
        first, last = union_all(ends).agg(F.min("a"), F.max("z")).first()
        return (low, high) if first is None else (min(low, first), max(high, last))

    from_index, to_index = windows.window_bounds(bars_at(indexes.selected(window)), window, series).agg(F.min("from_index"), F.max("to_index")).first()
    if from_index is None:
        raise KeyError(f"No series has the selected bars: {window}")
    inside = bars_at(indexes.meets(from_index, to_index, "index")).where(F.col("bar_index").between(from_index, to_index))
    low, high = anchored(*inside.agg(F.min("bar_id"), F.max("bar_id")).first())
    far_low, far_high = anchored(low, high)

    reached = bars_at(indexes.meets(far_low, far_high)).where(F.col("bar_id").between(far_low, far_high))
    low_index, high_index = reached.agg(F.min("bar_index"), F.max("bar_index")).first()
    first, last = 0 if from_start else min(low_index, from_index) - 1, max(high_index, to_index) + 1
    bars = bars_at(indexes.meets(first, last, "index")).where(F.col("bar_index").between(first, last))

    found = overlapping(low, high)
    part = lambda p: {kind: df.drop("year") for (of, kind), df in found.items() if of == p}
    objects, events = part("structures"), part("events")
    nothing = F.lit(False)
    for p, rows in (("structures", objects), ("events", events)):
        if not rows:  # any stored kind gives the columns
            kind = stored.where(F.col("part") == p).select("kind_group").first() or extents.where(F.col("part") == p).select("kind_group").first()
            rows[kind[0]] = spark.read.parquet(f"{root}/{p}/kind_group={kind[0]}/data").drop("year").where(nothing)
    return bars.drop("year"), union_all([df.withColumn("kind_group", F.lit(k)) for k, df in objects.items()]), widen_events(events)


def stored_chart_window(
    spark: SparkSession, root: str, minute_bars: DataFrame, timeframe: str, request: ChartRequest, data_version: str,
    symbols: Sequence[str] = (), series: Sequence[str] = schemas.SERIES,
) -> dict[str, DataFrame]:
    """W10 over the datasets of ``structure_job``."""
    from_start = bool(request.ema_lengths) and request.seed == "history"
    bars, objects, events = stored_inputs(spark, root, request.window, symbols, series=series, from_start=from_start)
    return _parts(bars, objects, events, minute_bars, timeframe, request, data_version, list(series))


def _parts(
    bars: DataFrame, objects: DataFrame, events: DataFrame, minute_bars: DataFrame, timeframe: str, request: ChartRequest,
    data_version: str, series: list[str],
) -> dict[str, DataFrame]:
    window = windows.select_window(bars, request.window, series)
    cursor = {"as_of_bar_id": request.as_of_bar_id, "as_of_event_id": request.as_of_event_id, "series": series}
    structures = windows.structures_in_window(objects, events, window, **cursor)
    seen = windows.events_in_window(events, window, **cursor)
    answer = {name: df for name, df in (("structures", structures), ("events", seen)) if request.wants(name)}
    if not request.wants(*(p for p in PARTS if p not in ("structures", "events"))):
        return answer
    structures = cut_lineage(structures)
    if request.wants("structures"):
        answer["structures"] = structures
    shown = cut_lineage(windows.widen_for_anchors(bars, window, structures, series))
    span = windows.window_range(shown, series)
    version = rules.PIVOT.structure_version

    def clipped(df: DataFrame) -> DataFrame:
        joined = df.join(span, series)
        kept = overlays.overlays_in_window(joined, F.col("min_bar_id"), F.col("max_bar_id"), request.layers or None, request.drawings)
        return kept.drop("min_bar_id", "max_bar_id")

    if request.wants("bars"):
        answer["bars"] = shown.drop("bar_index")
    if request.wants("overlays"):
        drawn = clipped(overlays.project_structures(structures, bars, data_version, version, series=series, drawings=request.drawings))
        if request.as_of_bar_id is not None:
            ghosts = overlays.project_events(
                seen, bars, data_version, rules.PIVOT.rulebook_version, version, series=series
            )
            drawn = drawn.unionByName(clipped(ghosts))
        answer["overlays"] = overlays.render_keys(drawn, request.drawings)
    if request.ema_lengths and request.wants("ema_lines"):
        answer["ema_lines"] = ema_lines(bars, shown, request.ema_lengths, request.seed, series)
    if request.include_replay and request.as_of_bar_id is None and request.as_of_event_id is None:
        if request.wants("replay_base"):
            answer["replay_base"] = replay.replay_base(objects, events, bars, shown, series)
        if request.wants("replay_overlays", "replay_deltas"):
            versions = cut_lineage(replay.overlay_versions(
                objects, events, bars, shown, data_version, series, layers=request.layers or None, drawings=request.drawings))
            if request.wants("replay_overlays"):
                answer["replay_overlays"] = replay.replay_overlay_base(versions, bars, shown, series)
            if request.wants("replay_deltas"):
                answer["replay_deltas"] = replay.replay_deltas(objects, events, bars, shown, series, versions=versions)
        if request.wants("playback"):
            answer["playback"] = replay.playback_steps(bars, shown, minute_bars, timeframe, series)
    return answer
