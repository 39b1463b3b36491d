"""Drawable projections of structures and of replaced pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import rules, schemas

# Fixed values.
LABELS = {
    "pivot_st_high": "STH", "pivot_st_low": "STL", "pivot_high": "PH", "pivot_low": "PL",
    "leg_up": "LU", "leg_down": "LD", "major_lh": "LH",
}
Z_ORDER = {"leg-line": 1, "pivot-marker": 2, "major-lh-marker": 3}
_PIVOT_KINDS = ("pivot_st_high", "pivot_st_low", "pivot_high", "pivot_low")
_META = (
    "source_kind", "source_state", "session_id", "session_date", "explanation_codes", "display_label", "confirm_bar_id",
    "replay_event_type", "event_bar_id", "reason_codes", "successor_structure_id",
)


@dataclass(frozen=True)
class Drawing:
    """How a kind of the caller's own is drawn: a marker at its start, or with ``last_price`` a line from start to end."""

    overlay_kind: str
    label: str
    layer: str
    first_price: str = "high"
    last_price: str | None = None
    z_order: int = 2


Drawings = Mapping[str, Drawing]


def _lookup(key: Column, table: dict) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(None))


def _own(kind: Column, drawings: Drawings | None, field: str) -> Column:
    return _lookup(kind, {k: getattr(d, field) for k, d in (drawings or {}).items() if getattr(d, field) is not None})


def display_label(kind: Column, state: Column, event_type: Column, drawings: Drawings | None = None) -> Column:
    mark = (
        F.when(event_type == "replaced", "~").when(event_type == "invalidated", "x")
        .when(state == "candidate", "?").otherwise("")
    )
    return F.concat(F.coalesce(_own(kind, drawings, "label"), _lookup(kind, LABELS)), mark)


def overlay_kind(kind: Column, drawings: Drawings | None = None) -> Column:
    return F.coalesce(
        _own(kind, drawings, "overlay_kind"),
        F.when(kind.isin(*_PIVOT_KINDS), "pivot-marker").when(kind.startswith("leg_"), "leg-line")
        .when(kind == "major_lh", "major-lh-marker"),
    )


def overlay_layer(source_kind: Column, drawings: Drawings | None = None) -> Column:
    """O05."""
    return F.coalesce(
        _own(source_kind, drawings, "layer"),
        F.when(source_kind.startswith("pivot_st_"), "pivot_st").when(source_kind.startswith("pivot_"), "pivot")
        .when(source_kind.startswith("leg_"), "leg").when(source_kind == "major_lh", "major_lh"),
    )


def _family(kind: Column) -> Column:
    return F.when(kind == "major_lh", F.lit("major_lh")).otherwise(
        F.concat_ws(".", F.regexp_extract(kind, r"^(.*)_(high|low|up|down)$", 1), F.regexp_extract(kind, r"_(high|low|up|down)$", 1))
    )


def _meta(df: DataFrame, given: dict[str, Column]) -> Column:
    types = {
        "session_id": "long", "session_date": "long", "confirm_bar_id": "long", "event_bar_id": "long",
        "explanation_codes": "array<string>", "reason_codes": "array<string>",
    }
    return F.struct(*[
        (given[m] if m in given else F.lit(None)).cast(types.get(m, "string")).alias(m) for m in _META
    ])


def _prices(df: DataFrame, bars: DataFrame, series: Sequence[str]) -> DataFrame:
    """Attach the bars at the first and last anchor; a missing bar fails the job."""
    at = lambda which: bars.select(
        *series, F.col("bar_id").alias(f"{which}_anchor"), F.struct("high", "low").alias(f"{which}_bar")
    )
    out = df.join(at("first"), [*series, "first_anchor"], "left").join(at("last"), [*series, "last_anchor"], "left")
    missing = F.raise_error(F.lit("Overlay projection is missing a bar."))
    return out.withColumns({
        f"{w}_bar": F.coalesce(f"{w}_bar", missing.cast("struct<high:double,low:double>")) for w in ("first", "last")
    })


def project_structures(
    structures: DataFrame,
    bars: DataFrame,
    data_version: str,
    structure_version: str,
    overlay_version: str = rules.OVERLAY_VERSION,
    series: Sequence[str] = schemas.SERIES,
    drawings: Drawings | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """O01/O03. ``drawings`` shows kinds of the caller's own; ``keep`` names further columns to carry along."""
    series = list(series)
    kind, state = F.col("kind"), F.col("state")
    shape = overlay_kind(kind, drawings)
    own_last = _own(kind, drawings, "last_price")
    is_line = (shape == "leg-line") | own_last.isNotNull()
    unknown = F.raise_error(F.concat(F.lit("Unsupported structure kind "), kind)).cast("string")
    open_leg = F.raise_error(F.lit("A leg overlay needs an end bar.")).cast("long")
    first = F.when(kind == "major_lh", F.element_at("anchor_bar_ids", -1)).otherwise(F.col("start_bar_id"))
    last = F.when(is_line, F.coalesce("end_bar_id", open_leg)).otherwise(first)
    live = structures.where(state != "invalidated").withColumns(
        {"first_anchor": first, "last_anchor": last, "overlay_kind": F.coalesce(shape, unknown)}
    )
    b = _prices(live, bars, series)
    priced = lambda bar, side: F.when(side == "high", F.col(f"{bar}_bar.high")).when(side == "low", F.col(f"{bar}_bar.low"))
    first_price = F.when(kind.isin("pivot_high", "pivot_st_high", "leg_down", "major_lh"), F.col("first_bar.high")).otherwise(
        F.col("first_bar.low")
    )
    last_price = F.when(kind == "leg_up", F.col("last_bar.high")).otherwise(F.col("last_bar.low"))
    first_price = F.coalesce(priced("first", _own(kind, drawings, "first_price")), first_price)
    last_price = F.coalesce(priced("last", own_last), last_price)
    style = F.coalesce(F.when(_own(kind, drawings, "overlay_kind").isNotNull(), kind), _family(kind))
    rulebook = F.col("rulebook_version") if "rulebook_version" in structures.columns else F.lit(rules.PIVOT.rulebook_version)
    return b.select(
        *series, F.concat_ws(":", "overlay_kind", F.lit(overlay_version), "structure_id").alias("overlay_id"),
        F.col("overlay_kind").alias("kind"), F.col("structure_id").alias("source_structure_id"),
        F.when(is_line, F.array("first_anchor", "last_anchor")).otherwise(F.array("first_anchor")).alias("anchor_bars"),
        F.when(is_line, F.array(first_price, last_price)).otherwise(F.array(first_price)).alias("anchor_prices"),
        F.concat_ws(".", style, state).alias("style_key"), F.lit(data_version).alias("data_version"),
        rulebook.alias("rulebook_version"), F.lit(structure_version).alias("structure_version"),
        F.lit(overlay_version).alias("overlay_version"),
        _meta(b, {
            "source_kind": kind, "source_state": state, "session_id": F.col("session_id"),
            "session_date": F.col("session_date"), "explanation_codes": F.col("explanation_codes"),
            "display_label": display_label(kind, state, F.lit(""), drawings), "confirm_bar_id": F.col("confirm_bar_id"),
        }).alias("meta"), *keep,
    )


def project_events(
    events: DataFrame,
    bars: DataFrame,
    data_version: str,
    rulebook_version: str,
    structure_version: str,
    overlay_version: str = rules.OVERLAY_VERSION,
    series: Sequence[str] = schemas.SERIES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ghosts of pivots that were replaced or invalidated."""
    series = list(series)
    kind, event_type = F.col("kind"), F.col("event_type")
    gone = events.where(event_type.isin("invalidated", "replaced") & kind.isin(*_PIVOT_KINDS)).withColumns(
        {"first_anchor": F.col("start_bar_id"), "last_anchor": F.col("start_bar_id")}
    )
    b = _prices(gone, bars, series)
    price = F.when(kind.endswith("_high"), F.col("first_bar.high")).otherwise(F.col("first_bar.low"))
    return b.select(
        *series,
        F.concat_ws(
            ":", F.lit("pivot-marker"), F.lit(overlay_version), "structure_id", "event_type",
            F.col("event_bar_id").cast("string"),
        ).alias("overlay_id"),
        F.lit("pivot-marker").alias("kind"), F.col("structure_id").alias("source_structure_id"),
        F.array("first_anchor").alias("anchor_bars"), F.array(price).alias("anchor_prices"),
        F.concat_ws(".", _family(kind), event_type).alias("style_key"), F.lit(data_version).alias("data_version"),
        F.lit(rulebook_version).alias("rulebook_version"), F.lit(structure_version).alias("structure_version"),
        F.lit(overlay_version).alias("overlay_version"),
        _meta(b, {
            "source_kind": kind, "source_state": F.lit("invalidated"), "session_id": F.col("session_id"),
            "session_date": F.col("session_date"),
            "display_label": display_label(kind, F.lit("invalidated"), event_type),
            "replay_event_type": event_type, "event_bar_id": F.col("event_bar_id"),
            "reason_codes": F.col("reason_codes"), "successor_structure_id": F.col("successor_structure_id"),
        }).alias("meta"), *keep,
    )


def render_keys(overlays: DataFrame, drawings: Drawings | None = None) -> DataFrame:
    """The columns overlays are drawn and hit-tested by."""
    tier = (
        F.when(F.col("meta.replay_event_type").isNotNull(), -1)
        .when(F.col("style_key").startswith("pivot_st."), 0).when(F.col("style_key").startswith("pivot."), 1).otherwise(0)
    )
    return overlays.withColumns(
        {
            "z_order": _lookup(F.col("kind"), {**Z_ORDER, **{d.overlay_kind: d.z_order for d in (drawings or {}).values()}}).cast("long"), "tier_rank": tier.cast("long"),
            "first_anchor": F.coalesce(F.get("anchor_bars", F.lit(0)), F.lit(-1)),
        }
    )


def overlays_in_window(
    overlays: DataFrame, min_bar_id: Column | int, max_bar_id: Column | int, layers: Sequence[str] | None = None,
    drawings: Drawings | None = None,
) -> DataFrame:
    """O05."""
    kept = overlays.withColumn("layer", overlay_layer(F.col("meta.source_kind"), drawings))
    if layers:
        kept = kept.where(F.col("layer").isin(*layers))
    return kept.where((F.array_max("anchor_bars") >= min_bar_id) & (F.array_min("anchor_bars") <= max_bar_id))


def layer_counts(overlays: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """O06."""
    return overlays.groupBy(*series, overlay_layer(F.col("meta.source_kind")).alias("layer")).agg(
        F.count(F.lit(1)).alias("overlays")
    )
