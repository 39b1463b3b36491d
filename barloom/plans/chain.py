"""The structure chain over one family: features, pivots, legs, major lower highs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS
from barloom.operators import derived, features, legs, major_lh, pivots
from barloom.operators.bars import index_bars
from barloom.session import cut_lineage

KINDS = ("pivot_st", "pivot", "leg", "major_lh")


@dataclass(frozen=True)
class StructureChain:
    """Every dataset of a run. Bars, anchors and leg events are stored once because several parts read them."""

    bars: DataFrame
    features: DataFrame
    anchors: DataFrame
    objects: dict[str, DataFrame]
    events: dict[str, DataFrame]

    def all_objects(self) -> DataFrame:
        parts = [self.objects[k].withColumn("kind_group", F.lit(k)) for k in KINDS]
        return union_all(parts)

    def all_events(self) -> DataFrame:
        return widen_events(self.events)


def widen_events(events: dict[str, DataFrame]) -> DataFrame:
    """Events of several kinds in one table; the payload is widened to the pivot payload with nulls."""
    wide = schemas.PIVOT_PAYLOAD.fieldNames()
    parts = []
    for kind, df in events.items():
        have = df.schema["payload_after"].dataType.fieldNames()
        payload = F.when(
            F.col("payload_after").isNotNull(),
            F.struct(*[
                (F.col(f"payload_after.{f}") if f in have else F.lit(None).cast(schemas.PIVOT_PAYLOAD[f].dataType)).alias(f)
                for f in wide
            ]),
        )
        parts.append(df.withColumn("payload_after", payload).withColumn("kind_group", F.lit(kind)))
    return union_all(parts)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored_index(bars: DataFrame, series: Sequence[str] = schemas.SERIES, span: int = CHUNK_ROWS) -> DataFrame:
    """Bars with ``bar_index``, stored. Numbering reads its input twice, so the bars are stored before it:
    what they are built from, a trade-level shuffle, then runs once."""
    if "bar_index" in bars.columns:
        return bars
    return cut_lineage(index_bars(cut_lineage(bars), series, span))


def pivot_tier(
    bars: DataFrame, tier: rules.PivotTier, series: Sequence[str] = schemas.SERIES,
    feature_refs: Sequence[str] = (), scope: str | None = None, rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Objects and events of one tier."""
    anchors = pivots.pivot_anchors(bars, [tier], series, scope, rows)
    return pivots.pivot_objects(anchors, series, feature_refs), pivots.pivot_events(anchors, series)


def structures_v1(
    bars: DataFrame, series: Sequence[str] = schemas.SERIES, feature_refs: Sequence[str] = (), scope: str | None = None
) -> dict[str, DataFrame]:
    """T13 for rulebook v0.1: pivots, legs and major lower highs as objects."""
    bars = stored_index(bars, series)
    found = cut_lineage(pivots.pivots_v1(bars, series, feature_refs, scope))
    leg = cut_lineage(legs.legs_from_pivots(found, series=series, family=rules.LEG_V1, feature_refs=feature_refs, scope=scope))
    major = major_lh.major_lower_highs(leg, bars, series, rules.MAJOR_LH_V1, feature_refs, scope)
    return {"pivot": found.drop("price", "bar_index"), "leg": leg, "major_lh": major}


def structure_chain(
    bars: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    feature_refs: Sequence[str] = (),
    scope: str | None = None,
    span: int = CHUNK_ROWS,
    rows: int = CHUNK_ROWS,
) -> StructureChain:
    """All v0.2 objects and events of a family."""
    bars = stored_index(bars, series, span)
    anchors = cut_lineage(pivots.pivot_anchors(bars, series=series, scope=scope, rows=rows))
    tier = lambda k: anchors.where(F.col("kind_group") == k)
    leg_objects = cut_lineage(
        legs.legs_from_pivots(
            pivots.resolved_pivots(anchors, series=series), series=series, feature_refs=feature_refs, scope=scope, span=span
        )
    )
    leg_events = cut_lineage(derived.leg_events(anchors, bars, series, scope=scope, span=span))
    objects = {
        "pivot_st": pivots.pivot_objects(tier("pivot_st"), series, feature_refs),
        "pivot": pivots.pivot_objects(tier("pivot"), series, feature_refs),
        "leg": leg_objects,
        "major_lh": major_lh.major_lower_highs(
            leg_objects, bars, series, rules.MAJOR_LH_V2, feature_refs, scope, span, rows
        ),
    }
    events = {
        "pivot_st": pivots.pivot_events(tier("pivot_st"), series),
        "pivot": pivots.pivot_events(tier("pivot"), series),
        "leg": leg_events,
        "major_lh": derived.major_lh_events(leg_events, bars, series, scope=scope, span=span),
    }
    return StructureChain(bars, features.edge_features(bars, series, rows), anchors, objects, events)
