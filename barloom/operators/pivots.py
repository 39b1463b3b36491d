"""Pivot detection: the strict two-sided scan (v0.1) and the candidate/replace tiers (v0.2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, drop_halo, spread_halo
from barloom.functions.scalars import codes, long, strings, structure_id
from barloom.operators.bars import index_bars

_NEEDED = ("bar_index", "bar_id", "session_id", "session_date", "high", "low")


def strict_pivots(
    bars: DataFrame,
    left: int = rules.PIVOT_V1.left,
    right: int = rules.PIVOT_V1.right,
    series: Sequence[str] = schemas.SERIES,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per bar whether it is a strict high/low pivot or a tail candidate, and the session flag.

    Sessions do not reset the frames; ties kill a pivot.
    """
    series = list(series)
    spread, w = spread_halo(index_bars(bars, series).select(*series, *_NEEDED), series, "bar_index", left, right, rows)
    back, ahead = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    seen = spread.withColumns(
        {
            "high_before": F.max("high").over(back), "low_before": F.min("low").over(back),
            "high_after": F.max("high").over(ahead), "low_after": F.min("low").over(ahead),
            "rows_after": F.count(F.lit(1)).over(ahead), "confirm_bar_id": F.lead("bar_id", right).over(w),
            "first_session": F.lag("session_id", left).over(w), "last_session": F.lead("session_id", right).over(w),
        }
    )
    seen = drop_halo(seen, "bar_index", rows)
    full = F.col("rows_after") == right
    enough_left = F.col("bar_index") >= left
    is_high = (F.col("high") > F.col("high_before")) & F.coalesce(F.col("high") > F.col("high_after"), F.lit(True))
    is_low = (F.col("low") < F.col("low_before")) & F.coalesce(F.col("low") < F.col("low_after"), F.lit(True))
    return seen.select(
        *series, *_NEEDED,
        (enough_left & full & is_high).alias("pivot_high"), (enough_left & full & is_low).alias("pivot_low"),
        (enough_left & ~full & is_high).alias("tail_high"), (enough_left & ~full & is_low).alias("tail_low"),
        F.coalesce(F.col("first_session") != F.col("last_session"), F.lit(False)).alias("cross_session_window"),
        F.when(full, F.col("confirm_bar_id")).alias("confirm_bar_id"),
    )


def pivots_v1(
    bars: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    feature_refs: Sequence[str] = (),
    scope: str | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """v0.1 pivot rows, confirmed or candidate, with ``price`` and ``bar_index`` kept for later joins."""
    tier = rules.PIVOT_V1
    scan = strict_pivots(bars, tier.left, tier.right, series, rows)
    side = lambda name: F.when(
        F.col(f"pivot_{name}") | F.col(f"tail_{name}"),
        F.struct(F.lit(f"pivot_{name}").alias("kind"), F.col(f"pivot_{name}").alias("confirmed"),
                 F.col(name).alias("price")),
    )
    found = scan.withColumn("p", F.explode(F.array_compact(F.array(side("high"), side("low")))))
    anchors = F.array("bar_id")
    return found.select(
        *series,
        structure_id(F.col("p.kind"), F.col("bar_id"), anchors, tier.rulebook_version, tier.structure_version, scope)
        .alias("structure_id"),
        F.col("p.kind"), F.when(F.col("p.confirmed"), "confirmed").otherwise("candidate").alias("state"),
        F.col("bar_id").alias("start_bar_id"), F.lit(None).cast("long").alias("end_bar_id"),
        F.when(F.col("p.confirmed"), F.col("confirm_bar_id")).alias("confirm_bar_id"), "session_id", "session_date",
        anchors.alias("anchor_bar_ids"), strings(feature_refs).alias("feature_refs"),
        F.lit(tier.rulebook_version).alias("rulebook_version"),
        codes(rules.PIVOT_V1_CODES, (F.col("cross_session_window"), tier.cross_session_code)).alias("explanation_codes"),
        F.col("p.price"), "bar_index",
    )


def _beyond(a: Column, b: Column, side: str) -> Column:
    return a > b if side == "high" else a < b


def pivot_anchors(
    bars: DataFrame,
    tiers: Sequence[rules.PivotTier] = (rules.PIVOT_ST, rules.PIVOT),
    series: Sequence[str] = schemas.SERIES,
    scope: str | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Every anchor that beats its left neighbours, for all tiers in one window pass.

    ``hit`` is the first bar within the right window that ties or beats the anchor, null if none;
    ``confirm`` the bar that completes the right window, null if it does not exist yet.
    """
    series = list(series)
    reach = max(t.right for t in tiers)
    depth = max(t.left for t in tiers)
    spread, w = spread_halo(
        index_bars(bars, series).select(*series, *_NEEDED), series, "bar_index", depth, reach, rows
    )
    flags = {}
    for t in tiers:
        back = w.rowsBetween(-t.left, -1)
        enough = F.col("bar_index") >= t.left
        flags[f"q_{t.kind_group}_high"] = enough & (F.col("high") > F.max("high").over(back))
        flags[f"q_{t.kind_group}_low"] = enough & (F.col("low") < F.min("low").over(back))
    spread = spread.withColumns(flags)
    point = F.struct("bar_id", "session_id", "session_date", "high", "low", *flags)
    spread = spread.withColumns({f"n{k}": F.lead(point, k).over(w) for k in range(1, reach + 1)})
    spread = spread.withColumns(
        {f"first_session_{t.left}": F.lag("session_id", t.left).over(w) for t in tiers}
    )
    home = drop_halo(spread, "bar_index", rows)

    candidates = []
    for t in tiers:
        last_session = F.coalesce(*[F.col(f"n{k}.session_id") for k in range(t.right, 0, -1)], F.col("session_id"))
        crosses = F.coalesce(F.col(f"first_session_{t.left}") != last_session, F.lit(False))
        for side in ("high", "low"):
            flag = f"q_{t.kind_group}_{side}"
            hits = [
                F.when(
                    ~_beyond(F.col(side), F.col(f"n{k}.{side}"), side),
                    F.struct(
                        F.col(f"n{k}.bar_id").alias("bar_id"), F.col(f"n{k}.session_id").alias("session_id"),
                        F.col(f"n{k}.session_date").alias("session_date"), F.col(f"n{k}.{flag}").alias("qualifies"),
                        long(k).alias("offset"),
                    ),
                )
                for k in range(1, t.right + 1)
            ]
            end = f"n{t.right}"
            candidates.append(
                F.when(
                    F.col(flag),
                    F.struct(
                        F.lit(t.kind_group).alias("kind_group"), F.lit(f"{t.kind_group}_{side}").alias("kind"),
                        F.lit(side).alias("side"), F.col(side).alias("price"), F.coalesce(*hits).alias("hit"),
                        F.when(
                            F.col(end).isNotNull(),
                            F.struct(
                                F.col(f"{end}.bar_id").alias("bar_id"), F.col(f"{end}.session_id").alias("session_id"),
                                F.col(f"{end}.session_date").alias("session_date"),
                            ),
                        ).alias("confirm"),
                        crosses.alias("crosses"), long(t.left).alias("left_window"),
                        long(t.right).alias("right_window"),
                    ),
                )
            )
    out = home.select(
        *series, "bar_index", "bar_id", "session_id", "session_date",
        F.inline(F.array_compact(F.array(*candidates))),
    )
    pick = lambda f: reduce(
        lambda acc, t: acc.when(F.col("kind_group") == t.kind_group, f(t)), tiers[1:],
        F.when(F.col("kind_group") == tiers[0].kind_group, f(tiers[0])),
    )
    state = (
        F.when(F.col("hit").isNotNull(), "invalidated")
        .when(F.col("confirm").isNotNull(), "confirmed")
        .otherwise("candidate")
    )
    identity = lambda bar: pick(
        lambda t: structure_id(F.col("kind"), bar, F.array(bar), t.rulebook_version, t.structure_version, scope)
    )
    return out.withColumns(
        {
            "state": state,
            "structure_id": identity(F.col("bar_id")),
            "successor_structure_id": F.when(F.col("hit.qualifies"), identity(F.col("hit.bar_id"))),
            "explanation_codes": pick(lambda t: codes(t.codes, (F.col("crosses"), t.cross_session_code))),
        }
    )


def pivot_objects(
    anchors: DataFrame, series: Sequence[str] = schemas.SERIES, feature_refs: Sequence[str] = ()
) -> DataFrame:
    """One row per anchor with its final state."""
    return anchors.select(
        *series, "structure_id", "kind", "state", F.col("bar_id").alias("start_bar_id"),
        F.lit(None).cast("long").alias("end_bar_id"),
        F.when(F.col("state") == "confirmed", F.col("confirm.bar_id")).alias("confirm_bar_id"),
        "session_id", "session_date", F.array("bar_id").alias("anchor_bar_ids"),
        strings(feature_refs).alias("feature_refs"), F.lit(rules.PIVOT.rulebook_version).alias("rulebook_version"),
        "explanation_codes",
    )


def resolved_pivots(anchors: DataFrame, kind_group: str = "pivot", series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """Surviving pivots of a tier as the lifecycle reducer leaves them.

    A confirming event carries the session of the confirming bar, and the reducer takes it over.
    """
    done = F.col("state") == "confirmed"
    return anchors.where((F.col("kind_group") == kind_group) & (F.col("state") != "invalidated")).select(
        *series, "structure_id", "kind", "state", F.col("bar_id").alias("start_bar_id"),
        F.when(done, F.col("confirm.bar_id")).alias("confirm_bar_id"),
        F.when(done, F.col("confirm.session_id")).otherwise(F.col("session_id")).alias("session_id"),
        F.when(done, F.col("confirm.session_date")).otherwise(F.col("session_date")).alias("session_date"),
        "price", "bar_index",
    )


def order_events(
    events: DataFrame, series: Sequence[str], priority: dict[str, int], first: int, by_start: bool, group: Sequence[str] = ()
) -> DataFrame:
    """Number the events of a bar. A bar has a handful of events, so the window stays tiny."""
    rank = F.coalesce(
        *[F.when(F.col("event_type") == name, F.lit(n)) for name, n in priority.items()], F.lit(99)
    )
    keys = [rank, *([F.col("start_bar_id")] if by_start else []), F.col("kind"), F.col("structure_id"), F.col("event_id")]
    w = Window.partitionBy(*series, *group, "event_bar_id").orderBy(*keys)
    return events.withColumn("event_order", (F.row_number().over(w) - 1 + first).cast("long"))


PIVOT_PRIORITY = {"replaced": 0, "invalidated": 1, "created": 2, "confirmed": 3, "updated": 4}


def pivot_events(anchors: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """Created at the anchor, then confirmed, invalidated or replaced."""
    payload = F.struct(
        "explanation_codes", F.col("price").alias("extreme_price"), "left_window", "right_window",
        F.col("crosses").alias("crosses_session_boundary"),
    )
    t = rules.PIVOT  # the reason texts are the same for every tier
    entry = lambda kind, bar, state, reason, confirm, successor, pay, changed, sid, sdate: F.struct(
        kind.alias("event_type"), bar.alias("event_bar_id"), F.lit(state).alias("state_after_event"),
        F.array(reason).alias("reason_codes"), confirm.cast("long").alias("confirm_bar_id"),
        successor.cast("string").alias("successor_structure_id"), pay.alias("payload_after"),
        changed.alias("changed_fields"), sid.alias("event_session_id"), sdate.alias("event_session_date"),
    )
    null = F.lit(None)
    no_payload = F.when(F.lit(False), payload)
    replaced = F.coalesce(F.col("hit.qualifies"), F.lit(False))
    created = entry(
        F.lit("created"), F.col("bar_id"), "candidate", F.lit(t.created_reason), null, null, payload, strings(()),
        F.col("session_id"), F.col("session_date"),
    )
    confirmed = entry(
        F.lit("confirmed"), F.col("confirm.bar_id"), "confirmed", F.lit(t.confirmed_reason), F.col("confirm.bar_id"),
        null, no_payload, strings(("confirm_bar_id",)), F.col("confirm.session_id"), F.col("confirm.session_date"),
    )
    ended = entry(
        F.when(replaced, "replaced").otherwise("invalidated"), F.col("hit.bar_id"), "invalidated",
        F.when(replaced, t.replaced_reason).otherwise(t.invalidated_reason), null, F.col("successor_structure_id"),
        no_payload, F.when(replaced, strings(("successor_structure_id",))).otherwise(strings(())),
        F.col("hit.session_id"), F.col("hit.session_date"),
    )
    steps = F.array_compact(
        F.array(created, F.when(F.col("state") == "confirmed", confirmed), F.when(F.col("state") == "invalidated", ended))
    )
    rows = anchors.select(
        *series, "structure_id", "kind", "kind_group", F.col("bar_id").alias("start_bar_id"), F.explode(steps).alias("e")
    ).select(
        *series, "structure_id", "kind", "kind_group", "start_bar_id", "e.*",
        F.concat_ws(":", "structure_id", "e.event_type", F.col("e.event_bar_id").cast("string")).alias("event_id"),
    )
    ordered = order_events(rows, series, PIVOT_PRIORITY, first=0, by_start=True, group=["kind_group"])
    return ordered.select(
        *series, "event_id", "structure_id", "kind", "event_type", "event_bar_id", "event_order", "state_after_event",
        "reason_codes", "start_bar_id", F.lit(None).cast("long").alias("end_bar_id"), "confirm_bar_id",
        F.array("start_bar_id").alias("anchor_bar_ids"), F.lit(None).cast("string").alias("predecessor_structure_id"),
        "successor_structure_id", "payload_after", "changed_fields", F.col("event_session_id").alias("session_id"),
        F.col("event_session_date").alias("session_date"),
    )
