"""Lifecycle events of structures derived from other structures.

The rule is: after each bar with upstream events, rebuild the family and compare it with the build
before. Only structures that touch a pivot whose state changes at that bar can differ, so each bar
is compared on those alone; both sides of the comparison are rows, and the comparison is one
grouping. Nothing here walks a series in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, as_of
from barloom.functions.scalars import long, strings
from barloom.operators.legs import LEG_PIVOT, leg_rows, number_runs, score
from barloom.operators.pivots import order_events

DERIVED_PRIORITY = {"invalidated": 0, "replaced": 0, "updated": 1, "confirmed": 2, "created": 3}
_COMPARED = (
    "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchor_bar_ids", "session_id", "session_date",
    "explanation_codes",
)


def changed_fields(before: Column, after: Column) -> Column:
    """Names of the fields that differ, in their fixed order."""
    return F.array_compact(F.array(*[F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in _COMPARED]))


def lifecycle_from_builds(
    builds: DataFrame, bars: DataFrame, reasons: rules.Reasons, series: Sequence[str] = schemas.SERIES
) -> DataFrame:
    """Events from structure rows tagged ``which`` = before / after an ``event_bar_id``."""
    series = list(series)
    row = F.struct(*schemas.structure_columns())
    pairs = builds.groupBy(*series, "event_bar_id", "structure_id").agg(
        F.max(F.when(F.col("which") == "before", row)).alias("before"),
        F.max(F.when(F.col("which") == "after", row)).alias("after"),
    )
    b, a = F.col("before"), F.col("after")
    event_type = (
        F.when(a.isNull(), "invalidated")
        .when(b.isNull(), "created")
        .when((b["state"] != a["state"]) & (a["state"] == "confirmed"), "confirmed")
        .otherwise("updated")
    )
    moved = pairs.where(~b.eqNullSafe(a)).withColumn("event_type", event_type)
    r = F.coalesce(a, b)
    kind = F.col("event_type")
    reason = (
        F.when(kind == "invalidated", reasons.invalidated)
        .when(kind == "updated", reasons.updated)
        .when(a["state"] == "confirmed", reasons.confirmed)
        .otherwise(reasons.created)
    )
    codes_moved = b["explanation_codes"] != a["explanation_codes"]
    payload = F.when(
        kind.isin("created", "updated") | ((kind == "confirmed") & codes_moved),
        F.struct(a["explanation_codes"].alias("explanation_codes")),
    )
    events = moved.select(
        *series, F.concat_ws(":", "structure_id", kind, F.col("event_bar_id").cast("string")).alias("event_id"),
        "structure_id", r["kind"].alias("kind"), "event_type", "event_bar_id",
        F.when(kind == "invalidated", "invalidated").otherwise(r["state"]).alias("state_after_event"),
        F.array(reason).alias("reason_codes"), r["start_bar_id"].alias("start_bar_id"),
        r["end_bar_id"].alias("end_bar_id"), r["confirm_bar_id"].alias("confirm_bar_id"),
        r["anchor_bar_ids"].alias("anchor_bar_ids"), F.lit(None).cast("string").alias("predecessor_structure_id"),
        F.lit(None).cast("string").alias("successor_structure_id"), payload.alias("payload_after"),
        F.when(kind.isin("confirmed", "updated"), changed_fields(b, a)).otherwise(strings(())).alias("changed_fields"),
    )
    at = bars.select(*series, F.col("bar_id").alias("event_bar_id"), "session_id", "session_date")
    ordered = order_events(events, series, DERIVED_PRIORITY, first=1, by_start=False)
    missing = F.raise_error(F.concat(F.lit("An event lacks its bar: "), F.col("event_id"))).cast("long")
    dated = ordered.join(at, [*series, "event_bar_id"], "left").withColumns({c: F.coalesce(c, missing) for c in ("session_id", "session_date")})
    return dated.select(*series, *schemas.EVENT_COLUMNS)


def _chain(start: Column, pivots: Column) -> Column:
    """Fold a short ordered pivot array into its legs; ``start`` seeds the running pivot or is null."""
    pivot_type = "struct<start_bar_id:bigint,kind:string,structure_id:string,state:string,confirm_bar_id:bigint,session_id:bigint,session_date:bigint,price:double>"
    leg_type = f"array<struct<start:{pivot_type},end:{pivot_type},replaced:boolean>>"
    seed = F.struct(
        start.cast(pivot_type).alias("active"), F.lit(False).alias("replaced"),
        F.array().cast(leg_type).alias("legs"),
    )

    def step(acc: Column, p: Column) -> Column:
        active = acc["active"]
        same = active["kind"] == p["kind"]
        mine, other = score(active["kind"], active["price"]), score(p["kind"], p["price"])
        better = same & ((other > mine) | ((other == mine) & (p["start_bar_id"] > active["start_bar_id"])))
        take = active.isNull() | ~same | better
        leg = F.array(F.struct(active.alias("start"), p.alias("end"), acc["replaced"].alias("replaced"))).cast(leg_type)
        return F.struct(
            F.when(take, p.cast(pivot_type)).otherwise(active).alias("active"),
            F.when(active.isNull() | ~same, F.lit(False)).otherwise(acc["replaced"] | better).alias("replaced"),
            F.when(active.isNotNull() & ~same, F.concat(acc["legs"], leg)).otherwise(acc["legs"]).alias("legs"),
        )

    return F.aggregate(pivots, seed, step, lambda acc: acc["legs"])


def settled_runs(anchors: DataFrame, series: Sequence[str], span: int = CHUNK_ROWS) -> DataFrame:
    """For every confirmed pivot the run it ends: its first and its best pivot so far.

    ``at`` is the position of the bar that confirmed it, from which the run counts as settled.
    """
    series = list(series)
    settled = anchors.where(F.col("state") == "confirmed").select(
        *series, "bar_index", (F.col("bar_index") + F.col("right_window")).alias("at"),
        F.col("bar_id").alias("start_bar_id"), "kind", "structure_id", "state",
        F.col("confirm.bar_id").alias("confirm_bar_id"), F.col("confirm.session_id").alias("session_id"),
        F.col("confirm.session_date").alias("session_date"), "price",
    )
    seen = number_runs(settled, series, span, so_far=True)
    best = F.struct(*[F.col("top")[f].alias(f) for f in LEG_PIVOT])
    return seen.select(*series, "at", "start_bar_id", "kind", F.struct("first", best.alias("best")).alias("run"))


def leg_builds(
    anchors: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    family: rules.FamilyRules = rules.LEG_V2,
    feature_refs: Sequence[str] = (),
    scope: str | None = None,
    span: int = CHUNK_ROWS,
) -> DataFrame:
    """Legs that can change at a bar, before and after it.

    A pivot is open for at most ``right_window`` bars. At a bar only the pivots open before it or
    created by it move; everything older is summed up by the last settled run as of the bar before.
    """
    series = list(series)
    tier = anchors.where(F.col("kind_group") == rules.PIVOT.kind_group)
    settle = (
        F.when(F.col("state") == "confirmed", F.col("bar_index") + F.col("right_window"))
        .when(F.col("state") == "invalidated", F.col("bar_index") + F.col("hit.offset"))
    )
    last = F.coalesce(settle, F.col("bar_index") + F.col("right_window") - 1)
    rows = tier.withColumn("settle", settle).withColumn("at", F.explode(F.sequence("bar_index", last)))
    open_pivot = F.struct(
        F.col("bar_id").alias("start_bar_id"), "kind", "structure_id", F.lit("candidate").alias("state"),
        F.lit(None).cast("long").alias("confirm_bar_id"), "session_id", "session_date", "price",
    )
    done_pivot = F.struct(
        F.col("bar_id").alias("start_bar_id"), "kind", "structure_id", F.lit("confirmed").alias("state"),
        F.col("confirm.bar_id").alias("confirm_bar_id"), F.col("confirm.session_id").alias("session_id"),
        F.col("confirm.session_date").alias("session_date"), "price",
    )
    settles_now = F.coalesce(F.col("settle") == F.col("at"), F.lit(False))
    after = (
        F.when(settles_now & (F.col("state") == "confirmed"), done_pivot).when(~settles_now, open_pivot)
    )
    moves = (F.col("at") == F.col("bar_index")) | settles_now
    event_bar = (
        F.when(F.col("at") == F.col("bar_index"), F.col("bar_id"))
        .when(settles_now, F.coalesce(F.col("hit.bar_id"), F.col("confirm.bar_id")))
    )
    # At most two pivots per bar and right_window + 1 bars: the arrays are short whatever the data.
    per_bar = rows.groupBy(*series, "at").agg(
        F.max(event_bar).alias("event_bar_id"), F.max(moves).alias("moves"),
        F.array_sort(F.collect_list(F.when(F.col("at") > F.col("bar_index"), open_pivot))).alias("before"),
        F.array_sort(F.collect_list(after)).alias("after"),
    ).where("moves").drop("moves")
    seen = as_of(
        per_bar, settled_runs(tier, series, span), series, "at", "run", strictly_before=True,
        tie_break=["start_bar_id", "kind"], span=span,
    )
    base = F.when(
        F.col("run").isNotNull(),
        F.when(F.col("run.first.structure_id") == F.col("run.best.structure_id"), F.array("run.first"))
        .otherwise(F.array("run.first", "run.best")),
    ).otherwise(F.filter(F.array("run.first"), lambda x: F.lit(False)))
    pivot_type = seen.schema["before"].dataType
    none = F.lit(None).cast(pivot_type.elementType)
    legs_at = lambda name: _chain(none, F.concat(base, F.col(name)))
    sides = seen.select(
        *series, "event_bar_id",
        F.explode(
            F.concat(
                F.transform(legs_at("before"), lambda x: F.struct(F.lit("before").alias("which"), x.alias("leg"))),
                F.transform(legs_at("after"), lambda x: F.struct(F.lit("after").alias("which"), x.alias("leg"))),
            )
        ).alias("side"),
    ).select(*series, "event_bar_id", "side.which", "side.leg")
    leg = F.col("leg")
    return leg_rows(
        sides, leg["start"], leg["end"], leg["replaced"], series, family, feature_refs, scope, ["event_bar_id", "which"]
    )


def leg_events(
    anchors: DataFrame, bars: DataFrame, series: Sequence[str] = schemas.SERIES,
    family: rules.FamilyRules = rules.LEG_V2, scope: str | None = None, span: int = CHUNK_ROWS,
) -> DataFrame:
    """T16 for legs."""
    return lifecycle_from_builds(leg_builds(anchors, series, family, (), scope, span), bars, rules.LEG_REASONS, series)


def major_lh_events(
    leg_event_rows: DataFrame, bars: DataFrame, series: Sequence[str] = schemas.SERIES,
    family: rules.FamilyRules = rules.MAJOR_LH_V2, scope: str | None = None, span: int = CHUNK_ROWS,
) -> DataFrame:
    """T16 for major lower highs."""
    from barloom.operators.major_lh import major_lower_high_builds

    builds = major_lower_high_builds(leg_event_rows, bars, series, family, (), scope, span)
    return lifecycle_from_builds(builds, bars, rules.MAJOR_LH_REASONS, series)
