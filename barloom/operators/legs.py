"""Swing legs from alternating pivot runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, chunk_of, drop_halo, spread_halo
from barloom.functions.scalars import codes, strings, structure_id

_PIVOT = ("start_bar_id", "kind", "structure_id", "state", "confirm_bar_id", "session_id", "session_date")
LEG_PIVOT = (*_PIVOT, "price")


def pivot_side(kind: Column) -> Column:
    return F.when(kind == "pivot_high", "high").otherwise("low")


def priced(pivots: DataFrame, bars: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """Add the pivot price from the bars, for pivot rows that come without one."""
    if "price" in pivots.columns:
        return pivots
    at = bars.select(*series, F.col("bar_id").alias("start_bar_id"), "high", "low")
    price = F.when(F.col("kind") == "pivot_high", F.col("high")).otherwise(F.col("low"))
    missing = F.raise_error(F.concat(F.lit("A pivot lacks its bar "), F.col("start_bar_id").cast("string"))).cast("double")
    found = pivots.join(at.withColumn("found", F.lit(True)), [*series, "start_bar_id"], "left")
    return found.withColumn("price", F.when(F.col("found"), price).otherwise(missing)).drop("high", "low", "found")


def score(kind: Column, price: Column) -> Column:
    """Larger is more extreme, for either side."""
    return F.when(kind == "pivot_high", price).otherwise(-price)


def number_runs(
    pivots: DataFrame, series: Sequence[str] = schemas.SERIES, span: int = CHUNK_ROWS, so_far: bool = False
) -> DataFrame:
    """Add ``run_id``: 1, 2, ... for each maximal run of same-side pivots in (bar, kind, id) order.

    Runs are numbered inside chunks of bar ids; one row per chunk says how many runs it holds and
    whether its first run continues the last run before it. With ``so_far`` each pivot also gets the
    ``first`` and the ``top`` (most extreme) pivot of its run up to itself, carried over the same table.
    """
    series = list(series)
    order = F.struct("start_bar_id", "kind", "structure_id")
    by_order = ["start_bar_id", "kind", "structure_id"]
    p = pivots.withColumns({"side": pivot_side(F.col("kind")), "chunk": chunk_of(F.col("start_bar_id"), span)})
    w = Window.partitionBy(*series, "chunk").orderBy(*by_order)
    upto = Window.unboundedPreceding, 0
    turn = F.when(F.lag("side").over(w) == F.col("side"), 0).otherwise(1)
    local = p.withColumn("turn", turn).withColumn("local_run", F.sum("turn").over(w.rowsBetween(*upto)))
    run_ends = []
    if so_far:
        inside = Window.partitionBy(*series, "chunk", "local_run").orderBy(*by_order).rowsBetween(*upto)
        pivot = F.struct(*LEG_PIVOT)
        ranked = F.struct(score(F.col("kind"), F.col("price")).alias("score"), *LEG_PIVOT)
        local = local.withColumns({"first": F.min(pivot).over(inside), "top": F.max(ranked).over(inside)})
        run_ends = [F.max_by("first", order).alias("last_first"), F.max_by("top", order).alias("last_top")]
    heads = local.groupBy(*series, "chunk").agg(
        F.max("local_run").alias("runs"), F.min_by("side", order).alias("first_side"),
        F.max_by("side", order).alias("last_side"), *run_ends,
    )
    ws = Window.partitionBy(*series).orderBy("chunk")
    heads = heads.withColumn("joins", F.when(F.lag("last_side").over(ws) == F.col("first_side"), 1).otherwise(0))
    offset = F.coalesce(F.sum("runs").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum(
        "joins"
    ).over(ws.rowsBetween(*upto))
    heads = heads.withColumn("offset", offset)
    carried = []
    if so_far:
        same_run = Window.partitionBy(*series, F.col("runs") + F.col("offset")).orderBy("chunk").rowsBetween(*upto)
        heads = heads.withColumns({"run_first": F.min("last_first").over(same_run), "run_top": F.max("last_top").over(same_run)})
        carried = [
            F.when(F.col("joins") == 1, F.lag(f"run_{c}").over(ws)).alias(f"carry_{c}") for c in ("first", "top")
        ]
    heads = heads.select(*series, "chunk", "offset", *carried)
    starts = F.col("local_run") == 1
    runs_so_far = [] if not so_far else [
        F.when(starts & F.col("carry_first").isNotNull(), F.col("carry_first")).otherwise(F.col("first")).alias("first"),
        F.when(starts & (F.col("carry_top") > F.col("top")), F.col("carry_top")).otherwise(F.col("top")).alias("top"),
    ]
    return local.join(heads, [*series, "chunk"]).select(
        *pivots.columns, "side", (F.col("local_run") + F.col("offset")).alias("run_id"), *runs_so_far
    )


def legs_from_pivots(
    pivots: DataFrame,
    bars: DataFrame | None = None,
    series: Sequence[str] = schemas.SERIES,
    family: rules.FamilyRules = rules.LEG_V2,
    feature_refs: Sequence[str] = (),
    scope: str | None = None,
    span: int = CHUNK_ROWS,
) -> DataFrame:
    """A leg from the best pivot of each run to the first pivot of the next run.

    Runs are reduced with ``min``/``max`` aggregates, so a run of any length combines map-side.
    """
    series = list(series)
    visible = pivots.where(
        F.col("kind").isin("pivot_high", "pivot_low") & F.col("state").isin("candidate", "confirmed")
    )
    runs = number_runs(priced(visible, bars, series).select(*series, *_PIVOT, "price"), series, span)
    pivot = F.struct(*_PIVOT)
    ranked = F.struct(score(F.col("kind"), F.col("price")).alias("score"), *_PIVOT)
    ends = runs.groupBy(*series, "run_id").agg(F.min(pivot).alias("first"), F.max(ranked).alias("best"))
    ordinal = ends.withColumn("run_no", F.col("run_id").cast("long") - 1)
    spread, w = spread_halo(ordinal, series, "run_no", 0, 1)
    pairs = drop_halo(spread.withColumn("next", F.lead("first").over(w)), "run_no").where(F.col("next").isNotNull())
    replaced = F.col("best.structure_id") != F.col("first.structure_id")
    return leg_rows(pairs, F.col("best"), F.col("next"), replaced, series, family, feature_refs, scope)


def leg_rows(
    df: DataFrame, start: Column, end: Column, replaced: Column, series: Sequence[str], family: rules.FamilyRules,
    feature_refs: Sequence[str], scope: str | None, extra: Sequence[str] = (),
) -> DataFrame:
    kind = F.when(start["kind"] == "pivot_low", "leg_up").otherwise("leg_down")
    anchors = F.array(start["start_bar_id"], end["start_bar_id"])
    return df.select(
        *series, *extra,
        structure_id(kind, start["start_bar_id"], anchors, family.rulebook_version, family.structure_version, scope)
        .alias("structure_id"),
        kind.alias("kind"), end["state"].alias("state"), start["start_bar_id"].alias("start_bar_id"),
        end["start_bar_id"].alias("end_bar_id"),
        F.when(end["state"] == "confirmed", end["confirm_bar_id"]).alias("confirm_bar_id"),
        start["session_id"].alias("session_id"), start["session_date"].alias("session_date"),
        anchors.alias("anchor_bar_ids"), strings(feature_refs).alias("feature_refs"),
        F.lit(family.rulebook_version).alias("rulebook_version"),
        codes(
            family.codes, (replaced, rules.SAME_TYPE_REPLACEMENT),
            (start["session_id"] != end["session_id"], rules.CROSS_SESSION_LEG),
        ).alias("explanation_codes"),
    )
