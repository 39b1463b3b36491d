"""Major lower highs over the confirmed leg list (T12) and their lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, drop_halo, spread_halo, with_ordinal
from barloom.functions.scalars import codes, strings, structure_id


def _with_end_bars(legs: DataFrame, bars: DataFrame, series: Sequence[str]) -> DataFrame:
    """Add the bars at both ends of each leg; a missing bar fails the job."""
    fields = ("high", "low", "session_id", "session_date")
    at = lambda which: bars.select(
        *series, F.col("bar_id").alias(f"{which}_bar_id"), F.struct(*fields).alias(f"{which}_bar")
    )
    out = legs.join(at("start"), [*series, "start_bar_id"], "left").join(at("end"), [*series, "end_bar_id"], "left")
    missing = F.raise_error(F.concat(F.lit("A leg lacks a bar at an end of "), F.col("start_bar_id").cast("string")))
    return out.withColumns({
        f"{w}_bar": F.coalesce(f"{w}_bar", missing.cast("struct<high:double,low:double,session_id:bigint,session_date:bigint>"))
        for w in ("start", "end")
    })


def _sequences(
    legs: DataFrame, bars: DataFrame, series: Sequence[str], look_ahead: int, span: int, rows: int, extra: Sequence[str] = ()
) -> DataFrame:
    """Up-down-up triples with a lower second high, with the legs that follow them as ``l3``, ``l4``."""
    confirmed = legs.where(F.col("kind").isin("leg_up", "leg_down") & (F.col("state") == "confirmed")).select(
        *series, "kind", "start_bar_id", "end_bar_id", "confirm_bar_id", *extra
    )
    placed = with_ordinal(
        _with_end_bars(confirmed, bars, series), series, ["start_bar_id", "end_bar_id"], "leg_no", span
    )
    spread, w = spread_halo(placed, series, "leg_no", 0, look_ahead, rows)
    leg = F.struct("kind", "start_bar_id", "end_bar_id", "confirm_bar_id", "start_bar", "end_bar", *extra)
    spread = spread.withColumn("l0", leg).withColumns(
        {f"l{k}": F.lead(leg, k).over(w) for k in range(1, look_ahead + 1)}
    )
    home = drop_halo(spread, "leg_no", rows)
    return home.where(
        (F.col("l0.kind") == "leg_up") & (F.col("l1.kind") == "leg_down") & (F.col("l2.kind") == "leg_up")
        & (F.col("l2.end_bar.high") < F.col("l0.end_bar.high"))
    ).withColumns(
        {
            "proves": F.coalesce(
                (F.col("l3.kind") == "leg_down") & (F.col("l3.start_bar_id") == F.col("l2.end_bar_id")), F.lit(False)
            ),
            "breaks": F.coalesce(F.col("l3.end_bar.low") < F.col("l1.end_bar.low"), F.lit(False)),
        }
    )


def _crosses(with_proof: Column) -> Column:
    sessions = [F.col(f"l{k}.{end}_bar.session_id") for k in (0, 1, 2) for end in ("start", "end")]
    proof = [F.when(with_proof, F.col(f"l3.{end}_bar.session_id")) for end in ("start", "end")]
    return F.greatest(*sessions, *proof) != F.least(*sessions, *proof)


def _row(
    df: DataFrame, confirmed: Column, series: Sequence[str], family: rules.FamilyRules, feature_refs: Sequence[str],
    scope: str | None, extra: Sequence[str] = (),
) -> DataFrame:
    h1, l1, h2 = F.col("l0.end_bar_id"), F.col("l1.end_bar_id"), F.col("l2.end_bar_id")
    anchors = F.array(h1, l1, h2)
    kind = F.lit("major_lh")
    return df.select(
        *series, *extra,
        structure_id(kind, h1, anchors, family.rulebook_version, family.structure_version, scope).alias("structure_id"),
        kind.alias("kind"), F.when(confirmed, "confirmed").otherwise("candidate").alias("state"),
        h1.alias("start_bar_id"), h2.alias("end_bar_id"),
        F.when(confirmed, F.col("l3.confirm_bar_id")).alias("confirm_bar_id"),
        F.col("l2.end_bar.session_id").alias("session_id"), F.col("l2.end_bar.session_date").alias("session_date"),
        anchors.alias("anchor_bar_ids"), strings(feature_refs).alias("feature_refs"),
        F.lit(family.rulebook_version).alias("rulebook_version"),
        codes(
            (rules.LOWER_HIGH,), (confirmed, rules.PRIOR_LOW_BROKEN),
            (_crosses(confirmed), rules.CROSS_SESSION_SEQUENCE),
        ).alias("explanation_codes"),
    )


def major_lower_highs(
    legs: DataFrame,
    bars: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    family: rules.FamilyRules = rules.MAJOR_LH_V2,
    feature_refs: Sequence[str] = (),
    scope: str | None = None,
    span: int = CHUNK_ROWS,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Confirmed once the next down leg breaks the low between the two highs; a sequence that is
    not confirmed is kept only while it ends the leg list."""
    seq = _sequences(legs, bars, series, 4, span, rows)
    confirmed = F.col("proves") & F.col("breaks")
    after = F.when(F.col("proves"), F.col("l4.kind")).otherwise(F.col("l3.kind"))
    kept = seq.where(confirmed | after.isNull())
    return _row(kept, confirmed, series, family, feature_refs, scope)


def major_lower_high_builds(
    leg_events: DataFrame,
    bars: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    family: rules.FamilyRules = rules.MAJOR_LH_V2,
    feature_refs: Sequence[str] = (),
    scope: str | None = None,
    span: int = CHUNK_ROWS,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each sequence before and after every bar at which one of its legs became confirmed.

    Confirmed legs only ever get appended, so a sequence changes at most when its third, fourth and
    fifth leg arrive; no other part of the history needs to be rebuilt.
    """
    series = list(series)
    born = leg_events.where(
        (F.col("state_after_event") == "confirmed") & F.col("event_type").isin("created", "confirmed")
    ).select(
        *series, "kind", "start_bar_id", "end_bar_id", "confirm_bar_id", F.lit("confirmed").alias("state"),
        F.col("event_bar_id").alias("arrived"),
    )
    seq = _sequences(born, bars, series, 4, span, rows, ["arrived"])
    times = F.array_distinct(F.array_compact(F.array("l2.arrived", "l3.arrived", "l4.arrived")))
    steps = seq.withColumn("event_bar_id", F.explode(times))

    def state(now: Column, inclusive: bool) -> tuple[Column, Column]:
        there = lambda k: F.coalesce(
            F.col(f"l{k}.arrived") <= now if inclusive else F.col(f"l{k}.arrived") < now, F.lit(False)
        )
        confirmed = there(3) & F.col("proves") & F.col("breaks")
        tail = there(2) & F.when(F.col("proves"), ~there(4)).otherwise(~there(3))
        return confirmed, there(2) & (confirmed | tail)

    parts = []
    for which, inclusive in (("before", False), ("after", True)):
        confirmed, visible = state(F.col("event_bar_id"), inclusive)
        part = _row(steps.where(visible), confirmed, series, family, feature_refs, scope, ["event_bar_id"])
        parts.append(part.withColumn("which", F.lit(which)))
    return parts[0].unionByName(parts[1])
