"""State of structures as of a bar or an event, from the lifecycle log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schemas

COMMON_FIELDS = (
    "start_bar_id", "end_bar_id", "confirm_bar_id", "anchor_bar_ids", "session_id", "session_date",
    "predecessor_structure_id", "successor_structure_id",
)


def position() -> Column:
    """Place of an event in the log; structs compare field by field."""
    return F.struct("event_bar_id", "event_order", "event_id")


def is_terminal() -> Column:
    return F.col("event_type").isin("invalidated", "replaced") | (F.col("state_after_event") == "invalidated")


def visible_events(
    events: DataFrame,
    as_of_bar_id: int | None = None,
    as_of_event_id: str | None = None,
    series: Sequence[str] = schemas.SERIES,
) -> DataFrame:
    """Events up to a cursor. An event cursor belongs to the series that hold it; an id that none holds
    is a ``KeyError``, found by a pushed-down lookup before the read is planned."""
    if as_of_event_id is not None:
        hit = events.where(F.col("event_id") == as_of_event_id)
        if not hit.select("event_id").head(1):
            raise KeyError(as_of_event_id)
        at = hit.groupBy(*series).agg(F.min(position()).alias("cursor"))
        return events.join(at, list(series)).where(position() <= F.col("cursor")).drop("cursor")
    if as_of_bar_id is None:
        raise ValueError("Provide as_of_bar_id or as_of_event_id.")
    return events.where(F.col("event_bar_id") <= as_of_bar_id)


def applies(field: str) -> Column:
    """Whether an event sets a field."""
    value = F.col(field)
    given = F.size(value) > 0 if field == "anchor_bar_ids" else value.isNotNull()
    return (F.col("event_type") == "created") | F.array_contains("changed_fields", field) | given


def _payload_fields(events: DataFrame) -> list[str]:
    return events.schema["payload_after"].dataType.fieldNames()


def reduce_states(events: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """Fold all given events into one live row per structure.

    Two aggregations instead of a fold: the last terminal event of each structure, then per field the
    last event after it that sets the field. Values travel in a struct with their position, because
    an event may set a field to null on purpose.
    """
    series = list(series)
    key = [*series, "structure_id"]
    staged = events.withColumn("pos", position())
    ended = staged.groupBy(*key).agg(F.max(F.when(is_terminal(), F.col("pos"))).alias("ended"))
    alive = staged.join(ended, key).where(F.col("ended").isNull() | (F.col("pos") > F.col("ended")))
    last_set = lambda cond, value: F.max(F.when(cond, F.struct("pos", value.alias("v"))))["v"]
    payload = _payload_fields(events)
    reduced = alive.groupBy(*key).agg(
        F.max_by("kind", "pos").alias("kind"), F.max_by("state_after_event", "pos").alias("state"),
        *[last_set(applies(f), F.col(f)).alias(f) for f in COMMON_FIELDS],
        *[
            last_set(F.col("payload_after")[f].isNotNull(), F.col("payload_after")[f]).alias(f"payload_{f}")
            for f in payload
        ],
        F.max_by("reason_codes", "pos").alias("reason_codes"),
        F.min_by("reason_codes", "pos").alias("first_reason_codes"),
    )
    codes = (
        F.coalesce("payload_explanation_codes", "first_reason_codes")
        if "explanation_codes" in payload else F.col("first_reason_codes")
    )
    return reduced.select(
        *key, "kind", "state", *COMMON_FIELDS,
        F.struct(*[F.col(f"payload_{f}").alias(f) for f in payload]).alias("payload"), "reason_codes",
        codes.alias("explanation_codes"),
    )


def states_as_of(
    events: DataFrame,
    as_of_bar_id: int | None = None,
    as_of_event_id: str | None = None,
    series: Sequence[str] = schemas.SERIES,
) -> DataFrame:
    """L01/L02."""
    return reduce_states(visible_events(events, as_of_bar_id, as_of_event_id, series), series)


def states_after_each_event(events: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """The state of a structure after each of its events, null state after a terminal one.

    Windowed by structure: a structure has a handful of events (it settles within the right window of
    its last pivot), so no partition of this window grows with the data.
    """
    series = list(series)
    key = [*series, "structure_id"]
    order = [F.col("event_bar_id"), F.col("event_order"), F.col("event_id")]
    w = Window.partitionBy(*key).orderBy(*order)
    ended = F.when(is_terminal(), 1).otherwise(0)
    staged = events.withColumn(
        "generation", F.coalesce(F.sum(ended).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    g = Window.partitionBy(*key, "generation").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last_set = lambda cond, value: F.last(F.when(cond, F.struct(value.alias("v"))), ignorenulls=True).over(g)["v"]
    payload = _payload_fields(events)
    fields = {f"now_{f}": last_set(applies(f), F.col(f)) for f in COMMON_FIELDS}
    fields["now_codes"] = F.coalesce(
        *([last_set(F.col("payload_after.explanation_codes").isNotNull(), F.col("payload_after.explanation_codes"))]
          if "explanation_codes" in payload else []),
        F.first("reason_codes").over(g),
    )
    return staged.withColumns(fields).select(
        *key, "kind", "event_id", "event_bar_id", "event_order", "event_type",
        F.when(~is_terminal(), F.col("state_after_event")).alias("state"),
        *[F.col(f"now_{f}").alias(f) for f in COMMON_FIELDS], "reason_codes",
        F.col("now_codes").alias("explanation_codes"),
    )


def validity_intervals(events: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """State intervals ``[from_bar_id, to_bar_id)`` per structure; joined to bars they give the
    state at every bar. Only the last event of a bar shows at that bar."""
    series = list(series)
    key = [*series, "structure_id"]
    w = Window.partitionBy(*key).orderBy("event_bar_id", "event_order", "event_id")
    after = states_after_each_event(events, series).withColumn("to_bar_id", F.lead("event_bar_id").over(w))
    return after.where(
        F.col("state").isNotNull() & (F.col("to_bar_id").isNull() | (F.col("to_bar_id") > F.col("event_bar_id")))
    ).select(
        *key, "kind", "state", F.col("event_bar_id").alias("from_bar_id"), "to_bar_id", *COMMON_FIELDS, "reason_codes",
        "explanation_codes",
    )


def live_counts_per_bar(
    events: DataFrame, bars: DataFrame, series: Sequence[str] = schemas.SERIES, span: int = 1 << 16
) -> DataFrame:
    """L08 at every bar at once: live structures by state, as running sums of interval ends, no range join."""
    from barloom.functions.ordered import running

    series = list(series)
    spans = validity_intervals(events, series)
    one = lambda sign, when: F.struct(
        when.alias("bar_id"), (F.when(F.col("state") == "candidate", sign).otherwise(0)).cast("long").alias("candidates"),
        (F.when(F.col("state") == "confirmed", sign).otherwise(0)).cast("long").alias("confirmed"),
    )
    steps = spans.select(*series, F.inline(F.array(one(1, F.col("from_bar_id")), one(-1, F.col("to_bar_id")))))
    steps = steps.where(F.col("bar_id").isNotNull()).groupBy(*series, "bar_id").agg(
        F.sum("candidates").alias("candidates"), F.sum("confirmed").alias("confirmed")
    )
    all_bars = bars.select(*series, "bar_id").join(steps, [*series, "bar_id"], "left")
    return running(
        all_bars.select(*series, "bar_id", "candidates", "confirmed"), series, ["bar_id"],
        {"live_candidates": ("sum", F.coalesce("candidates", F.lit(0))),
         "live_confirmed": ("sum", F.coalesce("confirmed", F.lit(0)))}, span=span,
    ).select(*series, "bar_id", "live_candidates", "live_confirmed")


def transition_violations(
    events: DataFrame, allow_initial_confirmed: bool = False, series: Sequence[str] = schemas.SERIES
) -> DataFrame:
    """Events that break the lifecycle contract, with the reason."""
    series = list(series)
    w = Window.partitionBy(*series, "structure_id").orderBy("event_bar_id", "event_order", "event_id")
    first = F.coalesce(F.lag(is_terminal()).over(w), F.lit(True))
    et, after = F.col("event_type"), F.col("state_after_event")
    opened_right = (et == "created") | (F.lit(allow_initial_confirmed) & (et == "confirmed"))
    problem = (
        F.when((et == "confirmed") & (after != "confirmed"), "confirmed_without_state")
        .when(et.isin("invalidated", "replaced") & (after != "invalidated"), "terminal_without_state")
        .when(first & ~opened_right, "first_event_not_created")
        .when(first & (et == "created") & ~after.isin("candidate", "confirmed"), "created_in_wrong_state")
    )
    return events.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        *series, "event_id", "structure_id", "event_type", "state_after_event", "problem"
    )

