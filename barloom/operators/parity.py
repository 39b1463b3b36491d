"""Two-source reconciliation of minute bars."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import days_of
from barloom.schemas import PARITY_FIELDS

_BAR = ("symbol", "session_date", "minute_key", "bob", "eob", *PARITY_FIELDS)


def assemble_reference(sources: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """Union of neighbouring sources, one row per minute. Differing duplicates are an error."""
    both = sources[0].select(*_BAR)
    for other in sources[1:]:
        both = both.unionByName(other.select(*_BAR))
    row = F.struct(*[c for c in _BAR if c not in ("symbol", "minute_key")])
    merged = both.groupBy("symbol", "minute_key").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    if strict:
        merged = merged.withColumn(
            "low",
            F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
                F.raise_error(F.concat(F.lit("Reference sources disagree for minute "), F.col("low.bob")))
            ),
        )
    return merged.select("symbol", "minute_key", "low.*").select(*_BAR)


def neighbouring_days(reference: DataFrame, trading_day: Column | int, source_day: str = "source_day") -> DataFrame:
    """Rows from the sources of the day before, the day and the day after.

    For a given day the three days are literals, so partitions and row groups are pruned.
    """
    if isinstance(trading_day, int):
        day = datetime.strptime(str(trading_day), "%Y%m%d")
        near = [int((day + timedelta(days=k)).strftime("%Y%m%d")) for k in (-1, 0, 1)]
        return reference.where(F.col(source_day).isin(near))
    target = days_of(trading_day)
    return reference.where(days_of(F.col(source_day)).between(target - 1, target + 1))


def restrict_to_built_range(reference: DataFrame, built: DataFrame) -> DataFrame:
    """Reference minutes inside the built range of the same symbol; no built bars keeps all.

    One row per symbol on the small side; AQE broadcasts it only while it is small.
    """
    span = built.groupBy("symbol").agg(F.min("minute_key").alias("from_minute"), F.max("minute_key").alias("to_minute"))
    return (
        reference.join(span, "symbol", "left")
        .where(F.col("from_minute").isNull() | F.col("minute_key").between(F.col("from_minute"), F.col("to_minute")))
        .drop("from_minute", "to_minute")
    )


def parity_rows(built: DataFrame, reference: DataFrame) -> DataFrame:
    """Full outer comparison per symbol and minute; identity comes from the tick side first."""
    tick = F.struct(*[c for c in _BAR if c not in ("symbol", "minute_key")])
    a = built.select("symbol", "minute_key", tick.alias("tick"))
    b = restrict_to_built_range(reference, built).select("symbol", "minute_key", tick.alias("vendor"))
    both = a.join(b, ["symbol", "minute_key"], "full_outer")
    delta = {f: F.col(f"tick.{f}") - F.col(f"vendor.{f}") for f in PARITY_FIELDS}
    # A NaN delta is unequal to zero. One array test keeps pushed-down filters small.
    differs = F.exists(F.array(*delta.values()), lambda d: d != 0)
    status = (
        F.when(F.col("tick").isNull(), "missing_tick")
        .when(F.col("vendor").isNull(), "missing_vendor")
        .when(differs, "mismatch")
        .otherwise("match")
    )
    who = F.coalesce("tick", "vendor")
    row = F.struct(
        who["session_date"].alias("session_date"), who["bob"].alias("bob"), who["eob"].alias("eob"),
        status.alias("status"),
        *[F.col(f"tick.{f}").alias(f"tick_{f}") for f in PARITY_FIELDS],
        *[F.col(f"vendor.{f}").alias(f"vendor_{f}") for f in PARITY_FIELDS],
        *[delta[f].alias(f"delta_{f}") for f in PARITY_FIELDS],
    )
    # One generated row instead of thirty aliases: a later filter on the status would otherwise make the
    # optimizer enumerate every alias combination of the fields it compares.
    out = both.select("symbol", F.col("minute_key").alias("bar_local_id"), F.inline(F.array(row)))
    return out.select("symbol", "session_date", "bar_local_id", *[c for c in out.columns[3:]])


def _largest(columns: Sequence[str]) -> Column:
    sizes = [F.when(~F.isnan(c), F.abs(c)) for c in columns]
    return F.coalesce(F.max(sizes[0] if len(sizes) == 1 else F.greatest(*sizes)), F.lit(0.0))


def parity_summary(rows: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """P05."""
    status = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        (status("match") + status("mismatch")).alias("compared_rows"), status("match").alias("matched_rows"),
        status("mismatch").alias("mismatched_rows"), status("missing_tick").alias("missing_tick_rows"),
        status("missing_vendor").alias("missing_vendor_rows"),
        _largest([f"delta_{f}" for f in ("open", "high", "low", "close")]).alias("max_abs_price_delta"),
        _largest(["delta_volume"]).alias("max_abs_volume_delta"),
        _largest(["delta_amount"]).alias("max_abs_amount_delta"),
        _largest(["delta_position"]).alias("max_abs_position_delta"),
    )


def mismatch_sample(rows: DataFrame, max_mismatches: int = 20) -> DataFrame:
    """Field mismatches first, then minutes missing on the vendor side, then on the tick side.

    The three parts are top-k reports per symbol; each part is cut to its own bound before the parts
    are ranked together, so the ranking window sees at most ``3 * max_mismatches`` rows per symbol.
    """
    nan = F.lit(float("nan"))
    entry = lambda order, field: F.struct(
        F.lit(order).alias("field_order"), F.lit(field).alias("field"),
        F.col(f"tick_{field}").alias("tick_value"), F.col(f"vendor_{field}").alias("vendor_value"),
    )
    fields = F.array(*[entry(i, f) for i, f in enumerate(PARITY_FIELDS_REPORTED)])
    laid = rows.where(F.col("status") != "match").select(
        "symbol", "status", "bar_local_id", "bob", F.inline(fields)
    ).withColumn("delta", F.col("tick_value") - F.col("vendor_value"))
    one_sided = F.col("status") != "mismatch"
    part = F.when(F.col("status") == "mismatch", 0).when(F.col("status") == "missing_vendor", 1).otherwise(2)
    ordered = laid.where(F.when(one_sided, F.col("field") == "close").otherwise(F.col("delta") != 0)).select(
        "symbol", part.alias("part"), "bar_local_id", "bob", "field_order",
        F.when(one_sided, F.col("status")).otherwise(F.col("field")).alias("field"),
        F.when(one_sided, F.coalesce("tick_value", nan)).otherwise(F.col("tick_value")).alias("tick_value"),
        F.when(one_sided, F.coalesce("vendor_value", nan)).otherwise(F.col("vendor_value")).alias("vendor_value"),
        F.when(one_sided, nan).otherwise(F.col("delta")).alias("delta"),
    )
    in_part = Window.partitionBy("symbol", "part").orderBy("bar_local_id", "field_order")
    bound = F.when(F.col("part") == 0, min(max_mismatches, 10)).otherwise(max_mismatches)
    # row_number <= bound per group: Spark keeps only the first rows of each group before the shuffle.
    cut = ordered.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= max_mismatches)
    cut = cut.where(F.col("rank") <= bound)
    overall = Window.partitionBy("symbol").orderBy("part", "bar_local_id", "field_order")
    return (
        cut.withColumn("rank", F.row_number().over(overall).cast("long"))
        .where(F.col("rank") <= max_mismatches)
        .select("symbol", "rank", "bob", "field", "tick_value", "vendor_value", "delta")
    )


PARITY_FIELDS_REPORTED = ("open", "high", "low", "close", "volume", "amount", "position")
