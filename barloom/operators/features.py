"""Bar-to-bar features, moving averages and leg strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import rules, schemas
from barloom.functions.ordered import CHUNK_ROWS, drop_halo, spread_halo
from barloom.functions.scalars import floor_div, long
from barloom.operators.bars import index_bars

SCAN_ROWS = 128
FEATURE_BASE = ("bar_id", "prev_bar_id", "session_id", "session_date", "edge_valid")


def overlap(high: Column, low: Column, prev_high: Column, prev_low: Column) -> Column:
    """F01/F02."""
    return F.greatest(F.lit(0.0), F.least(high, prev_high) - F.greatest(low, prev_low))


def gap(high: Column, low: Column, prev_high: Column, prev_low: Column) -> Column:
    """positive above the previous range, negative below it, else zero."""
    return F.when(low > prev_high, low - prev_high).when(high < prev_low, high - prev_low).otherwise(F.lit(0.0))


def edge_features(bars: DataFrame, series: Sequence[str] = schemas.SERIES, rows: int = CHUNK_ROWS) -> DataFrame:
    """F01-F05 and F11 in one pass over one window: wide features keyed by bar."""
    series = list(series)
    columns = [*series, "bar_index", "bar_id", "session_id", "session_date", "open", "high", "low", "close"]
    spread, w = spread_halo(index_bars(bars, series).select(*columns), series, "bar_index", 1, 0, rows)
    prev = F.lag(F.struct("bar_id", "session_id", "open", "high", "low", "close")).over(w)
    out = drop_halo(spread.withColumn("prev", prev), "bar_index", rows)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    p_top, p_bottom = F.greatest("prev.open", "prev.close"), F.least("prev.open", "prev.close")
    first = F.col("prev").isNull()
    edge = lambda value: F.when(first, F.lit(0.0)).otherwise(value)
    return out.select(
        *series, "bar_index", "bar_id", F.coalesce("prev.bar_id", long(-1)).alias("prev_bar_id"), "session_id",
        "session_date", F.coalesce(F.col("session_id") == F.col("prev.session_id"), F.lit(False)).alias("edge_valid"),
        edge(overlap(F.col("high"), F.col("low"), F.col("prev.high"), F.col("prev.low"))).alias("hl_overlap"),
        edge(overlap(top, bottom, p_top, p_bottom)).alias("body_overlap"),
        edge(gap(F.col("high"), F.col("low"), F.col("prev.high"), F.col("prev.low"))).alias("hl_gap"),
        edge(gap(top, bottom, p_top, p_bottom)).alias("body_gap"),
        F.coalesce(F.col("session_id") != F.col("prev.session_id"), F.lit(False)).alias("session_boundary"),
    )


def to_long_features(wide: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """one row per bar and feature key."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("feature_key"), F.col(k).alias("feature_value")) for k in schemas.EDGE_FEATURE_KEYS
    ])
    return wide.select(*series, *FEATURE_BASE, F.inline(pairs))


def feature_bundle(
    long_rows: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    keys: Sequence[str] = schemas.EDGE_FEATURE_KEYS,
) -> DataFrame:
    """long to wide. The base columns are grouping keys, so rows that disagree stay apart and show up
    in ``misaligned_features`` as incomplete."""
    return long_rows.groupBy(*series, *FEATURE_BASE).agg(
        *[F.max(F.when(F.col("feature_key") == k, F.col("feature_value"))).alias(k) for k in keys]
    )


def misaligned_features(
    bundle: DataFrame,
    bars: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    keys: Sequence[str] = schemas.EDGE_FEATURE_KEYS,
) -> DataFrame:
    """bars without features, features without bars, and bundle rows that lack a feature."""
    on = [*series, "bar_id", "session_id", "session_date"]
    both = bars.select(*on, F.lit(1).alias("__bar")).join(
        bundle.select(*on, F.struct(*keys).alias("__values")), on, "full_outer"
    )
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col("__values")[k].isNull()
    problem = (
        F.when(F.col("__bar").isNull(), "feature_without_bar")
        .when(F.col("__values").isNull(), "bar_without_feature")
        .when(lacking, "feature_missing")
    )
    return both.select(*on, problem.alias("problem")).where(F.col("problem").isNotNull())


def _composed(maps: Column) -> Column:
    """The affine map (a, b), x to a * x + b, that applies ``maps`` in their order."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, one, lambda done, m: F.struct((m["a"] * done["a"]).alias("a"), (m["a"] * done["b"] + m["b"]).alias("b")))


def _carries(maps: DataFrame, series: list[str], names: Sequence[str], rows: int, levels: int) -> DataFrame:
    """What comes into each block (series, block, carry_<name>) of blocks with an affine map per name.

    Blocks are composed in groups of ``rows``, the groups are blocks of the next level, and the last level is ordered per
    series: a row per ``rows ** (levels + 1)`` bars.
    """
    group = [*series, "group"] if levels else series
    placed = maps.withColumn("group", floor_div(F.col("block"), rows)) if levels else maps
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    led = placed.select(*group, "block", *[_composed(F.collect_list(n).over(before)).alias(n) for n in names])
    if not levels:
        return led.select(*series, "block", *[F.col(n)["b"].alias(f"carry_{n}") for n in names])
    whole = placed.groupBy(*group).agg(*[F.sort_array(F.collect_list(F.struct("block", F.col(n).alias("m")))).alias(n) for n in names])
    whole = whole.select(*series, F.col("group").alias("block"), *[_composed(F.col(n)["m"]).alias(n) for n in names])
    above = _carries(whole, series, names, rows, levels - 1).withColumnRenamed("block", "group")
    into = [(F.col(n)["a"] * F.col(f"carry_{n}") + F.col(n)["b"]).alias(f"carry_{n}") for n in names]
    return led.join(above, group).select(*series, "block", *into)


def ema(
    bars: DataFrame,
    lengths: Sequence[int],
    series: Sequence[str] = schemas.SERIES,
    column: str = "close",
    rows: int = SCAN_ROWS,
    levels: int = 2,
) -> DataFrame:
    """exponential moving averages, alpha = 2 / (length + 1), seeded with the first value.

    The recurrence x to keep * x + alpha * value is an affine map, and maps compose: a block of ``rows`` bars is one map,
    found with a running sum of values over powers of ``keep`` (short blocks keep these in range), and a scan over the maps
    gives what comes into each block. No task sees more than a block, and no Python runs.
    """
    lengths = list(dict.fromkeys(int(n) for n in lengths))
    if not lengths or any(n <= 0 for n in lengths):
        raise ValueError("EMA lengths must be positive.")
    if not 1 <= rows <= SCAN_ROWS:
        raise ValueError(f"Blocks have 1 to {SCAN_ROWS} bars.")
    series = list(series)
    names = {f"ema_{n}": 1.0 - 2.0 / (n + 1.0) for n in lengths}
    scanned = {name: keep for name, keep in names.items() if keep > 0.0}  # the average over one bar is the bar
    value = F.when(F.isnan(column) | F.col(column).isNull(), F.raise_error(F.lit("EMA input holds NaN.")).cast("double")).otherwise(F.col(column))
    keyed = index_bars(bars, series).select(
        *series, "bar_index", "bar_id", value.alias("value"), floor_div(F.col("bar_index"), rows).alias("block"),
        F.pmod(F.col("bar_index"), long(rows)).alias("step"),
    )
    so_far = Window.partitionBy(*series, "block").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def within(keep: float) -> Column:
        weight = F.when(F.col("bar_index") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - keep))
        return F.pow(F.lit(keep), F.col("step")) * F.sum(weight * F.col("value") * F.pow(F.lit(1.0 / keep), F.col("step"))).over(so_far)

    local = keyed.select(*series, "bar_index", "bar_id", "block", "step", "value", *[within(keep).alias(n) for n, keep in scanned.items()])
    single = [F.col("value").alias(n) for n in names if n not in scanned]
    if not scanned:
        return local.select(*series, "bar_index", "bar_id", *single)
    maps = local.groupBy(*series, "block").agg(*[
        F.struct(F.pow(F.lit(keep), F.count(F.lit(1))).alias("a"), F.max_by(n, "bar_index").alias("b")).alias(n) for n, keep in scanned.items()])
    fixed = [F.col("value").alias(n) if n not in scanned else (F.col(n) + F.pow(F.lit(keep), F.col("step") + 1) * F.col(f"carry_{n}")).alias(n) for n, keep in names.items()]
    carries = _carries(maps, series, list(scanned), rows, levels)
    return local.join(carries, [*series, "block"]).select(*series, "bar_index", "bar_id", *fixed)


def _pieces(first: Column, end: Column, rows: int, levels: int) -> Column:
    """The bars ``first`` to ``end`` (exclusive) as structs (level, at): single bars at both ends, whole blocks of
    ``rows ** level`` bars between them, so there are at most ``2 * rows`` of a level but the last."""
    parts = []
    named = lambda level: lambda at: F.struct(F.lit(level).alias("level"), at.alias("at"))
    for level in range(levels):
        up, down = floor_div(first + long(rows - 1), rows), floor_div(end, rows)
        whole = F.lit(level < levels - 1) & (up < down)
        for low, high in ((first, F.when(whole, up * rows).otherwise(end)), (F.when(whole, down * rows).otherwise(end), end)):
            some = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
            parts.append(F.transform(some, named(level)))
        first, end = F.when(whole, up).otherwise(long(0)), F.when(whole, down).otherwise(long(0))
    return F.concat(*parts)


def leg_strength(
    legs: DataFrame,
    features: DataFrame,
    series: Sequence[str] = schemas.SERIES,
    threshold: float = rules.LEG_STRENGTH_THRESHOLD,
    rows: int = SCAN_ROWS,
    levels: int = 3,
) -> DataFrame:
    """gap balance of a leg minus its mean overlap, over the valid edges after its start.

    Only edges of a leg enter its sums, in the order of the bars: differences of running totals would keep the rounding
    of all bars before it. A leg asks for its single bars at both ends and for block totals between them, by equal keys.
    """
    series = list(series)
    leg = [*series, "structure_id", "kind", "start_bar_id", "end_bar_id"]
    sums = ["edges", "rise", "fall", "overlap"]
    part = lambda sign: F.greatest(sign * F.col("hl_gap"), F.lit(0.0)) + F.greatest(sign * F.col("body_gap"), F.lit(0.0))
    totals = features.where("edge_valid").select(
        *series, F.lit(0).alias("level"), F.col("bar_index").alias("at"), long(1).alias("edges"), part(F.lit(1.0)).alias("rise"),
        part(F.lit(-1.0)).alias("fall"), (F.col("hl_overlap") + F.col("body_overlap")).alias("overlap"))
    every = totals
    for level in range(1, levels):
        totals = totals.groupBy(*series, floor_div(F.col("at"), rows).alias("at")).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("level", F.lit(level))
        every = every.unionByName(totals)

    ends = F.array(F.struct(F.col("start_bar_id").alias("bar_id"), F.lit(0).alias("side")), F.struct(F.col("end_bar_id").alias("bar_id"), F.lit(1).alias("side")))
    asks = legs.select(*leg, F.explode(ends).alias("e")).select(*leg, "e.*")
    missing = F.raise_error(F.concat(F.lit("A leg lacks a bar: "), F.col("structure_id"))).cast("long")
    told = asks.join(features.select(*series, "bar_id", "bar_index"), [*series, "bar_id"], "left").withColumn("bar_index", F.coalesce("bar_index", missing))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("bar_index")))
    placed = told.groupBy(*leg).agg(side(0).alias("first"), side(1).alias("last"))
    asked = placed.select(*leg, F.explode_outer(_pieces(F.col("first") + 1, F.col("last") + 1, rows, levels)).alias("p")).select(*leg, "p.*")
    # A block is as long as its level says, so its first bar is its place in the leg.
    first_bar = F.col("at") * F.element_at(F.array(*[long(rows**n) for n in range(levels)]), F.col("level") + 1)
    met = asked.join(every, [*series, "level", "at"], "left").groupBy(*leg).agg(
        F.sort_array(F.collect_list(F.when(F.col("edges").isNotNull(), F.struct(first_bar.alias("first_bar"), *sums)))).alias("parts"))
    added = lambda c, zero: F.aggregate("parts", zero, lambda done, e: done + e[c])
    sums_of = met.select(*leg, added("edges", long(0)).alias("edge_count"), *[added(c, F.lit(0.0)).alias(c) for c in sums[1:]])
    sums_of = sums_of.withColumn("penalty", F.when(F.col("edge_count") > 0, F.col("overlap") / F.col("edge_count")))
    balance = F.when(F.col("kind") == "leg_up", F.col("rise") - F.col("fall")).otherwise(F.col("fall") - F.col("rise"))
    score = F.when(F.col("edge_count") == 0, F.lit(0.0)).otherwise(balance - F.col("penalty"))
    return sums_of.select(
        *leg, score.alias("score"), ((F.col("edge_count") > 0) & (score > threshold)).alias("strong"), "edge_count",
    )
