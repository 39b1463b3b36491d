"""Jobs that read sources, build a dataset, and write it with its profile."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.operators import bars as b
from barloom.operators import continuous, derived, features, ingest, legs, lifecycle, major_lh, parity, pivots
from barloom.operators.bars import index_bars
from barloom.operators.windows import WindowSpec, select_window
from barloom.plans import chain, indexes
from barloom.session import cut_lineage, stages
from barloom.sources import csv_sources, datasets


def _store(df: DataFrame, path: str, kind: str, profile, by: Sequence[str] = ("symbol",), **provenance) -> DataFrame:
    datasets.write_dataset(df, f"{path}/data", kind, by)
    stored = datasets.scan(df.sparkSession, f"{path}/data")
    datasets.write_profile(profile(stored, by), f"{path}/profile", provenance)
    return stored


def canonical_bar_job(spark: SparkSession, csv_path: str, out: str, data_version: str, symbol: str | None = None) -> DataFrame:
    """Minute CSV to checked canonical bars; with ``symbol`` any other symbol is an error."""
    with stages(spark):
        raw = cut_lineage(csv_sources.read_minute_csv(spark, csv_path))  # parsed once, checked and converted from here
        problems = ingest.raw_minute_problems(raw, symbol)
        ingest.require_clean(problems, "null_values", *(["extra_symbols"] if symbol else [])).write.format("noop").mode("overwrite").save()
        made = ingest.require_aligned(ingest.canonical_minute_bars(raw))
        checks = ingest.require_clean(
            ingest.series_violations(made, ["symbol", "timeframe"]), "duplicate_bar_ids", "sessions_going_back", "nan_prices")
        checks.write.format("noop").mode("overwrite").save()
        return _store(made, out, "bars", datasets.profile_bars, data_version=data_version, source=csv_path)


def trade_job(
    spark: SparkSession, csv_path: str, out: str, exchange: str, zone: str, data_version: str, symbol_column: str | None = None
) -> DataFrame:
    """Tick CSV to normalised trades, in one pass: foreign rows fail the job while it runs."""
    ticks = ingest.require_own_instrument(csv_sources.read_tick_csv(spark, csv_path, symbol_column=symbol_column))
    made = ingest.trades_from_ticks(ticks, exchange, zone)
    return _store(made, out, "trades", datasets.profile_trades, data_version=data_version, source=csv_path)


def contract_bar_job(spark: SparkSession, trades_path: str, out: str, data_version: str) -> DataFrame:
    """Stored trades to 1-minute contract bars."""
    trades = datasets.scan(spark, f"{trades_path}/data")
    return _store(b.bars_from_trades(trades), out, "bars", datasets.profile_bars, data_version=data_version, source=trades_path)


def continuous_job(
    spark: SparkSession, bars_path: str, out: str, root: str, data_version: str, month_rank: str = "documented"
) -> DataFrame:
    """Stored contract bars of one root to the stitched continuous series."""
    components = continuous.component_bars(datasets.scan(spark, f"{bars_path}/data"), root)
    made = continuous.stitch_continuous(components, continuous.select_front_contracts(components, month_rank))
    return _store(made, out, "bars", datasets.profile_bars, data_version=data_version, source=bars_path)


def family_window(
    spark: SparkSession, bars_path: str, symbol: str, session_profile: str, timeframe: str, window: WindowSpec,
    columns: Sequence[str] | None = None, years: Sequence[int] | None = None, index_path: str | None = None,
) -> DataFrame:
    """One symbol's family cut to a window. Symbol and year prune folders before anything is read.

    With ``index_path``, the folder of ``family_index_job``, the window's first and last session are known before any bar
    is derived: only these sessions are read, and numbered from the bars that the series has before them. Without it all
    years are read unless given: the bars around a session may lie in any of them, few as a family may have in a year.
    """
    mine = F.col("symbol") == symbol
    if index_path is None:
        family = b.derive_family(datasets.scan(spark, f"{bars_path}/data", years, where=mine), session_profile, timeframe)
    else:
        asked = mine & (F.col("session_profile") == session_profile) & (F.col("timeframe") == timeframe)
        span = indexes.window_sessions(spark.read.parquet(index_path).where(asked), window)
        inside = F.col("session_date").between(span.first_session, span.last_session) if span else F.lit(False)
        stored = datasets.scan(spark, f"{bars_path}/data", span.years if span else None, where=mine & inside)
        family = b.index_bars(b.derive_family(stored, session_profile, timeframe))
        family = family.withColumn("bar_index", F.col("bar_index") + (span.bars_before if span else 0))
    picked = select_window(family, window)
    return picked.select(*columns) if columns else picked


def family_index_job(spark: SparkSession, bars_path: str, out: str, families: Sequence[tuple[str, str]]) -> DataFrame:
    """The session index of (profile, timeframe) families of stored minute bars, in folders by symbol."""
    counted = indexes.session_counts(datasets.scan(spark, f"{bars_path}/data"), families)
    counted.hint("rebalance", F.col("symbol")).write.mode("overwrite").partitionBy("symbol").parquet(out)
    return spark.read.parquet(out)


def edge_feature_job(bars: DataFrame, out: str, data_version: str, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """the four edge features as long rows, one pass over the bars."""
    rows = features.to_long_features(features.edge_features(bars, series), series)
    by = ["symbol", "feature_key"]
    return _store(rows, out, "features", datasets.profile_features, by, data_version=data_version)


def parity_job(
    trades: DataFrame, reference: Sequence[DataFrame], out: str, data_version: str, minutes: int = 1,
    trading_day: int | None = None, max_mismatches: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Trades to stored bars, compared with the assembled reference. Rows, profile and the mismatch sample are stored.

    For one trading day only the reference sources of that day and its neighbours are read (P02).
    """
    spark = trades.sparkSession
    bars = _store(b.bars_from_trades(trades, minutes=minutes), f"{out}/bars", "bars", datasets.profile_bars, data_version=data_version)
    built = b.minute_view(bars, minutes=minutes)
    if trading_day is not None:
        reference = [parity.neighbouring_days(r, trading_day) for r in reference]
    rows = _store(parity.parity_rows(built, parity.assemble_reference(reference)), out, "parity", datasets.profile_parity, data_version=data_version)
    parity.mismatch_sample(rows, max_mismatches).write.mode("overwrite").parquet(f"{out}/mismatches")
    return rows, spark.read.parquet(f"{out}/mismatches")


# Builds (objects, events) of a kind from the datasets by name: "bars", "anchors", and per kind "<kind>" and "<kind>.events".
Builder = Callable[[Mapping[str, DataFrame]], tuple[DataFrame, DataFrame]]


def kind_builders(series: Sequence[str] = schemas.SERIES) -> dict[str, tuple[tuple[str, ...], Builder]]:
    """The kinds of the rulebook: for each the kinds it is built from, and its builder."""
    series = list(series)

    def tier(name: str) -> Builder:
        def build(of: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
            mine = of["anchors"].where(F.col("kind_group") == name)
            return pivots.pivot_objects(mine, series), pivots.pivot_events(mine, series)
        return build

    def leg(of: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        visible = lifecycle.reduce_states(of["pivot.events"], series)
        found = legs.legs_from_pivots(legs.priced(visible, of["bars"], series), series=series)
        return found, derived.leg_events(of["anchors"], of["bars"], series)

    def major(of: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        found = major_lh.major_lower_highs(of["leg"], of["bars"], series)
        return found, derived.major_lh_events(of["leg.events"], of["bars"], series)

    return {"pivot_st": ((), tier("pivot_st")), "pivot": ((), tier("pivot")), "leg": (("pivot",), leg), "major_lh": (("leg",), major)}


def in_order_of_need(builders: Mapping[str, tuple[Sequence[str], Builder]]) -> list[str]:
    """Kinds so that each comes after those it is built from; a need that nobody builds, or a circle, is an error."""
    unknown = sorted({n for needs, _ in builders.values() for n in needs} - set(builders))
    if unknown:
        raise ValueError(f"No builder for kinds {unknown}.")
    return list(TopologicalSorter({k: needs for k, (needs, _) in builders.items()}).static_order())


def structure_job(
    bars: DataFrame, out: str, data_version: str, series: Sequence[str] = schemas.SERIES, may_be_empty: Sequence[str] = ("major_lh",),
    builders: Mapping[str, tuple[Sequence[str], Builder]] | None = None,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Objects and events of every kind, stored by kind, symbol and year with profiles, and read back.

    Bars are stored with ``bar_index``. Legs are built from the stored pivots and major lower highs from the stored legs.
    ``builders`` adds kinds of the caller's own, or replaces kinds: (kinds it needs, builder) by name; every kind is built
    after those it needs, from their stored datasets. A kind without rows is an error unless it may be empty. The extents
    of all datasets are stored beside them, for ``stored_chart_window``.
    """
    spark = bars.sparkSession
    every = {**kind_builders(series), **(builders or {})}
    order = in_order_of_need(every)
    with stages(spark):
        # Numbering reads its input twice; what is numbered is stored as the dataset itself.
        numbered = bars if "bar_index" in bars.columns else index_bars(cut_lineage(bars), series)
        datasets.write_dataset(numbered, f"{out}/bars/data", "bars")
        numbered = datasets.scan(spark, f"{out}/bars/data")
        of = {"bars": numbered, "anchors": cut_lineage(pivots.pivot_anchors(numbered, series=series))}
        reach = [indexes.extents(numbered, "bars")]
        found = {}

        def store(kind: str, part: str, df: DataFrame, profile: Callable[[DataFrame], DataFrame]) -> DataFrame:
            path = f"{out}/{part}/kind_group={kind}"
            datasets.write_dataset(df, f"{path}/data", part)
            stored = datasets.scan(spark, f"{path}/data", schema=T.StructType([*df.schema.fields, T.StructField("year", T.LongType())]))
            if kind not in may_be_empty or stored.head(1):
                datasets.write_profile(profile(stored), f"{path}/profile", {"data_version": data_version})
            return stored

        # Objects and events of a kind do not need each other, so both are written at the same time.
        parts = (("structures", datasets.profile_structures), ("events", datasets.profile_events))
        with ThreadPoolExecutor(len(parts)) as pool:
            for kind in order:
                built = every[kind][1](of)
                writes = [pool.submit(store, kind, part, df, profile) for (part, profile), df in zip(parts, built)]
                found[kind] = tuple(w.result() for w in writes)
                of[kind], of[f"{kind}.events"] = found[kind]
                reach += [indexes.extents(stored, part, kind) for (part, _), stored in zip(parts, found[kind])]
        chain.union_all(reach).hint("rebalance").sortWithinPartitions("symbol", "part", "year").write.mode("overwrite").parquet(f"{out}/extents")
        return found
