"""One query per operator, over whole tables. Names start with the operator id of the survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import rules, schemas
from barloom.functions.scalars import NS_PER_DAY, floor_div, long, minute_text, yyyymmdd
from barloom.operators import bars as b
from barloom.operators import continuous, derived, features, ingest, legs, lifecycle, major_lh, overlays, parity, pivots, replay, windows
from barloom.plans import chain, chart, jobs
from barloom.session import cut_lineage, shared_folder
from barloom.sources import csv_sources, datasets
from barloom.streaming import live
from barloom.workbench import feed

Query = Callable[[SparkSession, str], DataFrame]
SERIES = feed.SERIES
QUERIES: dict[str, Query] = {}

# Cursors and windows of the read queries, as (bar id, session) inside the derived feed.
CURSOR_BAR = 28401650
CENTER_BAR = 28401600
WINDOW_SESSION = 20240101
EMA_LENGTHS = (3, 9, 20)
WINDOW = windows.WindowSpec(center_bar_id=CENTER_BAR, left_bars=60, right_bars=60, buffer_bars=5)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/barloom-{uuid.uuid4().hex}"


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Plain columns for comparison: arrays as text, doubles to six digits, nulls of ids and texts filled."""
    df = df.select(*columns) if columns else df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit(""))
        elif isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType)):
            c = F.coalesce(c.cast("long"), long(-1))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), F.round(c, 6))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


BAR = ("symbol", "bar_id", "ts_utc_ns", "ts_local_ns", "session_id", "session_date", "open", "high", "low", "close",
       "volume", "turnover", "open_interest")
STRUCTURE = ("symbol", "structure_id", "kind", "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "session_id",
             "session_date", "anchor_bar_ids", "explanation_codes")
EVENT = ("symbol", "event_id", "structure_id", "kind", "event_type", "event_bar_id", "event_order", "state_after_event",
         "reason_codes", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchor_bar_ids", "successor_structure_id",
         "changed_fields", "session_id", "session_date")
OVERLAY = ("symbol", "overlay_id", "kind", "source_structure_id", "anchor_bars", "anchor_prices", "style_key",
           "display_label")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense bars with positions, stored once for the operators that read them several times."""
    return chain.stored_index(feed.dense_bars(spark, sf_dir))


def anchors(bars: DataFrame) -> DataFrame:
    return cut_lineage(pivots.pivot_anchors(bars))


def structure_tier(a: DataFrame, tier: str = "pivot") -> DataFrame:
    return a.where(F.col("kind_group") == tier)


def raw_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense bars as raw minute rows in text form; the local column carries the wall clock."""
    d = feed.dense_bars(spark, sf_dir)
    text = lambda ns, zone: minute_text(floor_div(ns, 60_000_000_000), zone)
    return d.select(
        text(F.col("ts_utc_ns"), "+00:00").alias("ts_event"), "open", "high", "low", "close", "volume", "symbol",
        text(F.col("ts_local_ns"), "+08:00").alias("ET_datetime"),
    )


# --- Sources -----------------------------------------------------------------------------------


@query
def S01_minute_csv(spark, d):
    path = scratch(spark)
    raw_minutes(spark, d).write.option("header", True).csv(path)
    return flat(csv_sources.read_minute_csv(spark, path))


@query
def S02_tick_csv(spark, d):
    path = scratch(spark)
    feed.ticks(spark, d).drop("symbol").write.option("header", True).csv(path)
    rows = csv_sources.read_tick_csv(spark, path, sequence="row_no", symbol_column="InstrumentID")
    return flat(rows, "symbol", "row_no", "TradingDay", "UpdateTime", "UpdateMillisec", "LastPrice", "Volume", "Turnover", "OpenInterest")


def tick_files(spark, d, path):
    """One CSV file for each symbol and trading day, its rows in order and without a number."""
    ticks = feed.ticks(spark, d).withColumns({"of": F.col("symbol"), "day": F.col("TradingDay")})
    placed = ticks.repartition("of", "day").sortWithinPartitions("of", "day", "row_no")
    placed.drop("symbol", "row_no").write.partitionBy("of", "day").option("header", True).csv(path)


@query
def S02_tick_csv_numbered(spark, d):
    path = scratch(spark)
    tick_files(spark, d, path)
    rows = csv_sources.read_tick_csv(spark, path, symbol_column="InstrumentID")
    return flat(rows, "symbol", "row_no", "TradingDay", "UpdateTime", "UpdateMillisec", "LastPrice", "Volume", "Turnover", "OpenInterest")


@query
def S03_reference_minute_csv(spark, d):
    path = scratch(spark)
    feed.reference_minutes(feed.hour_view(spark, d)).drop("session_date", "minute_key").write.option("header", True).csv(path)
    return flat(csv_sources.read_reference_minute_csv(spark, path))


def stored_bars(spark, d):
    path = scratch(spark)
    datasets.write_dataset(feed.dense_bars(spark, d), path, "bars")
    return path


@query
def S04_bar_scan(spark, d):
    rows = datasets.scan(spark, stored_bars(spark, d), years=[2024], columns=["symbol", "bar_id", "open", "close"],
                         where=F.col("bar_id") >= CENTER_BAR)
    return flat(rows)


@query
def S05_legacy_bar_scan(spark, d):
    path = scratch(spark)
    old = feed.dense_bars(spark, d).withColumnRenamed("ts_local_ns", "ts_et_ns").drop("turnover", "open_interest", "session_profile")
    old.withColumn("year", datasets.year_of(F.col("session_date"))).write.partitionBy("year").parquet(path)
    return flat(datasets.scan_legacy_bars(spark, path), *BAR)


@query
def S06_trade_scan(spark, d):
    path = scratch(spark)
    datasets.write_dataset(feed.trades(spark, d), path, "trades")
    return flat(datasets.scan(spark, path, columns=["symbol", "event_order", "session_date", "price", "size"]))


@query
def S07_feature_scan(spark, d):
    path = scratch(spark)
    rows = features.to_long_features(features.edge_features(indexed(spark, d)))
    datasets.write_dataset(rows, path, "features", by=["feature_key"])
    one = datasets.scan(spark, path, where=F.col("feature_key") == "hl_gap")
    return flat(one, "symbol", "bar_id", "prev_bar_id", "edge_valid", "feature_value")


def stored_structures(spark, d):
    path = scratch(spark)
    found = chain.structures_v1(indexed(spark, d))
    datasets.write_dataset(found["pivot"], f"{path}/dataset=structures/kind=pivot", "structures")
    datasets.write_dataset(found["leg"], f"{path}/kind=leg", "structures")
    return path


@query
def S08_structure_scan(spark, d):
    return flat(datasets.scan_structures(spark, stored_structures(spark, d), "leg"), *STRUCTURE)


@query
def S09_structure_bundle(spark, d):
    return flat(datasets.structure_bundle(spark, stored_structures(spark, d), ["pivot", "leg"]), *STRUCTURE)


@query
def S10_event_scan(spark, d):
    path = scratch(spark)
    datasets.write_dataset(pivots.pivot_events(structure_tier(anchors(indexed(spark, d)))), path, "events")
    return flat(datasets.scan(spark, path, where=F.col("event_bar_id") <= CURSOR_BAR), *EVENT)


@query
def S11_parity_scan(spark, d):
    path = scratch(spark)
    datasets.write_dataset(parity_rows_of(spark, d), path, "parity")
    return flat(datasets.scan(spark, path, where=F.col("status") != "match"), "symbol", "bar_local_id", "status", "delta_volume", "delta_close")


# --- Ingest ------------------------------------------------------------------------------------


@query
def N01_canonical_minute_bars(spark, d):
    return flat(ingest.canonical_minute_bars(raw_minutes(spark, d)), *BAR)


@query
def N02_session_dates(spark, d):
    made = ingest.canonical_minute_bars(raw_minutes(spark, d))
    return flat(made.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("bars"), F.min("bar_id").alias("first_bar_id")))


@query
def N03_raw_validation(spark, d):
    raw = raw_minutes(spark, d)
    holes = raw.withColumn("volume", F.when(F.col("volume") > 100, F.col("volume")))
    return flat(ingest.raw_minute_problems(holes))


@query
def N04_minute_alignment(spark, d):
    rows = feed.trades(spark, d)
    return flat(ingest.misaligned_rows(rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("misaligned")))


@query
def N05_series_invariants(spark, d):
    # Faults are put in on purpose: repeated ids, sessions that go back, NaN prices.
    bars = feed.dense_bars(spark, d)
    bad = bars.where(F.pmod("bar_id", long(50)) == 0).withColumns(
        {"session_date": F.col("session_date") - 1, "close": F.lit(float("nan"))}
    )
    shifted = bars.where(F.pmod("bar_id", long(70)) == 0).withColumns(
        {"bar_id": F.col("bar_id") + 100000, "session_date": F.col("session_date") - 5}
    )
    return flat(ingest.series_violations(bars.unionByName(bad).unionByName(shifted)),
                "symbol", "duplicate_bar_ids", "sessions_going_back", "nan_prices")


@query
def N06_cumulative_deltas(spark, d):
    return flat(ingest.tick_deltas(feed.ticks(spark, d)), "symbol", "TradingDay", "row_no", "size", "turnover_delta")


@query
def N07_trade_filter(spark, d):
    rows = ingest.tick_deltas(feed.ticks(spark, d)).where(ingest.is_trade(F.col("LastPrice"), F.col("size")))
    return flat(rows.groupBy("symbol", "TradingDay").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("size")))


@query
def N08_exchange_time(spark, d):
    return flat(feed.trades(spark, d), "symbol", "session_date", "event_order", "ts_local_ns", "ts_utc_ns")


@query
def N09_trade_identity(spark, d):
    return flat(feed.trades(spark, d), "event_id", "event_order", "symbol", "instrument_id", "exchange", "session_id",
                "event_action", "source_event_ref", "bid_price_1", "bid_size_1", "ask_price_1", "ask_size_1")


@query
def N10_instrument_check(spark, d):
    odd = feed.ticks(spark, d).withColumn(
        "InstrumentID", F.when(F.pmod("row_no", long(40)) == 0, "other").when(F.pmod("row_no", long(41)) == 0, "").otherwise(F.col("InstrumentID"))
    )
    return flat(ingest.foreign_instruments(odd), "symbol", "TradingDay", "row_no", "InstrumentID")


# --- Datasets and profiles ---------------------------------------------------------------------


@query
def K01_year_partitioned_write(spark, d):
    stored = spark.read.parquet(stored_bars(spark, d))
    return flat(stored.groupBy("symbol", "year").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.min("bar_id").alias("first_bar_id")))


@query
def K02_bar_profile(spark, d):
    return flat(datasets.profile_bars(feed.dense_bars(spark, d)))


@query
def K03_trade_profile(spark, d):
    return flat(datasets.profile_trades(feed.trades(spark, d)))


@query
def K04_feature_profile(spark, d):
    return flat(datasets.profile_features(features.to_long_features(features.edge_features(indexed(spark, d)))))


@query
def K05_structure_profile(spark, d):
    return flat(datasets.profile_structures(pivots.pivot_objects(anchors(indexed(spark, d)))))


@query
def K06_event_profile(spark, d):
    return flat(datasets.profile_events(pivots.pivot_events(anchors(indexed(spark, d)))))


@query
def K07_parity_profile(spark, d):
    return flat(datasets.profile_parity(parity_rows_of(spark, d)))


# --- Bars --------------------------------------------------------------------------------------


@query
def B01_minute_bars(spark, d):
    return flat(b.bars_from_trades(feed.dense_trades(spark, d)), *BAR)


@query
def B02_minute_view_of_trades(spark, d):
    return flat(b.minute_view_from_trades(feed.dense_trades(spark, d)))


@query
def B03_session_filter(spark, d):
    return flat(b.filter_session_profile(feed.dense_bars(spark, d), "rth"), *BAR)


@query
def B04_minutes_since_anchor(spark, d):
    local = F.col("ts_local_ns")
    return flat(feed.dense_bars(spark, d).select(
        "symbol", "bar_id", b.minutes_since_anchor(local, "rth").alias("since_rth"), b.minutes_since_anchor(local, "eth_full").alias("since_eth")))


@query
def B05_five_minute_bars(spark, d):
    return flat(b.aggregate_minutes(feed.dense_bars(spark, d), 5, "eth_full"), *BAR)


@query
def B06_rth_three_minute_family(spark, d):
    return flat(b.derive_family(feed.dense_bars(spark, d), "rth", "3m"), *BAR)


@query
def B09_family_window(spark, d):
    path = scratch(spark)
    datasets.write_dataset(feed.dense_bars(spark, d).drop("session_profile"), f"{path}/data", "bars")
    spec = windows.WindowSpec(session_date=WINDOW_SESSION, right_bars=2)
    jobs.family_index_job(spark, path, f"{path}/families", [("eth_full", "5m"), ("rth", "3m")])
    return flat(jobs.family_window(spark, path, "click", "eth_full", "5m", spec, BAR, index_path=f"{path}/families"))


@query
def B09_family_index(spark, d):
    """Bars per session of two families with their running total, as the job stored them."""
    path = scratch(spark)
    datasets.write_dataset(feed.dense_bars(spark, d).drop("session_profile"), f"{path}/data", "bars")
    found = jobs.family_index_job(spark, path, f"{path}/families", [("eth_full", "5m"), ("rth", "3m")])
    return flat(found, "symbol", "session_profile", "timeframe", "session_date", "bars", "bars_before", "first_bar_id", "last_bar_id")


@query
def B10_minute_view_of_bars(spark, d):
    return flat(b.minute_view(feed.dense_bars(spark, d)))


@query
def B11_contract_bar_job(spark, d):
    path = scratch(spark)
    datasets.write_dataset(feed.trades(spark, d), f"{path}/t/data", "trades")
    return flat(jobs.contract_bar_job(spark, f"{path}/t", f"{path}/b", "v1"), *BAR)


@query
def B12_canonical_bar_job(spark, d):
    path = scratch(spark)
    raw_minutes(spark, d).write.option("header", True).csv(f"{path}/csv")
    return flat(jobs.canonical_bar_job(spark, f"{path}/csv", f"{path}/bars", "v1"), *BAR)


@query
def B13_trade_job(spark, d):
    path = scratch(spark)
    tick_files(spark, d, f"{path}/csv")
    stored = jobs.trade_job(spark, f"{path}/csv", f"{path}/out", feed.EXCHANGE, feed.ZONE, "v1", symbol_column="InstrumentID")
    return flat(stored, "symbol", "session_date", "event_order", "price", "size", "turnover_delta", "open_interest")


# --- Continuous contract -----------------------------------------------------------------------


@query
def C01_contract_session_stats(spark, d):
    return flat(continuous.contract_session_stats(feed.contract_bars(spark, d)))


@query
def C02_selection_stats(spark, d):
    return flat(continuous.selection_stats(continuous.contract_session_stats(feed.contract_bars(spark, d))))


@query
def C03_front_contract(spark, d):
    return flat(continuous.select_front_contracts(feed.contract_bars(spark, d)))


@query
def C04_stitched_series(spark, d):
    bars = cut_lineage(feed.contract_bars(spark, d))
    return flat(continuous.stitch_continuous(bars, continuous.select_front_contracts(bars)), *BAR)


@query
def C05_contract_symbols(spark, d):
    odd = feed.contract_bars(spark, d).select(F.when(F.pmod("bar_id", long(3)) == 0, F.concat(F.col("symbol"), F.lit("x"))).otherwise(F.upper("symbol")).alias("symbol"))
    return flat(odd.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).select(
        "symbol", "bars", continuous.contract_root(F.col("symbol")).alias("root"), continuous.contract_month(F.col("symbol")).alias("month")))


@query
def C06_component_bars(spark, d):
    both = feed.contract_bars(spark, d).unionByName(feed.dense_bars(spark, d).drop("session_profile"))
    return flat(continuous.component_bars(both, "AG").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")))


@query
def C07_continuous_job(spark, d):
    path = scratch(spark)
    datasets.write_dataset(feed.contract_bars(spark, d), f"{path}/c/data", "bars")
    return flat(jobs.continuous_job(spark, f"{path}/c", f"{path}/v0", "ag", "v1"), *BAR)


# --- Parity ------------------------------------------------------------------------------------


def parity_rows_of(spark, d):
    view = feed.hour_view(spark, d)
    return parity.parity_rows(view, feed.reference_minutes(view))


def reference_sources(spark, d):
    v = feed.reference_minutes(feed.hour_view(spark, d))
    odd = F.pmod(floor_div(F.col("minute_key"), 60), long(4))
    return [v.where(odd != 0), v.where(odd != 1)]


@query
def P01_reference_assembly(spark, d):
    return flat(parity.assemble_reference(reference_sources(spark, d)))


@query
def P02_neighbouring_days(spark, d):
    v = feed.reference_minutes(feed.hour_view(spark, d)).withColumn("source_day", F.col("session_date"))
    return flat(parity.neighbouring_days(v, 20240110), "symbol", "minute_key", "source_day")


@query
def P03_range_restriction(spark, d):
    # The reference starts and ends three days before the built bars.
    view = feed.hour_view(spark, d)
    early = feed.reference_minutes(view).withColumn("minute_key", F.col("minute_key") - 3 * 1440)
    return flat(parity.restrict_to_built_range(early, view), "symbol", "minute_key", "close")


@query
def P04_parity_rows(spark, d):
    return flat(parity_rows_of(spark, d))


@query
def P05_parity_summary(spark, d):
    return flat(parity.parity_summary(parity_rows_of(spark, d)))


@query
def P06_mismatch_sample(spark, d):
    return flat(parity.mismatch_sample(parity_rows_of(spark, d)))


@query
def P07_parity_job(spark, d):
    rows, _ = jobs.parity_job(feed.trades(spark, d), reference_sources(spark, d), scratch(spark), "v1", minutes=60)
    return flat(rows.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("minutes"), F.sum(F.abs("delta_volume")).alias("volume_off")))


# --- Features ----------------------------------------------------------------------------------


def _feature(name):
    def run(spark, d):
        return flat(features.edge_features(feed.dense_bars(spark, d)), "symbol", "bar_id", name)
    return run


for _id, _key in (("F01", "hl_overlap"), ("F02", "body_overlap"), ("F03", "hl_gap"), ("F04", "body_gap"), ("F11", "session_boundary")):
    QUERIES[f"{_id}_{_key}"] = _feature(_key)


@query
def F05_edge_frame(spark, d):
    return flat(features.edge_features(feed.dense_bars(spark, d)), "symbol", *features.FEATURE_BASE)


@query
def F06_feature_job(spark, d):
    rows = jobs.edge_feature_job(feed.dense_bars(spark, d), scratch(spark), "v1")
    return flat(rows.groupBy("symbol", "feature_key").agg(F.count(F.lit(1)).alias("edges"), F.sum("feature_value").alias("total")))


@query
def F07_feature_bundle(spark, d):
    rows = features.to_long_features(features.edge_features(feed.dense_bars(spark, d)))
    return flat(features.feature_bundle(rows), "symbol", "bar_id", "prev_bar_id", "edge_valid", *schemas.EDGE_FEATURE_KEYS)


@query
def F08_bundle_alignment(spark, d):
    # Faults are put in on purpose: bars, edges and single features that are missing.
    bars = indexed(spark, d)
    rows = features.to_long_features(features.edge_features(bars))
    dented = rows.where((F.pmod("bar_id", long(90)) != 0) & ((F.pmod("bar_id", long(80)) != 0) | (F.col("feature_key") != "hl_gap")))
    kept = bars.where(F.pmod("bar_id", long(70)) != 0)
    return flat(features.misaligned_features(features.feature_bundle(dented), kept), "symbol", "bar_id", "problem")


@query
def F09_ema(spark, d):
    return flat(features.ema(feed.dense_bars(spark, d), EMA_LENGTHS), "symbol", "bar_id", *[f"ema_{n}" for n in EMA_LENGTHS])


@query
def F12_leg_strength(spark, d):
    bars = indexed(spark, d)
    found = legs.legs_from_pivots(pivots.resolved_pivots(anchors(bars)))
    scored = features.leg_strength(found, features.edge_features(bars))
    return flat(scored, "symbol", "structure_id", "kind", "score", "strong", "edge_count")


# --- Structures --------------------------------------------------------------------------------


@query
def T01_strict_pivot_scan(spark, d):
    s = pivots.strict_pivots(feed.dense_bars(spark, d))
    return flat(s.where("pivot_high or pivot_low"), "symbol", "bar_id", "pivot_high", "pivot_low")


@query
def T02_tail_candidates(spark, d):
    s = pivots.strict_pivots(feed.dense_bars(spark, d))
    return flat(s.where("tail_high or tail_low"), "symbol", "bar_id", "tail_high", "tail_low")


@query
def T03_cross_session_windows(spark, d):
    s = pivots.strict_pivots(feed.dense_bars(spark, d))
    return flat(s.where("cross_session_window"), "symbol", "bar_id", "session_id")


@query
def T04_pivots_v1(spark, d):
    return flat(pivots.pivots_v1(feed.dense_bars(spark, d)), *STRUCTURE)


@query
def T05_pivot_anchors(spark, d):
    a = pivots.pivot_anchors(feed.dense_bars(spark, d))
    return flat(a, "symbol", "kind", "bar_id", "bar_index", "price", "crosses")


@query
def T06_violation_replacement(spark, d):
    a = pivots.pivot_anchors(feed.dense_bars(spark, d))
    return flat(a.select("symbol", "kind", "bar_id", "state", F.col("hit.bar_id").alias("hit_bar_id"),
                         F.coalesce("hit.qualifies", F.lit(False)).alias("replaced"), "successor_structure_id"))


@query
def T07_pivot_objects(spark, d):
    return flat(pivots.pivot_objects(pivots.pivot_anchors(feed.dense_bars(spark, d))), *STRUCTURE)


@query
def T08_pivot_events(spark, d):
    e = pivots.pivot_events(pivots.pivot_anchors(feed.dense_bars(spark, d)))
    pay = [F.col(f"payload_after.{f}").alias(f"payload_{f}") for f in ("extreme_price", "left_window", "explanation_codes")]
    return flat(e.select(*EVENT, *pay).drop("event_order"))


@query
def T09_pivot_event_order(spark, d):
    e = pivots.pivot_events(pivots.pivot_anchors(feed.dense_bars(spark, d)))
    return flat(e, "symbol", "event_id", "event_bar_id", "event_order")


@query
def T10_pivot_tier(spark, d):
    objects, events = chain.pivot_tier(indexed(spark, d), rules.PIVOT_ST)
    o = objects.groupBy("symbol", F.col("kind"), F.col("state").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    e = events.groupBy("symbol", "kind", F.col("event_type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return flat(o.withColumn("dataset", F.lit("objects")).unionByName(e.withColumn("dataset", F.lit("events"))))


@query
def T10_stored_pivot_objects(spark, d):
    """Both tiers as the job stored them."""
    found = jobs.structure_job(feed.dense_bars(spark, d), scratch(spark), "v1")
    return flat(found["pivot_st"][0].unionByName(found["pivot"][0]), *STRUCTURE)


@query
def T13_stored_legs(spark, d):
    """Legs from the stored pivots, major lower highs from the stored legs, as the job stored them."""
    found = jobs.structure_job(feed.dense_bars(spark, d), scratch(spark), "v1")
    return flat(found["leg"][0].unionByName(found["major_lh"][0]), *STRUCTURE)


@query
def T13_stored_leg_events(spark, d):
    found = jobs.structure_job(feed.dense_bars(spark, d), scratch(spark), "v1")
    return flat(found["leg"][1].unionByName(found["major_lh"][1]).select(*EVENT).drop("event_order", "changed_fields", "successor_structure_id"))


@query
def T11_legs(spark, d):
    return flat(legs.legs_from_pivots(pivots.resolved_pivots(anchors(indexed(spark, d)))), *STRUCTURE)


@query
def T12_major_lower_highs(spark, d):
    bars = indexed(spark, d)
    found = cut_lineage(legs.legs_from_pivots(pivots.resolved_pivots(anchors(bars))))
    return flat(major_lh.major_lower_highs(found, bars), *STRUCTURE)


@query
def T13_structures_v1(spark, d):
    found = chain.structures_v1(feed.dense_bars(spark, d))
    return flat(found["leg"].unionByName(found["major_lh"]), *STRUCTURE)


@query
def T14_structure_ids(spark, d):
    rows = pivots.pivot_objects(pivots.pivot_anchors(feed.dense_bars(spark, d), scope="events/dense_1m"))
    return flat(rows, "symbol", "kind", "start_bar_id", "structure_id")


def leg_log(spark, d):
    bars = indexed(spark, d)
    return bars, cut_lineage(derived.leg_events(anchors(bars), bars))


@query
def T15_derived_lifecycle(spark, d):
    _, log = leg_log(spark, d)
    return flat(log.groupBy("symbol", "kind", "event_type").agg(F.count(F.lit(1)).alias("events")))


@query
def T16_leg_events(spark, d):
    return flat(leg_log(spark, d)[1].select(*EVENT).drop("event_order", "changed_fields", "successor_structure_id"))


@query
def T16_major_lh_events(spark, d):
    bars, log = leg_log(spark, d)
    return flat(derived.major_lh_events(log, bars).select(*EVENT).drop("event_order", "changed_fields", "successor_structure_id"))


@query
def T17_changed_fields(spark, d):
    log = leg_log(spark, d)[1]
    return flat(log.select("symbol", "event_id", "changed_fields", F.col("payload_after.explanation_codes").alias("payload_codes")))


@query
def T18_derived_event_order(spark, d):
    return flat(leg_log(spark, d)[1], "symbol", "event_id", "event_bar_id", "event_order")


@query
def T21_structure_chain(spark, d):
    c = chain.structure_chain(feed.dense_bars(spark, d))
    o = c.all_objects().groupBy("symbol", "kind_group", F.col("state").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    e = c.all_events().groupBy("symbol", "kind_group", F.col("event_type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return flat(o.withColumn("dataset", F.lit("objects")).unionByName(e.withColumn("dataset", F.lit("events"))))


@query
def T21_chain_on_five_minute_family(spark, d):
    family = b.derive_family(feed.dense_bars(spark, d), "eth_full", "5m")
    c = chain.structure_chain(family)
    return flat(c.objects["leg"].unionByName(c.objects["major_lh"]), *STRUCTURE)


# --- Lifecycle ---------------------------------------------------------------------------------


def pivot_log(spark, d):
    return cut_lineage(pivots.pivot_events(structure_tier(anchors(indexed(spark, d)))))


STATE = ("symbol", "structure_id", "kind", "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "session_id",
         "session_date", "anchor_bar_ids", "reason_codes", "explanation_codes")


@query
def L01_states_as_of_bar(spark, d):
    return flat(lifecycle.states_as_of(pivot_log(spark, d), as_of_bar_id=CURSOR_BAR), *STATE)


@query
def L02_states_as_of_event(spark, d):
    log = pivot_log(spark, d)
    cursor = log.where((F.col("symbol") == "click") & (F.col("event_bar_id") >= CURSOR_BAR)).agg(
        F.min_by("event_id", lifecycle.position())).head()[0]
    return flat(lifecycle.states_as_of(log, as_of_event_id=cursor), *STATE)


@query
def L03_leg_states_as_of_bar(spark, d):
    return flat(lifecycle.states_as_of(leg_log(spark, d)[1], as_of_bar_id=CURSOR_BAR), *STATE)


@query
def L04_payload_state(spark, d):
    s = lifecycle.states_as_of(pivot_log(spark, d), as_of_bar_id=CURSOR_BAR)
    return flat(s.select("symbol", "structure_id", "payload.extreme_price", "payload.left_window", "payload.right_window",
                         "payload.crosses_session_boundary"))


@query
def L05_transition_violations(spark, d):
    # Faults are put in on purpose: lost created events and confirmations without the state.
    broken = pivot_log(spark, d).where(
        ~((F.col("event_type") == "created") & (F.pmod("start_bar_id", long(7)) == 0))
    ).withColumn("state_after_event", F.when((F.col("event_type") == "confirmed") & (F.pmod("start_bar_id", long(5)) == 0), "candidate").otherwise(F.col("state_after_event")))
    return flat(lifecycle.transition_violations(broken), "symbol", "event_id", "event_type", "problem")


@query
def L06_states_after_each_event(spark, d):
    return flat(lifecycle.states_after_each_event(pivot_log(spark, d)), "symbol", "event_id", "structure_id", "state",
                "confirm_bar_id", "session_id", "explanation_codes")


@query
def L08_validity_intervals(spark, d):
    return flat(lifecycle.validity_intervals(pivot_log(spark, d)), "symbol", "structure_id", "state", "from_bar_id",
                "to_bar_id", "confirm_bar_id")


@query
def L08_live_counts_per_bar(spark, d):
    bars = indexed(spark, d)
    return flat(lifecycle.live_counts_per_bar(cut_lineage(pivots.pivot_events(structure_tier(anchors(bars)))), bars),
                "symbol", "bar_id", "live_candidates", "live_confirmed")


# --- Overlays ----------------------------------------------------------------------------------


def overlay_inputs(spark, d):
    bars = indexed(spark, d)
    a = anchors(bars)
    objects = pivots.pivot_objects(a).unionByName(legs.legs_from_pivots(pivots.resolved_pivots(a)))
    return bars, a, cut_lineage(objects)


def drawn(spark, d):
    bars, _, objects = overlay_inputs(spark, d)
    return overlays.project_structures(objects, bars, "d1", "v2")


def with_label(df):
    return df.withColumn("display_label", F.col("meta.display_label"))


@query
def O01_structure_overlays(spark, d):
    return flat(with_label(drawn(spark, d)), *OVERLAY)


@query
def O02_ghost_overlays(spark, d):
    bars, a, _ = overlay_inputs(spark, d)
    ghosts = overlays.project_events(pivots.pivot_events(a), bars, "d1", "v0_2", "v2")
    return flat(with_label(ghosts).withColumn("successor", F.col("meta.successor_structure_id")), *OVERLAY, "successor")


@query
def O03_overlay_meta(spark, d):
    bars = indexed(spark, d)
    a = anchors(bars)
    found = cut_lineage(legs.legs_from_pivots(pivots.resolved_pivots(a)))
    rows = overlays.project_structures(major_lh.major_lower_highs(found, bars).unionByName(found), bars, "d1", "v2")
    meta = [F.col(f"meta.{m}").alias(m) for m in ("source_kind", "source_state", "session_id", "explanation_codes", "display_label", "confirm_bar_id")]
    return flat(rows.select("symbol", "overlay_id", *meta))


@query
def O04_render_order(spark, d):
    return flat(overlays.render_keys(drawn(spark, d)), "symbol", "overlay_id", "z_order", "tier_rank", "first_anchor")


@query
def O05_overlays_in_window(spark, d):
    kept = overlays.overlays_in_window(drawn(spark, d), CENTER_BAR, CURSOR_BAR, ["pivot", "leg"])
    return flat(kept, "symbol", "overlay_id", "layer", "anchor_bars")


@query
def O06_layer_counts(spark, d):
    return flat(overlays.layer_counts(drawn(spark, d)))


# --- Windows and replay ------------------------------------------------------------------------


@query
def W01_window_by_center(spark, d):
    return flat(windows.select_window(feed.dense_bars(spark, d), WINDOW), *BAR)


@query
def W01_window_by_session(spark, d):
    spec = windows.WindowSpec(session_date=WINDOW_SESSION, left_bars=1, right_bars=3, buffer_bars=1)
    return flat(windows.select_window(feed.hour_bars(spark, d), spec), *BAR)


@query
def W01_window_by_time(spark, d):
    start = CENTER_BAR * 60
    spec = windows.WindowSpec(start_time=start, end_time=start + 3600, buffer_bars=4)
    return flat(windows.select_window(feed.dense_bars(spark, d), spec), *BAR)


def read_inputs(spark, d):
    bars = indexed(spark, d)
    a = structure_tier(anchors(bars))
    window = cut_lineage(windows.select_window(bars, WINDOW))
    objects = pivots.pivot_objects(a).unionByName(pivots.pivots_v1(bars).drop("price", "bar_index"))
    return bars, cut_lineage(objects), cut_lineage(pivots.pivot_events(a)), window


@query
def W03_structures_in_window(spark, d):
    _, objects, log, window = read_inputs(spark, d)
    return flat(windows.structures_in_window(objects, log, window, as_of_bar_id=CURSOR_BAR), *STRUCTURE)


@query
def W03_structure_payload(spark, d):
    _, objects, log, window = read_inputs(spark, d)
    rows = windows.structures_in_window(objects, log, window, as_of_bar_id=CURSOR_BAR).where(F.col("payload").isNotNull())
    return flat(rows.select("symbol", "structure_id", "payload.extreme_price", "payload.left_window"))


@query
def W04_object_visibility(spark, d):
    _, objects, _, _ = read_inputs(spark, d)
    return flat(objects.where(windows.object_visible(CURSOR_BAR)), "symbol", "structure_id", "state", "confirm_bar_id")


@query
def W05_events_in_window(spark, d):
    _, _, log, window = read_inputs(spark, d)
    return flat(windows.events_in_window(log, window, as_of_bar_id=CURSOR_BAR), *EVENT)


@query
def W06_structure_detail(spark, d):
    bars, objects, log, _ = read_inputs(spark, d)
    wanted = objects.select(*SERIES, "structure_id")
    rows = windows.structure_detail(wanted, objects, log, bars, as_of_bar_id=CURSOR_BAR)
    return flat(rows.select("symbol", "structure_id", "kind", "state", F.col("anchor_bars")[0]["high"].alias("anchor_high"),
                            F.col("anchor_bars")[0]["low"].alias("anchor_low"), F.col("confirm_bar.close").alias("confirm_close")))


@query
def W06_leg_detail(spark, d):
    """Every anchor of every leg, and what legs are built from."""
    bars, log = leg_log(spark, d)
    objects = cut_lineage(legs.legs_from_pivots(pivots.resolved_pivots(anchors(bars))))
    wanted = log.select(*SERIES, "structure_id").distinct()
    rows = windows.structure_detail(wanted, objects, log, bars, as_of_bar_id=CURSOR_BAR)
    return flat(rows.select("symbol", "structure_id", "state", F.size("anchor_bars").alias("n_anchors"), F.col("anchor_bars")[0]["high"].alias("first_high"),
                            F.col("anchor_bars")[1]["low"].alias("last_low"), "structure_refs"))


@query
def W07_anchor_widening(spark, d):
    bars = indexed(spark, d)
    found = legs.legs_from_pivots(pivots.resolved_pivots(anchors(bars)))
    window = cut_lineage(windows.select_window(bars, WINDOW))
    return flat(windows.widen_for_anchors(bars, window, windows.in_window(found, window)), "symbol", "bar_id", "close")


@query
def W07_missing_anchor_bars(spark, d):
    bars = indexed(spark, d)
    found = legs.legs_from_pivots(pivots.resolved_pivots(anchors(bars)))
    window = cut_lineage(windows.select_window(bars, WINDOW))
    return flat(windows.add_missing_anchor_bars(bars, window, windows.in_window(found, window)), "symbol", "bar_id", "close")


@query
def W08_replay_deltas(spark, d):
    bars = indexed(spark, d)
    a = structure_tier(anchors(bars))
    window = cut_lineage(windows.select_window(bars, WINDOW))
    log, objects = cut_lineage(pivots.pivot_events(a)), cut_lineage(pivots.pivot_objects(a))
    rows = replay.replay_deltas(objects, log, bars, window)
    return flat(rows.select("symbol", "event_id", "event_type", "remove_structure_id",
                            F.col("upsert_structure.state").alias("upsert_state"), "remove_overlay_id", "upsert_overlay_ids"))


@query
def W09_playback_steps(spark, d):
    minute = cut_lineage(feed.dense_bars(spark, d))
    family = cut_lineage(b.index_bars(b.derive_family(minute, "eth_full", "5m")))
    spec = windows.WindowSpec(start_time=CENTER_BAR * 60, end_time=(CENTER_BAR + 120) * 60)
    rows = replay.playback_steps(family, windows.select_window(family, spec), minute, "5m")
    return flat(rows, "symbol", "step_id", "bar_id", "open", "high", "low", "close", "as_of_bar_id", "closes_display_bar")


@query
def W10_chart_window(spark, d):
    minute = cut_lineage(feed.dense_bars(spark, d))
    c = chain.structure_chain(minute)
    answer = chart.chart_window(c, minute, "1m", chart.ChartRequest(WINDOW, as_of_bar_id=CURSOR_BAR, ema_lengths=(9,)), "d1")
    out = None
    for name, part in sorted(answer.items()):
        n = part.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return flat(out)


def stored_chart(spark, d, part):
    """One part of the chart window's answer over the datasets that the structure job stored."""
    root = scratch(spark)
    minute = cut_lineage(feed.dense_bars(spark, d))
    jobs.structure_job(minute, root, "d1")
    return chart.stored_chart_window(spark, root, minute, "1m", chart.ChartRequest(WINDOW, as_of_bar_id=CURSOR_BAR, parts=(part,)), "d1")[part]


@query
def W10_chart_bars(spark, d):
    return flat(stored_chart(spark, d, "bars"), *BAR)


@query
def W10_chart_structures(spark, d):
    return flat(stored_chart(spark, d, "structures"), *STRUCTURE[:7])


@query
def W10_chart_events(spark, d):
    rows = stored_chart(spark, d, "events")
    return flat(rows, "symbol", "event_id", "structure_id", "kind", "event_type", "event_bar_id", "state_after_event", "start_bar_id", "end_bar_id", "confirm_bar_id", "session_id")


def overlay_columns(df, *more):
    """Every column of overlay rows, the metadata flat."""
    meta = [F.col(f"meta.{m}").alias(m) for m in ("source_kind", "source_state", "session_id", "session_date", "explanation_codes", "display_label",
                                                   "confirm_bar_id", "replay_event_type", "event_bar_id", "reason_codes", "successor_structure_id")]
    return flat(df.select("symbol", *more, "overlay_id", "kind", "source_structure_id", "anchor_bars", "anchor_prices", "style_key", "data_version",
                          "overlay_version", "z_order", "tier_rank", "layer", *meta))


@query
def W08_replay_overlay_rows(spark, d):
    """The overlay rows that each event of the window brings, every column."""
    bars = indexed(spark, d)
    a = structure_tier(anchors(bars))
    window = cut_lineage(windows.select_window(bars, WINDOW))
    rows = replay.replay_deltas(cut_lineage(pivots.pivot_objects(a)), cut_lineage(pivots.pivot_events(a)), bars, window, data_version="d1")
    return overlay_columns(rows.select("symbol", F.col("event_id"), F.inline("upsert_overlays")), "event_id")


@query
def W10_chart_overlays(spark, d):
    """Overlays of all kinds and ghosts as of the cursor, from the stored datasets."""
    return overlay_columns(stored_chart(spark, d, "overlays")).select(
        "symbol", "overlay_id", "kind", "source_structure_id", "anchor_bars", "anchor_prices", "style_key", "display_label", "z_order", "tier_rank", "layer")


@query
def W10_chart_playback(spark, d):
    """Playback steps with the line seeded at the first bar shown, from the stored datasets."""
    root = scratch(spark)
    minute = cut_lineage(feed.dense_bars(spark, d))
    jobs.structure_job(minute, root, "d1")
    answer = chart.stored_chart_window(spark, root, minute, "1m", chart.ChartRequest(WINDOW, include_replay=True, ema_lengths=(9,), parts=("playback", "ema_lines")), "d1")
    steps = answer["playback"].select("symbol", "step_id", "bar_id", "close", "as_of_bar_id", "closes_display_bar")
    return flat(steps.join(answer["ema_lines"].select("symbol", "bar_id", "ema_9"), ["symbol", "bar_id"]))


@query
def W11_ema_lines(spark, d):
    bars = indexed(spark, d)
    window = cut_lineage(windows.select_window(bars, WINDOW))
    rows = chart.ema_lines(bars, window, [9], seed="window").withColumn("seed", F.lit("window")).unionByName(
        chart.ema_lines(bars, window, [9], seed="history").withColumn("seed", F.lit("history")))
    return flat(rows, "symbol", "bar_id", "seed", "ema_9")


@query
def W13_objects_in_window(spark, d):
    _, objects, _, window = read_inputs(spark, d)
    return flat(windows.in_window(objects, window), *STRUCTURE)


# --- Streams -----------------------------------------------------------------------------------


BATCHES = 6


def streamed(spark, df, place, end=None):
    """``df`` as a stream of at least ``BATCHES`` micro-batches, and the lateness of its rows in units of ``place``.

    Files follow each other by ``place`` (a long), but about half of the rows of a file stray into the next one. ``end``
    changes the columns of one more row, far ahead of all: it comes last and moves the watermark past every real row.
    """
    df = cut_lineage(df.withColumn("__place", place))
    low, high = df.agg(F.min("__place"), F.max("__place")).first()
    span = max(1, -(-(high - low + 1) // BATCHES))
    slot = floor_div(F.col("__place") - low + F.pmod(F.xxhash64(*df.columns), long(span)), span)
    path = scratch(spark)
    for i in range(BATCHES + 1):
        df.where(slot == i).drop("__place").write.mode("append").parquet(path)
    if end:
        df.limit(1).withColumns(end(df)).drop("__place").write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    schema = df.drop("__place").schema
    per_batch = max(1, files // (BATCHES + 1))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path), path, 3 * span


@query
def X01_live_minute_bars(spark, d):
    far = lambda df: {"ts_utc_ns": F.col("ts_utc_ns") + long(4000 * NS_PER_DAY), "symbol": F.lit("~end")}
    stream, path, late = streamed(spark, feed.dense_trades(spark, d), floor_div(F.col("ts_utc_ns"), 1_000_000_000), far)
    return flat(live.drain(live.live_minute_bars(stream, f"{late} seconds"), "bars", "append", path + "-run"), *BAR)


@query
def X02_live_tick_deltas(spark, d):
    far = lambda df: {"TradingDay": long(20990101), "symbol": F.lit("~end")}
    stream, path, late = streamed(spark, feed.ticks(spark, d), F.unix_seconds(live.tick_clock()), far)
    rows = live.drain(live.live_tick_deltas(stream, live.tick_clock(), f"{late} seconds"), "deltas", "append", path + "-run")
    return flat(live.on_time(rows), "symbol", "TradingDay", "row_no", "price", "size", "turnover_delta")


@query
def X03_live_pivot_events(spark, d):
    far = lambda df: {"bar_id": F.col("bar_id") + long(4000 * 1440), "symbol": F.lit("~end")}
    stream, path, late = streamed(spark, feed.dense_bars(spark, d), F.col("bar_id"), far)
    rows = live.drain(live.live_pivot_events(stream, lateness=f"{late} minutes"), "pivots", "append", path + "-run")
    return flat(live.on_time(rows),
                "symbol", "event_id", "structure_id", "kind", "event_type", "event_bar_id", "event_order", "state_after_event",
                "start_bar_id", "confirm_bar_id", "successor_structure_id", "session_id", "session_date")


@query
def X04_live_states(spark, d):
    stream, path, _ = streamed(spark, pivot_log(spark, d), F.col("event_bar_id"))
    rows = live.drain(live.live_states(stream), "states", "update", path + "-run")
    # The newest row per structure is its state.
    last = rows.groupBy("symbol", "structure_id").agg(F.max_by(F.struct("state", "kind", "start_bar_id", "confirm_bar_id", "session_id", "explanation_codes"), "batch_id").alias("s"))
    return flat(last.select("symbol", "structure_id", "s.*").where(F.col("state").isNotNull()))
