import math
import random

import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.scalars import NS_PER_MINUTE, floor_div
from barloom.operators import bars as b
from barloom.operators import continuous, features, ingest, parity, windows
from barloom.sources import csv_sources, datasets
from barloom.plans import jobs
from tests.helpers import bars_frame, random_bars

TICK_HEADER = "TradingDay,InstrumentID,UpdateTime,UpdateMillisec,LastPrice,Volume,BidPrice1,BidVolume1,AskPrice1,AskVolume1,AveragePrice,Turnover,OpenInterest"


def write_ticks(folder, rows, name="ag2505"):
    path = folder / f"{name}.csv"
    body = [f"20250303,{name},{t},{ms},{price},{vol},1,1,2,1,,{turn},5" for t, ms, price, vol, turn in rows]
    path.write_text("\n".join([TICK_HEADER, *body]) + "\n")
    return str(path)


TICKS = [("18:37:52", 377, "", 0, 0), ("20:59:00", 500, 7850, 39, 4592250), ("21:00:00", 500, 7847, 57, 6711015),
         ("21:00:01", 0, 7846, 90, 10594860), ("21:00:01", 500, 7847, 104, 12242580)]


def test_floor_division(spark):
    values = [-121, -120, -1, 0, 1, 119, 120, 1704067200123456789, -1704067200123456789]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", floor_div(F.col("x"), 60).alias("q"))
    assert all(r.q == r.x // 60 for r in df.collect())


def test_canonical_minutes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("ts_event,open,high,low,close,volume,symbol,ET_datetime,extra\n"
                    "2010-06-07 00:00:00+00:00,1,2,0,1,5,ES,2010-06-06 20:00:00-04:00,x\n\n"
                    "2010-06-07 00:01:00+00:00,1,2,0,1,5,ES,2010-06-06 20:01:00-04:00,x\n")
    raw = csv_sources.read_minute_csv(spark, str(path))
    rows = ingest.canonical_minute_bars(raw).orderBy("bar_id").collect()
    assert [r.bar_id for r in rows] == [21264480, 21264481]
    assert {(r.session_date, r.session_id) for r in rows} == {(20100607, 20100607)}
    assert all(math.isnan(r.turnover) and math.isnan(r.open_interest) for r in rows)
    stored = jobs.canonical_bar_job(spark, str(path), str(tmp_path / "out"), "v1", "ES")
    assert stored.count() == 2
    assert spark.read.json(str(tmp_path / "out" / "profile")).head().row_count == 2


def test_missing_csv_columns(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("ts_event,open\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        csv_sources.read_minute_csv(spark, str(path))


def test_tick_normalisation(spark, tmp_path):
    ticks = csv_sources.read_tick_csv(spark, write_ticks(tmp_path, TICKS))
    rows = ingest.trades_from_ticks(ticks, "SHFE").orderBy("event_order").collect()
    assert [r.event_order for r in rows] == [2, 3, 4, 5]
    assert [r["size"] for r in rows] == [39, 18, 33, 14]
    assert [r.turnover_delta for r in rows] == [4592250, 2118765, 3883845, 1647720]
    assert rows[0].ts_utc_ns == 1740920340500000000  # 2025-03-02 12:59:00.5
    assert rows[0].source_event_ref == "20250303|ag2505|20:59:00|500|2"


def test_tick_row_numbers_across_splits(spark, tmp_path):
    big = [("21:00:00", 0, 7800, i + 1, (i + 1) * 10) for i in range(4000)]
    path = write_ticks(tmp_path, big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        ticks = csv_sources.read_tick_csv(spark, path)
        assert ticks.rdd.getNumPartitions() >= 1
        assert all(r.row_no == r.Volume for r in ticks.select("row_no", "Volume").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evening_rule_and_reset(spark):
    df = spark.createDataFrame([(20250303, t) for t in ("20:59:00", "00:00:00", "09:00:00")], "d long, t string")
    day = lambda r: r // (86_400 * 10 ** 9)
    got = [day(r[0]) for r in df.select(ingest.exchange_local_ns(F.col("d"), F.col("t"), F.lit(500))).collect()]
    assert got == [20149, 20150, 20150]
    raw = spark.createDataFrame([("a", 1, i + 1, float(v), float(v)) for i, v in enumerate((10, 15, 4, 9))],
                                "symbol string, TradingDay long, row_no long, Volume double, Turnover double")
    assert [r["size"] for r in ingest.tick_deltas(raw, rows=2).orderBy("row_no").collect()] == [10, 5, 4, 5]


def minute_rows():
    op, hi, lo, cl = [8, 12, 10, 11, 9], [11, 17, 14, 15, 13], [7, 10, 6, 9, 5], [10, 15, 12, 10, 6]
    return [{"bar_id": 100 + 10 * i, "ts_local_ns": (569 + i) * NS_PER_MINUTE, "open": op[i], "high": hi[i], "low": lo[i],
             "close": cl[i], "turnover": float("nan")} for i in range(5)]


def test_families(spark):
    bars = bars_frame(spark, minute_rows()).drop("session_profile")
    one = b.derive_family(bars, "rth", "1m").orderBy("bar_id").collect()
    assert [r.bar_id for r in one] == [110, 120, 130, 140]
    two = b.derive_family(bars, "rth", "2m").orderBy("bar_id").collect()
    assert [(r.bar_id, r.open, r.high, r.low, r.close, r.volume, r.turnover) for r in two] == [
        (110, 12, 17, 6, 12, 2, 0.0), (130, 11, 15, 5, 6, 2, 0.0)]
    with pytest.raises(ValueError):
        b.timeframe_minutes("5h")


def test_window_by_session(spark):
    rows = [{"bar_id": 100 + i, "session_id": 20240101 + (i > 2)} for i in range(6)]
    spec = windows.WindowSpec(session_date=20240102, left_bars=1, right_bars=1)
    got = windows.select_window(bars_frame(spark, rows), spec).orderBy("bar_id").collect()
    assert [r.bar_id for r in got] == [102, 103, 104, 105]
    with pytest.raises(ValueError):
        windows.WindowSpec(center_bar_id=1, session_date=2)


def test_continuous_roll(spark):
    rows = []
    for d, (x, y) in zip((20250303, 20250304, 20250305), ((100, 80), (90, 110), (85, 120))):
        for k in range(2):
            bar = 1000 * (d - 20250300) + k
            rows += [{"bar_id": bar, "symbol": s, "session_id": d, "open_interest": oi} for s, oi in (("ag2505", x), ("ag2506", y))]
    bars = bars_frame(spark, rows)
    chosen = continuous.select_front_contracts(bars)
    assert [r.selected_symbol for r in chosen.orderBy("session_date").collect()] == ["ag2505", "ag2505", "ag2506"]
    out = continuous.stitch_continuous(bars, chosen).orderBy("bar_id").collect()
    assert {r.symbol for r in out} == {"ag.v.0"} and [r.open_interest for r in out] == [100, 100, 90, 90, 120, 120]


def test_parity_statuses_and_conflict(spark):
    cols = "symbol string, session_date long, minute_key long, bob string, eob string, " + ", ".join(f"{f} double" for f in schemas.PARITY_FIELDS)
    row = lambda m, v=1.0: ("X", 1, m, f"b{m}", f"e{m}", 1.0, 2.0, 0.5, 1.5, 10.0, v, 3.0)
    tick = spark.createDataFrame([row(1), row(2), row(4)], cols)
    vendor = spark.createDataFrame([row(1), row(2, 5.0), row(3), row(9)], cols)
    rows = parity.parity_rows(tick, vendor)
    assert {r.bar_local_id: r.status for r in rows.collect()} == {1: "match", 2: "mismatch", 3: "missing_tick", 4: "missing_vendor"}
    s = parity.parity_summary(rows).head()
    assert (s.row_count, s.compared_rows, s.matched_rows, s.max_abs_volume_delta, s.max_abs_price_delta) == (4, 2, 1, 4.0, 0.0)
    sample = [(r.rank, r.field) for r in parity.mismatch_sample(rows).orderBy("rank").collect()]
    assert sample == [(1, "volume"), (2, "missing_vendor"), (3, "missing_tick")]
    with pytest.raises(Exception, match="disagree"):
        parity.assemble_reference([tick, vendor]).collect()
    assert parity.assemble_reference([tick, tick]).count() == 3


def test_edge_features_fixture(spark):
    ohlc = [(10, 12, 9, 11), (14, 15, 13, 14), (13, 14, 8, 9)]
    bars = bars_frame(spark, [dict(zip(("open", "high", "low", "close"), x), bar_id=i) for i, x in enumerate(ohlc)])
    rows = features.edge_features(bars, rows=2).orderBy("bar_id").collect()
    keys = schemas.EDGE_FEATURE_KEYS
    assert [tuple(r[k] for k in keys) for r in rows] == [(0, 0, 0, 0), (0, 0, 1, 3), (1, 0, 0, -1)]
    assert [(r.prev_bar_id, r.edge_valid) for r in rows] == [(-1, False), (0, True), (1, True)]


def test_ema_blocks_equal_recursion(spark):
    closes = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    bars = bars_frame(spark, [{"bar_id": 10 + 3 * i, "close": c} for i, c in enumerate(closes)])
    rows = features.ema(bars, [3, 1, 3, 7], rows=4).orderBy("bar_id").collect()
    assert [r.ema_3 for r in rows[:5]] == pytest.approx([3, 2, 3, 2, 3.5])
    y = None
    for r, c in zip(rows, closes):
        y = c if y is None else 0.25 * c + 0.75 * y
        assert r.ema_7 == pytest.approx(y) and r.ema_1 == pytest.approx(c)
    with pytest.raises(ValueError):
        features.ema(bars, [0])

def test_ema_scan_over_any_blocks(spark):
    """Blocks of blocks of blocks give the recursion, for short and long averages, over several series."""
    draw = random.Random(7)
    data = {s: [draw.uniform(90, 110) for _ in range(n)] for s, n in (("A", 700), ("B", 1), ("C", 130))}
    bars = bars_frame(spark, [{"bar_id": 1000 + 3 * i, "close": c} for i, c in enumerate(data["A"])], "A")
    for s in "BC":
        bars = bars.unionByName(bars_frame(spark, [{"bar_id": 1000 + 3 * i, "close": c} for i, c in enumerate(data[s])], s))
    for rows, levels in ((2, 3), (5, 2), (128, 2), (128, 0)):
        df = features.ema(bars, [1, 2, 9, 300], rows=rows, levels=levels)
        assert "Pandas" not in df._jdf.queryExecution().toString() and "Python" not in df._jdf.queryExecution().toString()
        got = {(r.symbol, r.bar_index): r for r in df.collect()}
        for s, values in data.items():
            y = dict.fromkeys((2, 9, 300), values[0])
            for i, c in enumerate(values):
                y = {n: y[n] + 2 / (n + 1) * (c - y[n]) for n in y}
                r = got[s, i]
                assert (r.ema_1, r.ema_2, r.ema_9, r.ema_300) == pytest.approx((c, y[2], y[9], y[300]), rel=1e-12)


def test_leg_strength_against_edges_one_by_one(spark):
    draw = random.Random(3)
    n = 60
    edges = [(i, 500 + 2 * i, draw.random() < 0.8, *[round(draw.uniform(-1, 1), 2) for _ in range(2)], *[round(draw.uniform(0, 1), 2) for _ in range(2)]) for i in range(n)]
    edges = [e if e[2] else (*e[:3], None, None, None, None) for e in edges]
    df = spark.createDataFrame([("S", "p", "1m", *e) for e in edges], "symbol string, session_profile string, timeframe string, bar_index long, bar_id long, edge_valid boolean, hl_gap double, body_gap double, hl_overlap double, body_overlap double")
    legs = [(f"leg{k}", draw.choice(["leg_up", "leg_down"]), a, draw.randint(a, n - 1)) for k, a in enumerate(draw.randrange(n) for _ in range(25))]
    asked = spark.createDataFrame([("S", "p", "1m", s, k, 500 + 2 * a, 500 + 2 * b) for s, k, a, b in legs], "symbol string, session_profile string, timeframe string, structure_id string, kind string, start_bar_id long, end_bar_id long")
    out = features.leg_strength(asked, df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.structure_id: r for r in out.collect()}
    for s, kind, a, b in legs:
        inside = [e for e in edges[a + 1 : b + 1] if e[2]]
        rise = sum(max(e[3], 0) + max(e[4], 0) for e in inside)
        fall = sum(max(-e[3], 0) + max(-e[4], 0) for e in inside)
        want = ((rise - fall) * (1 if kind == "leg_up" else -1) - sum(e[5] + e[6] for e in inside) / len(inside)) if inside else 0.0
        assert got[s].edge_count == len(inside) and got[s].score == pytest.approx(want, abs=1e-9)
    with pytest.raises(Exception, match="lacks a bar"):
        features.leg_strength(asked.withColumn("end_bar_id", asked.end_bar_id + 1), df).collect()

def test_leg_strength_keeps_no_rounding_of_earlier_bars(spark):
    n = 400
    edges = [(i, 500 + 2 * i, True, 1e15 if i == 1 else 0.25 * (i % 3) + 0.1, 0.0, 0.1 * (i % 7), 0.0) for i in range(n)]
    df = spark.createDataFrame([("S", "p", "1m", *e) for e in edges], "symbol string, session_profile string, timeframe string, bar_index long, bar_id long, edge_valid boolean, hl_gap double, body_gap double, hl_overlap double, body_overlap double")
    legs = [(f"leg{k}", a, b) for k, (a, b) in enumerate([(1, 2), (2, 9), (5, 399), (40, 300), (63, 64), (31, 160), (127, 128), (200, 200), (300, 200)])]
    asked = spark.createDataFrame([("S", "p", "1m", s, "leg_up", 500 + 2 * a, 500 + 2 * b) for s, a, b in legs], "symbol string, session_profile string, timeframe string, structure_id string, kind string, start_bar_id long, end_bar_id long")
    for rows, levels in ((128, 3), (4, 3), (3, 2)):
        got = {r.structure_id: r for r in features.leg_strength(asked, df, rows=rows, levels=levels).collect()}
        for s, a, b in legs:
            inside = edges[a + 1 : b + 1]
            want = sum(e[3] for e in inside) - sum(e[5] for e in inside) / len(inside) if inside else 0.0
            assert got[s].edge_count == len(inside) and got[s].score == pytest.approx(want, abs=1e-9)


def test_dataset_round_trip(spark, tmp_path):
    bars = bars_frame(spark, random_bars(40, 1, "A") + random_bars(40, 2, "B"))
    path = str(tmp_path / "bars")
    datasets.write_dataset(bars, path, "bars", order_span=32)
    back = datasets.scan(spark, path, years=[2024], columns=["symbol", "bar_id", "high"], where=F.col("symbol") == "A")
    assert back.count() == 40
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<bar_id:bigint,high:double>" in plan
    with pytest.raises(ValueError, match="lacks columns"):
        datasets.write_dataset(bars.drop("open"), path, "bars")
