import glob
import json
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import rules
from barloom.operators import lifecycle, overlays, pivots, replay, windows
from barloom.plans import chart, jobs
from barloom.plans.chain import structure_chain
from barloom.session import cut_lineage
from barloom.streaming import live
from tests.helpers import SERIES, bars_frame, brute_state, random_bars

EVENT_SCHEMA = (
    "symbol string, session_profile string, timeframe string, event_id string, structure_id string, kind string, event_type string, "
    "event_bar_id long, event_order long, state_after_event string, reason_codes array<string>, start_bar_id long, end_bar_id long, "
    "confirm_bar_id long, anchor_bar_ids array<long>, predecessor_structure_id string, successor_structure_id string, "
    "payload_after struct<explanation_codes:array<string>,note:string>, changed_fields array<string>, session_id long, session_date long"
)


def ev(sid, kind, bar, order, after, **more):
    row = dict(end=None, confirm=None, anchors=[bar], succ=None, payload=None, changed=[], session=1, start=5, reasons=[kind])
    row.update(more)
    return ("X", "eth_full", "1m", f"{sid}:{kind}:{bar}:{order}", sid, "leg_up", kind, bar, order, after, row["reasons"], row["start"],
            row["end"], row["confirm"], row["anchors"], None, row["succ"], row["payload"], row["changed"], row["session"], row["session"])


def spoil(path, *years):
    """Whoever opens a file of these years from here on fails."""
    files = [f for year in years for f in glob.glob(f"{path}/**/year={year}/*.parquet", recursive=True)]
    assert files
    for f in files:
        with open(f, "wb") as out:
            out.write(b"spoiled")


CURSOR_LOG = [
    ev("s1", "created", 5, 1, "candidate"), ev("s2", "created", 5, 2, "candidate"), ev("s2", "replaced", 6, 0, "invalidated", succ="s3"),
    ev("s3", "created", 6, 1, "candidate"), ev("s1", "confirmed", 8, 1, "confirmed", confirm=8),
]


def test_cursor_fixture(spark):
    log = spark.createDataFrame(CURSOR_LOG, EVENT_SCHEMA)
    at = lambda **c: {r.structure_id: r.state for r in lifecycle.states_as_of(log, **c).collect()}
    assert at(as_of_bar_id=5) == {"s1": "candidate", "s2": "candidate"}
    assert at(as_of_bar_id=6) == {"s1": "candidate", "s3": "candidate"}
    assert at(as_of_bar_id=8) == {"s1": "confirmed", "s3": "candidate"}
    assert at(as_of_event_id="s2:replaced:6:0") == {"s1": "candidate"}
    with pytest.raises(KeyError):
        at(as_of_event_id="none")
    with pytest.raises(ValueError):
        at()


def test_reducer_matches_one_by_one_application(spark):
    """Null-setting by changed_fields, payload merge, re-creation after the end."""
    rows = [
        ev("a", "created", 1, 1, "candidate", end=3, payload=(["x"], "n1"), anchors=[1, 3]),
        ev("a", "updated", 2, 1, "candidate", end=None, changed=["end_bar_id"], payload=(None, "n2"), anchors=[]),
        ev("a", "updated", 3, 1, "candidate", anchors=[], changed=["anchor_bar_ids"], session=None),
        ev("b", "created", 1, 2, "candidate", confirm=9), ev("b", "invalidated", 2, 2, "invalidated"),
        ev("b", "created", 4, 1, "confirmed", reasons=["again"]), ev("c", "created", 2, 3, "candidate"), ev("c", "replaced", 7, 1, "invalidated"),
    ]
    log = spark.createDataFrame(rows, EVENT_SCHEMA)
    events = [r.asDict(recursive=True) for r in log.collect()]
    for cursor in range(1, 8):
        logs = {}
        for e in events:
            if e["event_bar_id"] <= cursor:
                logs.setdefault(e["structure_id"], []).append(e)
        want = {k: s for k, s in ((k, brute_state(v)) for k, v in logs.items()) if s}
        got = {
            r.structure_id: {
                "state": r.state, "note": r.payload.note, "codes": list(r.explanation_codes), "end_bar_id": r.end_bar_id,
                "confirm_bar_id": r.confirm_bar_id, "session_id": r.session_id, "anchor_bar_ids": r.anchor_bar_ids,
            }
            for r in lifecycle.states_as_of(log, as_of_bar_id=cursor).collect()
        }
        assert got == want


def test_transition_violations(spark):
    rows = [ev("a", "confirmed", 1, 1, "confirmed"), ev("b", "created", 1, 2, "invalidated"), ev("c", "created", 1, 3, "candidate"),
            ev("c", "confirmed", 2, 1, "candidate")]
    log = spark.createDataFrame(rows, EVENT_SCHEMA)
    got = {r.structure_id: r.problem for r in lifecycle.transition_violations(log).collect()}
    assert got == {"a": "first_event_not_created", "b": "created_in_wrong_state", "c": "confirmed_without_state"}
    relaxed = {r.structure_id for r in lifecycle.transition_violations(log, allow_initial_confirmed=True).collect()}
    assert relaxed == {"b", "c"}


@pytest.fixture(scope="module")
def chain(spark):
    return structure_chain(bars_frame(spark, random_bars(140, 21)), SERIES, span=32, rows=16)


def test_intervals_agree_with_as_of(spark, chain):
    log = cut_lineage(chain.all_events())
    assert lifecycle.transition_violations(log).count() == 0
    spans = lifecycle.validity_intervals(log).collect()
    bars = sorted(r.bar_id for r in chain.bars.select("bar_id").collect())
    for cursor in (bars[40], bars[90], bars[-1]):
        want = {(r.structure_id, r.state) for r in lifecycle.states_as_of(log, as_of_bar_id=cursor).collect()}
        got = {(r.structure_id, r.state) for r in spans if r.from_bar_id <= cursor and (r.to_bar_id is None or r.to_bar_id > cursor)}
        assert got == want


def test_overlays_and_chart(spark, chain):
    bars = sorted(r.bar_id for r in chain.bars.select("bar_id").collect())
    spec = windows.WindowSpec(center_bar_id=bars[70], left_bars=20, right_bars=20)
    request = chart.ChartRequest(spec, ema_lengths=(5,), include_replay=True)
    answer = chart.chart_window(chain, chain.bars, "1m", request, "d1")
    n = {k: v.count() for k, v in answer.items()}
    assert n["bars"] >= 41 and n["playback"] == n["bars"] == n["ema_lines"]
    assert n["overlays"] == n["structures"] > 0 and n["replay_deltas"] > 0
    # Playing every delta over the base gives the final picture.
    live_ids = {r.structure_id for r in answer["replay_base"].collect()}
    for r in answer["replay_deltas"].orderBy("event_bar_id", "event_order", "event_id").collect():
        if r.remove_structure_id:
            live_ids.discard(r.remove_structure_id)
        if r.upsert_structure:
            live_ids.add(r.structure_id)
    shown = windows.structures_in_window(
        chain.all_objects(), chain.all_events(), chain.bars.join(answer["bars"].select("bar_id"), "bar_id"), as_of_bar_id=bars[-1])
    assert live_ids == {r.structure_id for r in shown.collect()}
    ghost = chart.chart_window(chain, chain.bars, "1m", chart.ChartRequest(spec, as_of_bar_id=bars[75]), "d1")
    kinds = {r.st for r in ghost["overlays"].select(F.col("meta.replay_event_type").alias("st")).distinct().collect()}
    assert None in kinds and kinds & {"replaced", "invalidated"}


def test_overlay_guards(spark):
    bars = bars_frame(spark, [{"bar_id": i, "high": h, "low": 0} for i, h in enumerate([1, 2, 7, 5, 4, 3], 100)])
    objects = pivots.pivot_objects(pivots.pivot_anchors(bars, [rules.PIVOT_ST]))
    row = overlays.project_structures(objects, bars, "d", "v").head()
    assert (row.kind, row.anchor_bars, row.anchor_prices, row.style_key, row.meta.display_label) == (
        "pivot-marker", [102], [7.0], "pivot_st.high.confirmed", "STH")
    with pytest.raises(Exception, match="missing a bar"):
        overlays.project_structures(objects, bars.where("bar_id <> 102"), "d", "v").collect()


def feed(spark, df, tmp_path, order, stray, end=None):
    """Six files and more, one per micro-batch; a row strays by up to ``stray`` units of ``order``."""
    path = str(tmp_path / "in")
    low, high = df.agg(F.min(order), F.max(order)).first()
    placed = cut_lineage(df.withColumn("at", F.col(order) - low + F.pmod(F.xxhash64(*df.columns), F.lit(stray))))
    step = (high - low + stray) // 6 + 1
    for i in range(6):
        placed.where(F.floor(F.col("at") / step) == i).drop("at").coalesce(1).write.mode("append").parquet(path)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def pivot_rows(df):
    return {(r.event_id, r.event_order, r.successor_structure_id, r.session_id) for r in df.collect()}


@pytest.mark.parametrize(("stray", "stretch", "reach"), [(1, 57_600, 14_400), (60, 57_600, 14_400), (60, 40, 40), (1, 64, 16)])
def test_live_pivots_equal_batch(spark, tmp_path, stray, stretch, reach):
    bars = bars_frame(spark, random_bars(120, 31)).unionByName(bars_frame(spark, random_bars(90, 32, "Y")))
    end = bars_frame(spark, [{"bar_id": 10_000_000}], "~")
    stream = feed(spark, bars, tmp_path, "bar_id", stray, end)
    got = live.drain(live.live_pivot_events(stream, rules.PIVOT, lateness="100 minutes", stretch=stretch, reach=reach), "p", "append", str(tmp_path))
    assert got.where("late").count() == 0
    assert pivot_rows(live.on_time(got)) == pivot_rows(pivots.pivot_events(pivots.pivot_anchors(bars, [rules.PIVOT])))


def test_waiting_rows_are_stored_as_blocks(spark, tmp_path, monkeypatch):
    """The state is written block by block: a row that waits costs no state row of its own."""
    bars = bars_frame(spark, random_bars(900, 33))
    stream = feed(spark, bars, tmp_path, "bar_id", 60, bars_frame(spark, [{"bar_id": 10_000_000}], "~"))
    written, late_rows = [], live.late_rows
    monkeypatch.setattr(live, "late_rows", lambda q: written.extend(json.loads(p.json)["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress) or late_rows(q))
    got = live.drain(live.live_pivot_events(stream, rules.PIVOT, lateness="100 minutes"), "p", "append", str(tmp_path))
    assert pivot_rows(live.on_time(got)) == pivot_rows(pivots.pivot_events(pivots.pivot_anchors(bars, [rules.PIVOT])))
    assert written and max(written) < 20


class Held:
    """A state handle in memory, of one key; ``opened`` counts the rows of the values that were read."""

    def __init__(self):
        self.entries, self.value, self.rows, self.opened = {}, None, [], 0

    def getMapState(self, name, key, value):
        return SimpleNamespace(
            keys=lambda: iter(list(self.entries)), updateValue=self.entries.__setitem__, removeKey=self.entries.pop, clear=self.entries.clear, getValue=self.open)

    def open(self, key):
        self.opened += len(live._unpacked(self.entries[key][0]))
        return self.entries[key]

    def getListState(self, name, schema):
        return SimpleNamespace(get=lambda: iter(self.rows), put=lambda v: setattr(self, "rows", v), exists=lambda: bool(self.rows), clear=lambda: self.rows.clear())

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), exists=lambda: self.value is not None, clear=lambda: setattr(self, "value", None))

    def listTimers(self):
        return iter(())

    def deleteTimer(self, at): ...

    def registerTimer(self, at): ...


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_that_the_watermark_cuts(monkeypatch, block):
    """Any order of arrival and any marks: every row once and in order, nulls kept, and a batch opens only blocks with due rows."""
    monkeypatch.setattr(live, "BLOCK_ROWS", block)
    rng = np.random.default_rng(block)
    rows = pd.DataFrame({"at": np.arange(400)})
    rows = rows.assign(clock_ms=rows["at"] * 1000, v=np.where(rows["at"] % 5 == 0, np.nan, rows["at"] * 0.5), name=np.where(rows["at"] % 3 == 0, None, "a"))
    held, seen = Held(), []

    def work(key, carry, fresh):
        assert (carry is None) == (not seen) and (carry is None or carry["at"].iloc[0] == seen[-1]["at"].iloc[-1])
        seen.append(fresh)
        return fresh[["at"]], fresh.iloc[-1:][["at"]]

    kept = T.StructType([T.StructField("at", T.LongType())])
    processor = live._InOrder(["k"], "at", work, ["at"], list(rows.columns), kept, None, None)
    processor.init(held)
    arrives, mark, batches = rows["at"] + rng.integers(0, 60, 400), 0, 20
    for b in range(batches):
        batch = rows[arrives // 25 == b].sample(frac=1, random_state=b)
        mark = max(mark, (b * 25 - 60) * 1000 + int(rng.integers(0, 9_000)))
        list(processor._advance(("k",), batch if len(batch) else None, mark))
        assert all(first > mark for first, _, _ in held.entries)
    list(processor._advance(("k",), None, 400_000))
    pd.testing.assert_frame_equal(pd.concat(seen, ignore_index=True), rows.drop(columns="clock_ms"))
    # A block is cut by a few marks at most, whatever waits behind it.
    assert not held.entries and held.opened <= 400 + batches * 4 * block


def test_rows_without_a_time_are_an_error():
    """The watermark never passes them, so they would wait for nothing."""
    processor = live._InOrder(["k"], "at", lambda *_: None, ["at"], ["at", "clock_ms"], T.StructType([]), None, None)
    processor.init(Held())
    with pytest.raises(ValueError, match="among them at 2"):
        list(processor._advance(("k",), pd.DataFrame({"at": [1, 2], "clock_ms": [1000, None]}), 0))


def test_rows_later_than_declared_are_an_error(spark, tmp_path):
    bars = bars_frame(spark, random_bars(120, 31))
    stream = feed(spark, bars, tmp_path, "bar_id", 150)
    with pytest.raises(RuntimeError, match="later than declared"):
        live.drain(live.live_pivot_events(stream, rules.PIVOT, lateness="1 minute"), "p", "append", str(tmp_path))


def test_live_deltas_in_any_order(spark, tmp_path):
    rows = [("S", 20240102, i, f"09:{i // 60:02d}:{i % 60:02d}", 1.0, float(i if i < 300 else i - 300), float(i)) for i in range(1, 500)]
    schema = "symbol string, TradingDay long, row_no long, UpdateTime string, LastPrice double, Volume double, Turnover double"
    ticks = spark.createDataFrame(rows, schema)
    end = spark.createDataFrame([("~", 20990101, 1, "09:00:00", 1.0, 1.0, 1.0)], schema)
    stream = feed(spark, ticks, tmp_path, "row_no", 90, end)
    got = live.on_time(live.drain(live.live_tick_deltas(stream, live.tick_clock(), "120 seconds"), "d", "append", str(tmp_path)))
    sizes = {r.row_no: (r["size"], r.turnover_delta) for r in got.collect()}
    # Row 300 starts again from zero: its size is zero, so it is no trade.
    assert sizes == {i: (1.0, 1.0) for i in range(1, 500) if i != 300}


def test_live_states_equal_batch(spark, tmp_path, chain):
    log = chain.events["leg"]
    stream = feed(spark, log, tmp_path, "event_bar_id", 10_000)
    rows = live.drain(live.live_states(stream), "s", "update", str(tmp_path))
    last = rows.groupBy("structure_id").agg(F.max_by(F.struct("state", "confirm_bar_id", "session_id"), "batch_id").alias("s"))
    got = {(r.structure_id, *r.s) for r in last.where("s.state is not null").collect()}
    want = {(r.structure_id, r.state, r.confirm_bar_id, r.session_id) for r in lifecycle.reduce_states(log).collect()}
    assert got == want


def test_stored_chart_reads_the_window_only(spark, tmp_path, chain):
    root = str(tmp_path / "stored")
    bars = bars_frame(spark, random_bars(140, 21)).unionByName(bars_frame(spark, random_bars(90, 22, "Y")))
    jobs.structure_job(bars, root, "v1", may_be_empty=("major_lh", "leg"))
    ids = sorted(r.bar_id for r in bars.where("symbol = 'X'").select("bar_id").collect())
    spec = windows.WindowSpec(center_bar_id=ids[70], left_bars=20, right_bars=20)
    request = chart.ChartRequest(spec, as_of_bar_id=ids[80], ema_lengths=(5,))
    stored = chart.stored_chart_window(spark, root, bars, "1m", request, "d1", ["X"])
    whole = chart.chart_window(chain, chain.bars, "1m", request, "d1")
    for part, key in (("bars", "bar_id"), ("structures", "structure_id"), ("events", "event_id"), ("overlays", "overlay_id"), ("ema_lines", "bar_id")):
        pick = lambda df: sorted(r[0] for r in df.select(key).collect())  # noqa: B023, E731
        assert pick(stored[part]) == pick(whole[part]), part
    _, objects, _ = chart.stored_inputs(spark, root, spec, ["X"])
    plan = objects._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(start_bar_id" in plan and "year#" in plan.split("PartitionFilters")[1]
    with pytest.raises(KeyError):
        chart.stored_inputs(spark, root, windows.WindowSpec(center_bar_id=1), ["X"])


def test_chart_builds_the_wanted_parts_only(spark, chain, monkeypatch):
    ids = sorted(r.bar_id for r in chain.bars.where("symbol = 'X'").select("bar_id").collect())
    request = chart.ChartRequest(windows.WindowSpec(center_bar_id=ids[70], left_bars=20, right_bars=20), ema_lengths=(5,), include_replay=True)
    monkeypatch.setattr(chart.replay, "overlay_versions", lambda *a, **k: pytest.fail("not asked for"))
    answer = chart.chart_window(chain, chain.bars, "1m", replace(request, parts=("playback", "ema_lines")), "d1")
    assert sorted(answer) == ["ema_lines", "playback"] and answer["playback"].count() > 0
    assert [*chart.chart_window(chain, chain.bars, "1m", replace(request, parts=("structures",)), "d1")] == ["structures"]
    with pytest.raises(ValueError, match="Unknown chart parts"):
        replace(request, parts=("lines",))


def test_stored_chart_reaches_far_anchors_and_the_start(spark, tmp_path):
    """A leg of 5000 bars around the window, lines seeded with the history."""
    start = random_bars(140, 21)
    top, at = start[-1]["high"], start[-1]["bar_id"]
    levels = [top + 0.5 * k for k in range(1, 5001)] + [top + 2500 - 2 * k for k in range(1, 15)] + [top + 2472 + 2 * k for k in range(1, 15)]
    far = [{"bar_id": at + 1 + i, "high": v + 0.1, "low": v - 0.1, "open": v, "close": v + (i % 7) / 100} for i, v in enumerate(levels)]
    bars = bars_frame(spark, [{**r, "session_id": 20200101 + 10000 * (i // 1300)} for i, r in enumerate(start + far)])
    root = str(tmp_path / "far")
    jobs.structure_job(bars, root, "v1")
    spec = windows.WindowSpec(center_bar_id=at + 2500, left_bars=5, right_bars=5)
    request = chart.ChartRequest(spec, ema_lengths=(1000,), seed="history")
    stored = chart.stored_chart_window(spark, root, bars, "1m", request, "d1", ["X"])
    shown = {r.bar_id for r in stored["bars"].select("bar_id").collect()}
    assert len(shown) >= 5000
    anchors = {a for r in stored["structures"].select("anchor_bar_ids").collect() for a in r.anchor_bar_ids}
    assert anchors <= shown and max(anchors) - min(anchors) >= 4990
    whole = chart.features.ema(bars, (1000,), SERIES).drop("bar_index")
    pick = lambda df: {r for r in map(tuple, df.select(*whole.columns).collect()) if r[whole.columns.index("bar_id")] in shown}
    assert pick(stored["ema_lines"]) == pick(whole)
    assert stored["overlays"].count() == stored["structures"].count()


def test_family_window_reaches_over_years(spark, tmp_path):
    bars = bars_frame(spark, [{"bar_id": 1000 + 10 * i, "session_id": 20150105 + 10000 * i} for i in range(8)]).drop("session_profile")
    jobs.datasets.write_dataset(bars, f"{tmp_path}/data", "bars")
    spec = windows.WindowSpec(session_date=20190105, left_bars=4, right_bars=3)
    got = jobs.family_window(spark, str(tmp_path), "X", "eth_full", "1m", spec)
    assert got.count() == 8


def test_family_window_by_index_equals_the_whole_family(spark, tmp_path):
    """Only the window's sessions are read; rows and places are those of the whole derived family."""
    rows = [{"bar_id": 1000 * s + 5 * s * (s % 2) + i, "session_id": 20150105 + 10000 * (s // 2) + s % 2, "close": s + i / 8} for s in range(12) for i in range(3 + 4 * (s % 3))]
    bars = bars_frame(spark, rows).unionByName(bars_frame(spark, rows[5:40], "Y")).drop("session_profile")
    path, index = str(tmp_path), f"{tmp_path}/families"
    jobs.datasets.write_dataset(bars, f"{path}/data", "bars")
    jobs.family_index_job(spark, path, index, [("eth_full", "1m"), ("eth_full", "2m")])
    at, ns = rows[20]["bar_id"], 60
    specs = [
        windows.WindowSpec(session_date=20170106, left_bars=4, right_bars=9), windows.WindowSpec(session_date=20200106, right_bars=99, buffer_bars=1),
        windows.WindowSpec(center_bar_id=at, left_bars=2, right_bars=30), windows.WindowSpec(center_bar_id=at + 500), windows.WindowSpec(),
        windows.WindowSpec(start_time=at * ns, end_time=(at + 2000) * ns, buffer_bars=3), windows.WindowSpec(session_date=1), windows.WindowSpec(session_date=20150105, left_bars=3),
    ]
    for spec in specs:
        for timeframe in ("2m",) if spec.session_date else ("1m",):
            pick = lambda **how: sorted(map(tuple, jobs.family_window(
                spark, path, "X", "eth_full", timeframe, spec, ["bar_id", "bar_index", "session_date", "close"], **how).collect()))  # noqa: B023
            assert pick(index_path=index) == pick(), (spec, timeframe)  # noqa: B023
    near = jobs.family_window(spark, path, "X", "eth_full", "2m", specs[0], index_path=index)
    spoil(f"{path}/data", "2020")
    assert near.count() > 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(session_date,20160106), LessThanOrEqual(session_date" in plan
    counted = jobs.indexes.session_counts(jobs.datasets.scan(spark, f"{path}/data"), [("eth_full", "2m")])
    assert "open" not in counted._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


def test_interleaving_sessions_have_no_index(spark):
    bars = bars_frame(spark, [{"bar_id": 10 + i, "session_id": 20150105 + i % 2} for i in range(6)]).drop("session_profile")
    with pytest.raises(Exception, match="Sessions interleave"):
        jobs.indexes.session_counts(bars, [("eth_full", "1m")]).collect()


def pictures(df):
    return {(r.overlay_id, r.style_key, tuple(r.anchor_bars), tuple(r.anchor_prices), r.meta.display_label, r.meta.session_id) for r in df.collect()}


def test_replay_overlays_play_to_the_picture_of_every_cursor(spark, chain):
    """Base overlays and the rows of the deltas give, at any later bar, what is drawn as of that bar."""
    ids = sorted(r.bar_id for r in chain.bars.select("bar_id").collect())
    window = cut_lineage(windows.select_window(chain.bars, windows.WindowSpec(center_bar_id=ids[70], left_bars=20, right_bars=20)))
    objects, log = cut_lineage(chain.all_objects()), cut_lineage(chain.all_events())
    versions = cut_lineage(replay.overlay_versions(objects, log, chain.bars, window, "d1"))
    base = pictures(replay.replay_overlay_base(versions, chain.bars, window))
    deltas = replay.replay_deltas(objects, log, chain.bars, window, versions=versions).orderBy("event_bar_id", "event_order", "event_id").collect()
    assert any(r.upsert_overlays for r in deltas) and any(r.remove_overlay_id for r in deltas)
    lo, hi = ids[50], ids[90]
    for cursor in (ids[49], ids[60], ids[75], ids[-1]):
        at = {"as_of_bar_id": cursor}
        drawn = overlays.project_structures(windows.structures_in_window(objects, log, window, **at), chain.bars, "d1", "v")
        ghosts = overlays.project_events(windows.events_in_window(log, window, **at), chain.bars, "d1", "r", "v")
        want = pictures(overlays.overlays_in_window(drawn.unionByName(ghosts), lo, hi))
        now = {p[0]: p for p in base}
        for r in deltas:
            if r.event_bar_id <= cursor:
                now.pop(r.remove_overlay_id, None)
                rows = [(o.overlay_id, o.style_key, tuple(o.anchor_bars), tuple(o.anchor_prices), o.meta.display_label, o.meta.session_id) for o in r.upsert_overlays]
                now.update({p[0]: p for p in rows})
                assert [p[0] for p in rows] == r.upsert_overlay_ids
        assert set(now.values()) == want, cursor
        if cursor == ids[49]:
            assert base == want


def test_own_kind_is_stored_profiled_and_drawn(spark, tmp_path):
    """A kind of the caller's own, built from stored legs, next to those of the rulebook."""
    def doubled(of):
        kind = F.lit("long_leg")
        rename = lambda df: df.withColumns({"kind": kind, "structure_id": F.concat(F.lit("own-"), "structure_id")})
        far = F.col("end_bar_id") - F.col("start_bar_id") >= 4
        return rename(of["leg"].where(far)), rename(of["leg.events"].where(far)).withColumn("event_id", F.concat(F.lit("own-"), "event_id"))

    rows = random_bars(140, 21)
    bars = bars_frame(spark, [{**r, "session_id": 20200101 + 10000 * (i // 70)} for i, r in enumerate(rows)])
    root = str(tmp_path / "own")
    found = jobs.structure_job(bars, root, "v1", builders={"long_leg": (("leg",), doubled)})
    wanted = found["leg"][0].where("end_bar_id - start_bar_id >= 4").count()
    assert wanted == found["long_leg"][0].count() > 0
    assert spark.read.json(f"{root}/structures/kind_group=long_leg/profile").agg(F.sum("row_count")).first()[0] == wanted
    spec = windows.WindowSpec(center_bar_id=rows[20]["bar_id"], left_bars=15, right_bars=15)
    request = chart.ChartRequest(spec, drawings={"long_leg": overlays.Drawing("long-leg-line", "LL", "own", "low", "high", 3)}, layers=("own", "leg"))
    lines = chart.stored_chart_window(spark, root, bars, "1m", request, "d1")["overlays"].where("layer = 'own'").collect()
    assert lines and all(len(r.anchor_bars) == 2 and r.z_order == 3 and r.style_key.startswith("long_leg.") for r in lines)
    assert all(r.overlay_id.startswith("long-leg-line:v1:own-") for r in lines)
    with pytest.raises(Exception, match="Unsupported structure kind"):
        chart.stored_chart_window(spark, root, bars, "1m", chart.ChartRequest(spec), "d1")["overlays"].collect()
    with pytest.raises(ValueError, match="No builder"):
        jobs.structure_job(bars, root, "v1", builders={"x": (("nothing",), doubled)})
    # Folders outside the window's extents stay closed; the chart of the first year reads no file of the second.
    near = chart.ChartRequest(windows.WindowSpec(center_bar_id=rows[20]["bar_id"], left_bars=5, right_bars=5), layers=("leg", "pivot"), include_replay=True)
    whole = {k: v.count() for k, v in chart.stored_chart_window(spark, root, bars, "1m", replace(near, drawings=request.drawings), "d1").items()}
    spoil(f"{root}/structures", "2021")
    spoil(f"{root}/events", "2021")
    spoil(f"{root}/bars", "2021")
    again = {k: v.count() for k, v in chart.stored_chart_window(spark, root, bars, "1m", replace(near, drawings=request.drawings), "d1").items()}
    assert again == whole and whole["structures"] > 0 and whole["replay_deltas"] > 0


def test_replay_base_draws_what_reaches_ahead_of_its_events(spark):
    """A line known before the window that ends inside it is in the base, changes by one delta and leaves by another."""
    bars = bars_frame(spark, [{"bar_id": i, "high": i + 1, "low": i} for i in range(100, 120)])
    line = dict(start=101, end=110, anchors=[101, 110])
    log = spark.createDataFrame([
        ev("s1", "created", 103, 1, "candidate", **line), ev("s1", "confirmed", 108, 1, "confirmed", confirm=108, **line),
        ev("s1", "invalidated", 112, 1, "invalidated", **line), ev("s2", "created", 103, 2, "candidate", start=100, end=102, anchors=[100, 102])], EVENT_SCHEMA)
    columns = ["structure_id", "kind", "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "session_id", "session_date", "anchor_bar_ids"]
    known = log.where("event_id like 's2%'").select(*SERIES, F.lit("s3").alias("structure_id"), "kind", F.lit("candidate").alias("state"), F.lit(104).cast("long").alias("start_bar_id"),
                                                  F.lit(107).cast("long").alias("end_bar_id"), *columns[5:8], F.array(F.lit(104).cast("long")).alias("anchor_bar_ids"),
                                                  F.array(F.lit("x")).alias("explanation_codes"))
    window = bars.where("bar_id between 106 and 115")
    versions = cut_lineage(replay.overlay_versions(known, log, bars, window, "d"))
    assert {(p[0], p[1], p[3]) for p in pictures(replay.replay_overlay_base(versions, bars, window))} == {
        ("leg-line:v1:s1", "leg.up.candidate", (101.0, 111.0)), ("leg-line:v1:s3", "leg.up.candidate", (104.0, 108.0))}
    deltas = replay.replay_deltas(known, log, bars, window, versions=versions).orderBy("event_bar_id").collect()
    assert [(r.event_type, r.remove_overlay_id, [o.style_key for o in r.upsert_overlays]) for r in deltas] == [
        ("created", None, ["leg.up.candidate"]), ("confirmed", None, ["leg.up.confirmed"]), ("invalidated", "leg-line:v1:s1", [])]
    assert replay.replay_overlay_base(versions, bars, bars.where("bar_id < 116")).count() == 0
