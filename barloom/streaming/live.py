"""Structured Streaming twins of the batch operators.

Rows may arrive in any order within a declared lateness. Minute bars are a windowed aggregation under a watermark. Tick
deltas and pivot events depend on the rows before, so rows wait in the state until the watermark has passed them
(``in_event_order``); later ones come out marked ``late``. Structure states do not depend on the order of arrival.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom import rules, schemas
from barloom.functions.scalars import NS_PER_MINUTE, floor_div, long
from barloom.operators import lifecycle
from barloom.operators.bars import eligible_trade

Work = Callable[[tuple, pd.DataFrame | None, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]


def live_minute_bars(trades: DataFrame, lateness: str = "2 minutes", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """B01 on a stream, append mode. A bar is final once the newest trade is ``lateness`` past its end; trades that
    arrive after that are left out and counted by Spark (``numRowsDroppedByWatermark`` of the query's progress)."""
    ts = F.timestamp_micros(floor_div(F.col("ts_utc_ns"), 1000))
    first = lambda c: F.min_by(c, "event_order")
    last = lambda c: F.max_by(c, "event_order")
    grouped = (
        trades.where(eligible_trade()).withColumn("ts", ts).withWatermark("ts", lateness)
        .groupBy(*by, F.window("ts", "1 minute").alias("w"))
        .agg(
            first("ts_local_ns").alias("first_local"), first("session_id").alias("session_id"),
            first("session_date").alias("session_date"), first("ts_utc_ns").alias("ts_utc_ns"),
            first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            last("price").alias("close"), F.sum("size").alias("volume"), F.sum("turnover_delta").alias("turnover"),
            last("open_interest").alias("open_interest"),
        )
    )
    local = F.col("first_local") - F.pmod(F.col("first_local"), long(NS_PER_MINUTE))
    return grouped.select(
        floor_div(F.col("ts_utc_ns"), NS_PER_MINUTE).alias("bar_id"), *by, F.lit("1m").alias("timeframe"), "ts_utc_ns",
        local.alias("ts_local_ns"), "session_id", "session_date", "open", "high", "low", "close", "volume", "turnover",
        "open_interest",
    )


LATE = "late"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch stores its changes, not the state
}


def _tuples(rows: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows as tuples of plain values; pandas holds nulls of a long column as NaN."""
    columns = []
    for field in schema.fields:
        values = rows[field.name].astype(object).where(rows[field.name].notna(), None).tolist()
        columns.append([None if v is None else int(v) for v in values] if isinstance(field.dataType, T.LongType) else values)
    return list(zip(*columns))


BLOCK_ROWS = 1 << 13


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_pandas()


class _InOrder(StatefulProcessor):
    """Rows of a key wait in a map state until the watermark has passed them, as Arrow blocks of up to ``BLOCK_ROWS`` keyed by
    their first and last time and a running number. A batch adds blocks of its own and opens those that hold a due row;
    of them only the ones that the watermark cuts are written again, less their due rows. What ``work`` keeps is a list,
    the place reached, the first waiting time and the next number are values."""

    def __init__(self, keys: Sequence[str], order: str, work: Work, names: list[str], waiting: list[str], kept: T.StructType, over: str | None, own: str | None):
        self.keys, self.order, self.work, self.names, self.waits, self.kept_schema, self.over, self.own = keys, order, work, names, waiting, kept, over, own

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first_ms long, last_ms long, n long", "rows binary")
        self.kept = handle.getListState("kept", self.kept_schema)
        self.place = handle.getValueState("place", "done long, next_ms long, over_ms long, n long")

    def _wait(self, rows: pd.DataFrame, n: int) -> None:
        clock = rows["clock_ms"]
        self.waiting.updateValue((int(clock.iloc[0]), int(clock.iloc[-1]), n), (_packed(rows),))

    def _due(self, mark: int) -> tuple[pd.DataFrame, int | None]:
        """Take out the waiting rows up to ``mark``; with the first time that still waits."""
        due, next_ms = [], None
        for place in sorted(self.waiting.keys(), key=lambda k: k[2]):
            first, last, n = place
            if first <= mark:
                block = _unpacked(self.waiting.getValue(place)[0])
                self.waiting.removeKey(place)
                at = int(block["clock_ms"].searchsorted(mark, side="right"))
                due.append(block.iloc[:at])
                if last > mark:
                    first = int(block["clock_ms"].iloc[at])
                    self._wait(block.iloc[at:], n)
            if last > mark:
                next_ms = first if next_ms is None else min(first, next_ms)
        return pd.concat(due, ignore_index=True), next_ms

    def _wake(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def _advance(self, key, fresh: pd.DataFrame | None, mark: int) -> Iterator[pd.DataFrame]:
        done, next_ms, over_ms, n = self.place.get() if self.place.exists() else (None, None, None, 0)
        if fresh is not None and fresh["clock_ms"].isna().any():
            raise ValueError(f"Rows without a time have no place before the watermark, among them {self.order} {fresh.loc[fresh['clock_ms'].isna(), self.order].iloc[0]}.")
        if fresh is not None and self.over:
            over_ms = max(over_ms or 0, int(fresh[self.over].max()))
        if fresh is not None and done is not None:
            missed = fresh[fresh[self.order] <= done]
            fresh = fresh[fresh[self.order] > done]
            missed = missed[missed[self.own]] if self.own else missed  # a copy is told where it is at home
            if len(missed):
                shown = {**dict(zip(self.keys, key)), self.order: missed[self.order].to_numpy()}
                yield pd.DataFrame({n: shown.get(n) for n in self.names}, index=missed.index).assign(**{LATE: True})[[*self.names, LATE]]
        if fresh is not None and len(fresh):
            first = int(fresh["clock_ms"].min())
            if next_ms is None and first <= mark and int(fresh["clock_ms"].max()) <= mark:
                queue = fresh[self.waits]  # nothing waits and all are due: the state is not touched
            else:
                queue, ordered = None, fresh[self.waits].sort_values("clock_ms", kind="stable", ignore_index=True)
                for at in range(0, len(ordered), BLOCK_ROWS):
                    self._wait(ordered.iloc[at : at + BLOCK_ROWS], n)
                    n += 1
                next_ms = first if next_ms is None else min(first, next_ms)
        else:
            queue = None
        if queue is None and next_ms is not None and next_ms <= mark:
            queue, next_ms = self._due(mark)
        if queue is not None and len(queue):
            due = queue.drop(columns="clock_ms").sort_values(self.order, kind="stable", ignore_index=True)
            carry = pd.DataFrame(list(self.kept.get()), columns=self.kept_schema.names) if self.kept.exists() else None
            out, kept = self.work(key, carry, due)
            self.kept.put(_tuples(kept, self.kept_schema))
            done = int(due[self.order].iloc[-1])
            yield out.assign(**{LATE: False})[[*self.names, LATE]]
        if over_ms is not None and next_ms is None and mark >= over_ms:
            # All later rows of this key would be behind the watermark, which Spark leaves out.
            for state in (self.waiting, self.kept, self.place):
                state.clear()
            return self._wake(None)
        self.place.update((done, next_ms, over_ms, n))
        self._wake(next_ms if next_ms is not None else over_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_event_order(
    rows: DataFrame, keys: Sequence[str], order: str, time: Column, lateness: str, work: Work, schema: str, kept: str,
    over: str | None = None, own: str | None = None,
) -> DataFrame:
    """Feed the rows of each key to ``work`` in the order of a long column, however they arrive.

    Rows wait in the state until the watermark, the newest ``time`` seen less ``lateness``, has passed them; a key whose
    rows stop is woken by a timer. ``work(key, carry, fresh)`` gets what it kept (None at first) and the rows that became
    due, and returns output rows and what to keep, rows of the columns ``kept``. ``order`` follows ``time`` up to the
    lateness. Spark leaves out rows behind the watermark and counts them (``late_rows``); a row ahead of it whose place in
    the order was passed comes out once with ``late`` true, its keys and its order column. A row without a time is an error. ``over`` names a column of
    milliseconds after which a key has no more rows, so that its state can go; ``own`` one that is false for copies.

    Columns must not begin with an underscore, as Spark renames those in the state. The query needs the state store of ``STATE_CONF``, as ``drain`` sets it.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    clocked = rows.withColumn("clock_time", time).withWatermark("clock_time", lateness).withColumn("clock_ms", F.unix_millis("clock_time"))
    waiting = [c for c in clocked.columns if c not in (*keys, "clock_time", over)]
    processor = _InOrder(list(keys), order, work, names, waiting, T.StructType([clocked.schema[c] for c in kept.split(", ")]), over, own)
    return clocked.groupBy(*keys).transformWithStateInPandas(processor, f"{schema}, {LATE} boolean", "append", "EventTime")


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(LATE)).drop(LATE)


def tick_clock() -> Column:
    """The wall clock of a tick as a timestamp; from 18:00 on a tick belongs to the next trading day."""
    clock = F.to_timestamp(F.concat(F.col("TradingDay").cast("string"), F.lit(" "), F.col("UpdateTime")), "yyyyMMdd HH:mm:ss")
    return F.when(F.col("UpdateTime") >= "18:00:00", clock - F.expr("INTERVAL 1 DAY")).otherwise(clock)


def live_tick_deltas(ticks: DataFrame, time: Column, lateness: str = "2 minutes") -> DataFrame:
    """N06 and N07 on a stream of ticks with ``row_no``, keyed by (symbol, TradingDay)."""

    def work(key, carry: pd.DataFrame | None, fresh: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        kept = fresh.iloc[-1:][["Volume", "Turnover"]]
        out = fresh.assign(symbol=key[0], TradingDay=key[1])
        for column, target in (("Volume", "size"), ("Turnover", "turnover_delta")):
            before = fresh[column].shift(1)
            if carry is not None:
                before.iloc[0] = carry[column].iloc[0]
            starts = before.isna() | (fresh[column] < before)
            out[target] = fresh[column].where(starts, fresh[column] - before)
        return out[out["LastPrice"].notna() & (out["size"] > 0)].rename(columns={"LastPrice": "price"}), kept

    return in_event_order(
        ticks.select("symbol", "TradingDay", "row_no", "LastPrice", "Volume", "Turnover", time.alias("clock_time")),
        ("symbol", "TradingDay"), "row_no", F.col("clock_time"), lateness, work,
        "symbol string, TradingDay long, row_no long, price double, size double, turnover_delta double", "Volume, Turnover",
    )


def _pivot_ids(kind: str, bars: Sequence[int], tier: rules.PivotTier, scope: str | None) -> list[str]:
    """T14 for pivots: the anchor and the start are the same bar, and the rest of the text is written once."""
    plain = lambda **fields: json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[1:-1]
    fixed = plain(kind=kind, rulebook_version=tier.rulebook_version, scope_ref=scope)
    end = plain(structure_version=tier.structure_version)
    texts = (f'{{"anchor_bar_ids":[{bar}],{fixed},"start_bar_id":{bar},{end}}}' for bar in bars)
    return [f"{kind}-{bar}-{hashlib.sha256(text.encode('utf-8')).hexdigest()[:16]}" for bar, text in zip(bars, texts)]


def live_pivot_events(
    bars: DataFrame, tier: rules.PivotTier = rules.PIVOT, series: Sequence[str] = schemas.SERIES, scope: str | None = None,
    lateness: str = "2 minutes", stretch: int = 40 * 1440, reach: int = 10 * 1440,
) -> DataFrame:
    """T05/T06/T08 on a stream of bars. State: the last ``left + right`` bars and those that wait for their turn.

    An event belongs to the bar that causes it. With the kept bars in front, all anchors that a new bar can touch are in
    view, so the new events are found by shifting columns. The events equal the batch events, but for the payload: the
    session flag of a created event would need the bars to its right.

    The state is keyed by series and a stretch of ``stretch`` minutes of ``bar_id``, so a backfill of one symbol runs in as
    many groups as it has stretches. The bars of the last ``reach`` minutes of a stretch also go to the next, which looks back
    to them and tells no events of theirs. ``left + right`` bars around the end of a stretch must lie within ``reach`` minutes:
    a longer pause of trading there counts as the start of the series.
    """
    if not 0 < reach <= stretch:
        raise ValueError("The reach must be positive and not longer than a stretch.")
    series = list(series)
    names = [*series, "event_id", "structure_id", "kind", "event_type", "event_bar_id", "event_order", "state_after_event",
             "start_bar_id", "confirm_bar_id", "successor_structure_id", "session_id", "session_date", "bar_id"]
    longs = {"event_bar_id", "event_order", "start_bar_id", "confirm_bar_id", "session_id", "session_date", "bar_id"}
    first_of_bar = {"replaced": 0, "invalidated": 1, "created": 2, "confirmed": 3}
    after_event = {"created": "candidate", "confirmed": "confirmed"}

    def side_events(view: pd.DataFrame, new: int, side: str, sign: float) -> pd.DataFrame:
        kind, value = f"{tier.kind_group}_{side}", sign * view[side]
        anchor = (value > value.shift(1).rolling(tier.left, min_periods=tier.left).max()).to_numpy()
        reached = np.stack([(value.shift(-k) >= value).to_numpy() for k in range(1, tier.right + 1)], axis=1)
        n, at = len(view), np.flatnonzero(anchor)
        ends = reached[at].any(axis=1)
        stop = at + np.where(ends, reached[at].argmax(axis=1) + 1, tier.right)
        closed = stop < n
        name = np.where(~ends, "confirmed", np.where(anchor[np.minimum(stop, n - 1)], "replaced", "invalidated"))
        found = pd.concat([
            pd.DataFrame({"at": at, "by": at, "event_type": "created"}),
            pd.DataFrame({"at": at[closed], "by": stop[closed], "event_type": name[closed]}),
        ], ignore_index=True)
        found = found[(found["by"] >= new) & view["own"].to_numpy(bool)[np.minimum(found["by"].to_numpy(int), n - 1)]]
        bar = view["bar_id"].to_numpy()
        start, cause = bar[found["at"].to_numpy(int)], bar[found["by"].to_numpy(int)]
        replaced = (found["event_type"] == "replaced").to_numpy()
        successor = np.full(len(found), None, dtype=object)
        successor[replaced] = _pivot_ids(kind, cause[replaced].tolist(), tier, scope)
        return found.assign(
            kind=kind, start_bar_id=start, event_bar_id=cause, structure_id=_pivot_ids(kind, start.tolist(), tier, scope),
            successor_structure_id=successor,
        )

    def work(key, carry: pd.DataFrame | None, fresh: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        view = fresh if carry is None else pd.concat([carry, fresh[carry.columns]], ignore_index=True)
        new = len(view) - len(fresh)
        out = pd.concat([side_events(view, new, "high", 1.0), side_events(view, new, "low", -1.0)], ignore_index=True)
        kept = view.iloc[-(tier.left + tier.right):]
        if not len(out):
            return pd.DataFrame(columns=names), kept
        out = out.assign(rank=out["event_type"].map(first_of_bar)).sort_values(
            ["event_bar_id", "rank", "start_bar_id", "kind", "structure_id"], ignore_index=True)
        cause = view.iloc[out["by"].to_numpy(int)]
        out = out.assign(
            **dict(zip(series, key)), event_order=out.groupby("event_bar_id").cumcount(),
            event_id=out["structure_id"] + ":" + out["event_type"] + ":" + out["event_bar_id"].astype(str),
            state_after_event=out["event_type"].map(after_event).fillna("invalidated"),
            confirm_bar_id=out["event_bar_id"].where(out["event_type"] == "confirmed").astype("Int64"),
            session_id=cause["session_id"].to_numpy(), session_date=cause["session_date"].to_numpy(), bar_id=out["event_bar_id"],
        )
        return out, kept

    home = F.col("bar_id") - F.pmod(F.col("bar_id"), long(stretch))
    copied = F.pmod(F.col("bar_id"), long(stretch)) >= stretch - reach
    places = F.array_compact(F.array(F.struct(home.alias("at"), F.lit(True).alias("own")), F.when(copied, F.struct((home + long(stretch)).alias("at"), F.lit(False).alias("own")))))
    spread = bars.select(*series, "bar_id", "session_id", "session_date", "high", "low", F.explode(places).alias("p")).select(
        *series, F.col("p.at").alias("stretch_at"), "bar_id", "session_id", "session_date", "high", "low", F.col("p.own").alias("own"),
        ((F.col("p.at") + long(stretch)) * 60_000).alias("stretch_over"))
    return in_event_order(
        spread, [*series, "stretch_at"], "bar_id", F.timestamp_seconds(F.col("bar_id") * 60), lateness, work,
        ", ".join(f"{n} {'long' if n in longs else 'string'}" for n in names), "bar_id, session_id, session_date, high, low, own", "stretch_over", "own",
    )


def live_states(events: DataFrame, series: Sequence[str] = schemas.SERIES) -> DataFrame:
    """L01-L04 per structure on a stream, update mode; ``state`` null means gone.

    The events of a structure, a handful by rule, are its state, in a streaming aggregation; every field is the value of
    the last event that set it after the last terminal one. The order of arrival does not matter, nothing can be late.
    """
    key = [*series, "structure_id"]
    fields = {f: F.col(f) for f in lifecycle.COMMON_FIELDS if f != "anchor_bar_ids"}
    one = F.struct(
        lifecycle.position().alias("pos"), lifecycle.is_terminal().alias("ends"), "kind", F.col("state_after_event").alias("state"),
        "reason_codes", F.col("payload_after.explanation_codes").alias("codes"),
        *[F.struct(lifecycle.applies(f).alias("set"), c.alias("v")).alias(f) for f, c in fields.items()],
    )
    log = events.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("log"))
    ended = F.try_element_at(F.filter("log", lambda e: e["ends"]), F.lit(-1))["pos"]
    log = log.withColumns({"ended": ended, "as_of_bar_id": F.element_at("log", -1)["pos"]["event_bar_id"]})
    log = log.withColumn("alive", F.filter("log", lambda e: F.col("ended").isNull() | (e["pos"] > F.col("ended"))))
    newest = F.try_element_at("alive", F.lit(-1))
    value = lambda f: F.try_element_at(F.filter("alive", lambda e: e[f]["set"]), F.lit(-1))[f]["v"].alias(f)
    codes = F.coalesce(
        F.try_element_at(F.filter(F.transform("alive", lambda e: e["codes"]), lambda c: c.isNotNull()), F.lit(-1)),
        F.try_element_at("alive", F.lit(1))["reason_codes"],
    )
    return log.select(
        *key, newest["kind"].alias("kind"), newest["state"].alias("state"), value("start_bar_id"), value("end_bar_id"),
        value("confirm_bar_id"), value("session_id"), F.array_join(codes, ",").alias("explanation_codes"), "as_of_bar_id",
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark left out, as far as the query remembers its progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def drain(stream: DataFrame, table: str, mode: str, checkpoint: str, allow_late: bool = False) -> DataFrame:
    """Run a stream over what is available and give the result as a batch DataFrame (tests, backfills).

    Rows later than the declared lateness are an error unless they are allowed: a backfill is not to lose rows unseen.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint}/{table}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{folder}/out/batch={batch_id}"
        )

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():  # a query keeps the settings that it was started with
        spark.conf.set(k, v)
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(save)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    late = late_rows(query)
    if late and not allow_late:
        raise RuntimeError(f"{late} rows arrived later than declared.")
    return spark.read.parquet(f"{folder}/out").drop("batch")
