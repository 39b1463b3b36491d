"""Column contracts of the datasets. The names and types are fixed values: stored data has to have them."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SERIES = ("symbol", "session_profile", "timeframe")

RAW_MINUTE = _schema(
    ("ts_event", S), ("open", D), ("high", D), ("low", D), ("close", D), ("volume", D),
    ("symbol", S), ("ET_datetime", S),
)
RAW_TICK = _schema(
    ("TradingDay", L), ("InstrumentID", S), ("UpdateTime", S), ("UpdateMillisec", L), ("LastPrice", D),
    ("Volume", D), ("BidPrice1", D), ("BidVolume1", D), ("AskPrice1", D), ("AskVolume1", D),
    ("AveragePrice", D), ("Turnover", D), ("OpenInterest", D),
)
RAW_TICK_REQUIRED = ("TradingDay", "UpdateTime", "UpdateMillisec", "Volume", "Turnover", "OpenInterest")
RAW_REFERENCE_MINUTE = _schema(
    ("symbol", S), ("open", D), ("close", D), ("high", D), ("low", D), ("amount", D), ("volume", D),
    ("position", D), ("bob", S), ("eob", S),
)
TRADES = _schema(
    ("event_id", S), ("event_order", L), ("symbol", S), ("instrument_id", S), ("exchange", S),
    ("ts_utc_ns", L), ("ts_local_ns", L), ("session_id", L), ("session_date", L), ("event_action", S),
    ("source_event_ref", S), ("price", D), ("size", D), ("turnover_delta", D), ("open_interest", D),
    ("bid_price_1", D), ("bid_size_1", D), ("ask_price_1", D), ("ask_size_1", D),
)
BARS = _schema(
    ("bar_id", L), ("symbol", S), ("timeframe", S), ("ts_utc_ns", L), ("ts_local_ns", L),
    ("session_id", L), ("session_date", L), ("open", D), ("high", D), ("low", D), ("close", D),
    ("volume", D), ("turnover", D), ("open_interest", D),
)
FEATURES = _schema(
    ("bar_id", L), ("prev_bar_id", L), ("session_id", L), ("session_date", L), ("edge_valid", B),
    ("feature_value", D),
)
STRUCTURES = _schema(
    ("structure_id", S), ("kind", S), ("state", S), ("start_bar_id", L), ("end_bar_id", L),
    ("confirm_bar_id", L), ("session_id", L), ("session_date", L), ("anchor_bar_ids", T.ArrayType(L)),
    ("feature_refs", T.ArrayType(S)), ("rulebook_version", S), ("explanation_codes", T.ArrayType(S)),
)
PIVOT_PAYLOAD = _schema(
    ("explanation_codes", T.ArrayType(S)), ("extreme_price", D), ("left_window", L), ("right_window", L),
    ("crosses_session_boundary", B),
)
EVENT_COLUMNS = (
    "event_id", "structure_id", "kind", "event_type", "event_bar_id", "event_order", "state_after_event",
    "reason_codes", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchor_bar_ids",
    "predecessor_structure_id", "successor_structure_id", "payload_after", "changed_fields",
    "session_id", "session_date",
)
PARITY_FIELDS = ("open", "high", "low", "close", "amount", "volume", "position")
EDGE_FEATURE_KEYS = ("hl_overlap", "body_overlap", "hl_gap", "body_gap")


def structure_columns() -> list[str]:
    return STRUCTURES.fieldNames()
