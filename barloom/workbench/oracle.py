"""The same questions in DuckDB SQL, from the given tables, written independently of the operators.

``VIEWS`` holds named sub-queries; ``compose`` puts the ones a statement needs in front of it. The
structure rules are restated the plain way (full rebuild per event bar, one window per series).
"""

from __future__ import annotations

import re

from barloom.workbench.queries import CENTER_BAR, CURSOR_BAR, EMA_LENGTHS, WINDOW_SESSION

MIN_NS = 60_000_000_000
SHIFT_NS = 28_800_000_000_000  # +08:00
DENSE_START_NS = 1_704_117_600_000_000_000


def ymd(ns: str) -> str:
    return f"CAST(strftime(make_timestamp(({ns}) // 1000), '%Y%m%d') AS BIGINT)"


def minute_text(minute: str, suffix: str = "+08:00") -> str:
    return f"strftime(make_timestamp(({minute}) * 60000000), '%Y-%m-%d %H:%M:%S') || '{suffix}'"


def ident(kind: str, bar: str, anchors: str, rulebook: str, version: str, scope: str = "null") -> str:
    text = (
        f"'{{\"anchor_bar_ids\":[' || {anchors} || '],\"kind\":\"' || {kind} || '\",\"rulebook_version\":\"{rulebook}\","
        f"\"scope_ref\":{scope},\"start_bar_id\":' || {bar} || ',\"structure_version\":\"{version}\"}}'"
    )
    return f"{kind} || '-' || {bar} || '-' || substr(sha256({text}), 1, 16)"


def bars_of(trades: str, width: int, first_order: str = "event_order") -> str:
    return f"""
      SELECT symbol, (min_by(ts_utc_ns, {first_order}) // {MIN_NS}) AS bar_id, min_by(ts_utc_ns, {first_order}) AS ts_utc_ns,
        (ts_local_ns // {width * MIN_NS}) * {width * MIN_NS} AS ts_local_ns, min_by(session_id, {first_order}) AS session_id,
        min_by(session_date, {first_order}) AS session_date, min_by(price, {first_order}) AS open, max(price) AS high,
        min(price) AS low, max_by(price, {first_order}) AS close, sum(size) AS volume, sum(turnover_delta) AS turnover,
        max_by(open_interest, {first_order}) AS open_interest
      FROM {trades} GROUP BY symbol, ts_local_ns // {width * MIN_NS}"""


def dense(source: str) -> str:
    local = f"{DENSE_START_NS} + (m + m // 96) * {MIN_NS} + (n % 4) * 15000000000"
    return f"""
      SELECT symbol, n + 1 AS event_order, ns AS ts_local_ns, ns - {SHIFT_NS} AS ts_utc_ns,
        {ymd('ns + 21600000000000')} AS session_id, {ymd('ns + 21600000000000')} AS session_date, value AS price,
        CAST(k + 1 AS DOUBLE) AS size, CAST((k + 1) * cents AS DOUBLE) AS turnover_delta,
        CAST(10000 + oi AS DOUBLE) AS open_interest
      FROM (SELECT *, {local} AS ns FROM (SELECT *, n // 4 AS m FROM {source}))"""


def placed(symbol: str) -> str:
    return f"""
      SELECT symbol, value, k, cents, CAST(row_number() OVER w - 1 AS BIGINT) AS n, CAST(sum(k - 49) OVER w AS BIGINT) AS oi
      FROM (SELECT event_id, {symbol} AS symbol, value, k, cents FROM m_ev)
      WINDOW w AS (PARTITION BY symbol ORDER BY event_id)"""


def anchors(bars: str, group: str, left: int, right: int, version: str, scope: str = "null") -> str:
    """Candidates, first violation in the right window, and the terminal bar of one tier."""
    sides = []
    for side, op in (("high", ">"), ("low", "<")):
        best = "max" if side == "high" else "min"
        kind = f"'{group}_{side}'"
        leads = ", ".join(
            f"lead({side}, {k}) OVER w AS v{k}, lead(q, {k}) OVER w AS q{k}, lead(bar_id, {k}) OVER w AS b{k}, "
            f"lead(session_id, {k}) OVER w AS s{k}" for k in range(1, right + 1)
        )
        hit = "CASE " + " ".join(f"WHEN v{k} IS NOT NULL AND NOT ({side} {op} v{k}) THEN {k}" for k in range(1, right + 1)) + " END"
        pick = lambda c: "CASE hit " + " ".join(f"WHEN {k} THEN {c}{k}" for k in range(1, right + 1)) + " END"
        last = "coalesce(" + ", ".join(f"s{k}" for k in range(right, 0, -1)) + ", session_id)"
        sides.append(f"""
          SELECT symbol, {kind} AS kind, bar_id, i, session_id, session_date, price, crosses,
            CASE WHEN hit IS NOT NULL THEN 'invalidated' WHEN confirm_bar IS NOT NULL THEN 'confirmed' ELSE 'candidate' END AS state,
            hit_bar, hit_session, coalesce(hit_q, FALSE) AS replaced, confirm_bar, confirm_session,
            {ident(kind, 'bar_id', 'bar_id', 'v0_2', version, scope)} AS structure_id,
            CASE WHEN hit_q THEN {ident(kind, 'hit_bar', 'hit_bar', 'v0_2', version, scope)} END AS successor,
            'left_window_{left},right_window_{right},strict_tie_rule' || CASE WHEN crosses THEN ',cross_session_window' ELSE '' END AS codes,
            CAST({left} AS BIGINT) AS left_window, CAST({right} AS BIGINT) AS right_window
          FROM (
            SELECT *, {pick('b')} AS hit_bar, {pick('s')} AS hit_session, {pick('q')} AS hit_q FROM (
              SELECT symbol, bar_id, i, session_id, session_date, {side} AS price, {hit} AS hit, b{right} AS confirm_bar,
                s{right} AS confirm_session, s_left <> {last} AS crosses, {', '.join(f'b{k}, s{k}, q{k}' for k in range(1, right + 1))}
              FROM (SELECT *, lag(session_id, {left}) OVER w AS s_left, {leads}
                    FROM (SELECT *, i >= {left} AND {side} {op} {best}({side}) OVER (PARTITION BY symbol ORDER BY bar_id
                            ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING) AS q FROM {bars})
                    WINDOW w AS (PARTITION BY symbol ORDER BY bar_id))
              WHERE q))""")
    return " UNION ALL ".join(sides)


def legs(pivots: str, key: str, codes: str, rulebook: str, version: str) -> str:
    """Gaps and islands over (key): best of a run to first of the next."""
    keys = key.split(", ")
    join = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    kind = "CASE WHEN a.kind = 'pivot_low' THEN 'leg_up' ELSE 'leg_down' END"
    return f"""
      SELECT {', '.join('x.' + k for k in keys)}, {ident('x.kind', 'x.start_bar_id', "x.start_bar_id || ',' || x.end_bar_id", rulebook, version)} AS structure_id,
        x.* EXCLUDE ({key})
      FROM (
        SELECT {', '.join('a.' + k for k in keys)}, {kind} AS kind, b.f_state AS state, a.bar AS start_bar_id, b.f_bar AS end_bar_id,
          CASE WHEN b.f_state = 'confirmed' THEN b.f_confirm END AS confirm_bar_id, a.session AS session_id,
          '{codes}' || CASE WHEN a.bar <> a.f_bar THEN ',same_type_replacement' ELSE '' END
            || CASE WHEN a.session <> b.f_session THEN ',cross_session_leg' ELSE '' END AS codes
        FROM (SELECT * FROM {pivots}_runs) a JOIN {pivots}_runs b ON {join} AND b.run = a.run + 1) x"""


def runs(pivots: str, key: str) -> str:
    return f"""
      SELECT {key}, run, any_value(kind) AS kind, arg_max(bar_id, (score, bar_id)) AS bar, arg_max(session_id, (score, bar_id)) AS session,
        arg_min(bar_id, bar_id) AS f_bar, arg_min(session_id, bar_id) AS f_session, arg_min(state, bar_id) AS f_state,
        arg_min(coalesce(confirm, -1), bar_id) AS f_confirm
      FROM (SELECT *, sum(turn) OVER (PARTITION BY {key} ORDER BY bar_id, kind) AS run FROM (
        SELECT *, CASE WHEN kind = 'pivot_high' THEN price ELSE -price END AS score,
          CASE WHEN lag(kind) OVER (PARTITION BY {key} ORDER BY bar_id, kind) = kind THEN 0 ELSE 1 END AS turn FROM {pivots}))
      GROUP BY {key}, run"""


def major(legs_view: str, key: str, rulebook: str, version: str, bars: str = "m_bars") -> str:
    keys = key.split(", ")
    lead = ", ".join(
        f"lead({c}, {k}) OVER w AS {c}{k}" for k in (1, 2, 3)
        for c in ("kind", "start_bar_id", "end_bar_id", "confirm_bar_id", "eh", "el", "ss", "es")
    )
    return f"""
      SELECT {key}, {ident("'major_lh'", 'h1', "h1 || ',' || l1 || ',' || h2", rulebook, version)} AS structure_id, 'major_lh' AS kind,
        CASE WHEN yes THEN 'confirmed' ELSE 'candidate' END AS state, h1 AS start_bar_id, h2 AS end_bar_id,
        CASE WHEN yes THEN confirm_bar_id3 END AS confirm_bar_id, es2 AS session_id, h1 || ',' || l1 || ',' || h2 AS anchors,
        'lower_high' || CASE WHEN yes THEN ',down_leg_break_prior_low' ELSE '' END
          || CASE WHEN greatest(ss, es, ss1, es1, ss2, es2, CASE WHEN yes THEN ss3 ELSE ss END, CASE WHEN yes THEN es3 ELSE ss END)
                  <> least(ss, es, ss1, es1, ss2, es2, CASE WHEN yes THEN ss3 ELSE ss END, CASE WHEN yes THEN es3 ELSE ss END)
             THEN ',cross_session_sequence' ELSE '' END AS codes
      FROM (SELECT *, end_bar_id AS h1, end_bar_id1 AS l1, end_bar_id2 AS h2, proves AND coalesce(el3 < el1, FALSE) AS yes,
              CASE WHEN proves THEN 3 ELSE 2 END AS tail
            FROM (SELECT *, coalesce(kind3 = 'leg_down' AND start_bar_id3 = end_bar_id2, FALSE) AS proves
                  FROM (SELECT *, {lead}, row_number() OVER w AS pos, count(*) OVER (PARTITION BY {key}) AS total
                        FROM (SELECT l.*, e.high AS eh, e.low AS el, s.session_id AS ss, e.session_id AS es
                              FROM {legs_view} l JOIN {bars} s ON s.symbol = l.symbol AND s.bar_id = l.start_bar_id
                              JOIN {bars} e ON e.symbol = l.symbol AND e.bar_id = l.end_bar_id WHERE l.state = 'confirmed')
                        WINDOW w AS (PARTITION BY {key} ORDER BY start_bar_id, end_bar_id))
                  WHERE kind = 'leg_up' AND kind1 = 'leg_down' AND kind2 = 'leg_up' AND eh2 < eh))
      WHERE yes OR pos + tail = total"""


def diff(states: str, created: str, confirmed: str, gone: str) -> str:
    """Events between consecutive builds. ``states``: rows per (symbol, t, structure) with t numbered in m_steps."""
    compared = ("state", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchors", "session_id", "session_id", "codes")
    names = ("state", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchor_bar_ids", "session_id", "session_date", "explanation_codes")
    changed = "array_to_string([x FOR x IN [" + ", ".join(
        f"CASE WHEN b_{c} IS DISTINCT FROM a_{c} THEN '{n}' END" for c, n in zip(compared, names)
    ) + "] IF x IS NOT NULL], ',')"
    cols = ("kind", "state", "start_bar_id", "end_bar_id", "confirm_bar_id", "anchors", "session_id", "codes")
    a = ", ".join(f"a.{c} AS a_{c}" for c in cols)
    b = ", ".join(f"b.{c} AS b_{c}" for c in cols)
    pick = lambda c: f"CASE WHEN gone THEN b_{c} ELSE a_{c} END"
    return f"""
      SELECT symbol, structure_id || ':' || event_type || ':' || t AS event_id, structure_id, {pick('kind')} AS kind, event_type,
        t AS event_bar_id, CASE WHEN gone THEN 'invalidated' ELSE a_state END AS state_after_event,
        CASE event_type WHEN 'invalidated' THEN '{gone}' WHEN 'updated' THEN 'derived_state_changed'
          ELSE CASE WHEN a_state = 'confirmed' THEN '{confirmed}' ELSE '{created}' END END AS reason_codes,
        {pick('start_bar_id')} AS start_bar_id, {pick('end_bar_id')} AS end_bar_id, {pick('confirm_bar_id')} AS confirm_bar_id,
        {pick('anchors')} AS anchor_bar_ids,
        CASE WHEN event_type IN ('confirmed', 'updated') THEN {changed} ELSE '' END AS changed_fields,
        CASE WHEN event_type IN ('created', 'updated') OR (event_type = 'confirmed' AND a_codes <> b_codes) THEN a_codes ELSE '' END AS payload_codes
      FROM (SELECT *, CASE WHEN gone THEN 'invalidated' WHEN fresh THEN 'created'
                WHEN a_state <> b_state AND a_state = 'confirmed' THEN 'confirmed' ELSE 'updated' END AS event_type
            FROM (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.t, b.next_t) AS t,
                    coalesce(a.structure_id, b.structure_id) AS structure_id, {a}, {b}, a.structure_id IS NULL AS gone,
                    b.structure_id IS NULL AS fresh
                  FROM {states} a FULL OUTER JOIN (SELECT s.*, n.next_t FROM {states} s JOIN m_steps n ON n.symbol = s.symbol AND n.t = s.t
                                                   WHERE n.next_t IS NOT NULL) b
                    ON a.symbol = b.symbol AND a.t = b.next_t AND a.structure_id = b.structure_id))
      WHERE gone OR fresh OR (a_state, a_confirm_bar_id, a_session_id, a_codes) IS DISTINCT FROM (b_state, b_confirm_bar_id, b_session_id, b_codes)"""


ANCHOR_TAIL = "symbol, structure_id, kind, state, bar_id AS start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id"

VIEWS = {
    "m_ev": """SELECT event_id, user_id, event_type AS symbol, value, epoch_us(ts) AS micros,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events""",
    "m_ticks": f"""
      SELECT *, CAST(row_number() OVER w AS BIGINT) AS row_no, CAST(sum(k) OVER w AS DOUBLE) AS volume,
        CAST(sum(k * cents) OVER w AS DOUBLE) AS turnover, CAST(10000 + sum(k - 49) OVER w AS DOUBLE) AS open_interest
      FROM (SELECT event_id, symbol, value, k, cents, micros // 1000 AS ms, {ymd('(micros // 1000) * 1000000 + 21600000000000')} AS trading_day,
              strftime(make_timestamp((micros // 1000000) * 1000000), '%H:%M:%S') AS update_time, (micros // 1000) % 1000 AS milli,
              CASE WHEN event_id % 53 <> 0 THEN value END AS price FROM m_ev)
      WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY event_id)""",
    "m_deltas": """
      SELECT *, CASE WHEN pv IS NULL OR volume < pv THEN volume ELSE volume - pv END AS size,
        CASE WHEN pt IS NULL OR turnover < pt THEN turnover ELSE turnover - pt END AS turnover_delta
      FROM (SELECT *, lag(volume) OVER w AS pv, lag(turnover) OVER w AS pt FROM m_ticks
            WINDOW w AS (PARTITION BY symbol, trading_day ORDER BY row_no))""",
    "m_trades": f"""
      SELECT symbol, row_no AS event_order, ms * 1000000 AS ts_local_ns, ms * 1000000 - {SHIFT_NS} AS ts_utc_ns, trading_day AS session_id,
        trading_day AS session_date, price, size, turnover_delta, open_interest, value, update_time, milli
      FROM m_deltas WHERE price IS NOT NULL AND size > 0""",
    "m_hour": bars_of("m_trades", 60),
    "m_contract_minutes": bars_of("m_trades", 1),
    "m_place": placed("symbol"),
    "m_dtrades": dense("m_place"),
    "m_b": bars_of("m_dtrades", 1),
    "m_bars": "SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_id) - 1 AS BIGINT) AS i FROM m_b",
    "m_cplace": placed("CASE user_id % 3 WHEN 0 THEN 'ag2405' WHEN 1 THEN 'ag2406' ELSE 'ag2407' END"),
    "m_ctrades": dense("m_cplace"),
    "m_cbars": bars_of("m_ctrades", 1),
    "m_fam5": f"""
      SELECT symbol, min(bar_id) AS bar_id, min_by(ts_utc_ns, bar_id) AS ts_utc_ns, min_by(ts_local_ns, bar_id) AS ts_local_ns,
        min_by(session_id, bar_id) AS session_id, session_date, min_by(open, bar_id) AS open, max(high) AS high, min(low) AS low,
        max_by(close, bar_id) AS close, sum(volume) AS volume, coalesce(sum(turnover), 0) AS turnover, max_by(open_interest, bar_id) AS open_interest
      FROM (SELECT *, ((ts_local_ns // {MIN_NS}) + 360) % 1440 AS since FROM m_b)
      GROUP BY symbol, session_date, since // 5 HAVING count(*) = 5 AND max(since) - min(since) = 4""",
    "m_edges": """
      SELECT symbol, i, bar_id, coalesce(p_bar, -1) AS prev_bar_id, session_id, session_date, coalesce(session_id = p_session, FALSE) AS edge_valid,
        CASE WHEN p_bar IS NULL THEN 0 ELSE greatest(0, least(high, p_high) - greatest(low, p_low)) END AS hl_overlap,
        CASE WHEN p_bar IS NULL THEN 0 ELSE greatest(0, least(bh, p_bh) - greatest(bl, p_bl)) END AS body_overlap,
        CASE WHEN p_bar IS NULL THEN 0 WHEN low > p_high THEN low - p_high WHEN high < p_low THEN high - p_low ELSE 0 END AS hl_gap,
        CASE WHEN p_bar IS NULL THEN 0 WHEN bl > p_bh THEN bl - p_bh WHEN bh < p_bl THEN bh - p_bl ELSE 0 END AS body_gap,
        coalesce(session_id <> p_session, FALSE) AS session_boundary
      FROM (SELECT *, lag(bar_id) OVER w AS p_bar, lag(session_id) OVER w AS p_session, lag(high) OVER w AS p_high, lag(low) OVER w AS p_low,
              lag(bh) OVER w AS p_bh, lag(bl) OVER w AS p_bl
            FROM (SELECT *, greatest(open, close) AS bh, least(open, close) AS bl FROM m_bars)
            WINDOW w AS (PARTITION BY symbol ORDER BY bar_id))""",
    "m_long": " UNION ALL ".join(
        f"SELECT symbol, bar_id, session_date, '{k}' AS feature_key, CAST({k} AS DOUBLE) AS feature_value FROM m_edges"
        for k in ("hl_overlap", "body_overlap", "hl_gap", "body_gap")
    ),
    "m_scan": """
      SELECT *, i >= 5 AND after = 5 AND high > hb AND high > ha AS pivot_high, i >= 5 AND after = 5 AND low < lb AND low < la AS pivot_low,
        i >= 5 AND after < 5 AND high > hb AND coalesce(high > ha, TRUE) AS tail_high,
        i >= 5 AND after < 5 AND low < lb AND coalesce(low < la, TRUE) AS tail_low,
        coalesce(lag(session_id, 5) OVER w <> lead(session_id, 5) OVER w, FALSE) AS crosses, lead(bar_id, 5) OVER w AS confirm
      FROM (SELECT *, max(high) OVER b AS hb, min(low) OVER b AS lb, max(high) OVER a AS ha, min(low) OVER a AS la, count(*) OVER a AS after
            FROM m_bars WINDOW b AS (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
              a AS (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
      WINDOW w AS (PARTITION BY symbol ORDER BY bar_id)""",
    "m_p1": " UNION ALL ".join(
        f"""SELECT symbol, 'pivot_{s}' AS kind, CASE WHEN pivot_{s} THEN 'confirmed' ELSE 'candidate' END AS state, bar_id, session_id, session_date,
              {s} AS price, CASE WHEN pivot_{s} THEN confirm END AS confirm, 'window_5x5,strict_tie_rule' || CASE WHEN crosses THEN ',cross_session_window' ELSE '' END AS codes,
              {ident(f"'pivot_{s}'", 'bar_id', 'bar_id', 'v0_1', 'v1')} AS structure_id FROM m_scan WHERE pivot_{s} OR tail_{s}"""
        for s in ("high", "low")
    ),
    "m_p1_runs": runs("m_p1", "symbol"),
    "m_legs1": legs("m_p1", "symbol", "pivot_chain_v1,alternating_extreme_pivots", "v0_1", "v1"),
    "m_major1": major("m_legs1", "symbol", "v0_1", "v1"),
    "m_tier_st": anchors("m_bars", "pivot_st", 2, 2, "v1"),
    "m_tier": anchors("m_bars", "pivot", 3, 3, "v2"),
    "m_anchors": "SELECT *, 'pivot_st' AS kind_group FROM m_tier_st UNION ALL SELECT *, 'pivot' AS kind_group FROM m_tier",
    "m_tier_s": anchors("m_bars", "pivot", 3, 3, "v2", '"events/dense_1m"'),
    "m_tier_st_s": anchors("m_bars", "pivot_st", 2, 2, "v1", '"events/dense_1m"'),
    "m_pevents": """
      SELECT *, structure_id || ':' || event_type || ':' || event_bar_id AS event_id,
        CAST(row_number() OVER (PARTITION BY symbol, kind_group, event_bar_id ORDER BY
          CASE event_type WHEN 'replaced' THEN 0 WHEN 'invalidated' THEN 1 WHEN 'created' THEN 2 ELSE 3 END, bar_id, kind, structure_id) - 1 AS BIGINT) AS event_order
      FROM (
        SELECT * REPLACE (NULL AS successor), 'created' AS event_type, bar_id AS event_bar_id, 'candidate' AS after, 'left_window_satisfied' AS reason, -1 AS confirm_id,
          '' AS changed, session_id AS e_session, codes AS e_codes FROM m_anchors
        UNION ALL
        SELECT * REPLACE (NULL AS successor), 'confirmed', confirm_bar, 'confirmed', 'right_window_completed', confirm_bar, 'confirm_bar_id', confirm_session, '' FROM m_anchors WHERE state = 'confirmed'
        UNION ALL
        SELECT *, CASE WHEN replaced THEN 'replaced' ELSE 'invalidated' END, hit_bar, 'invalidated',
          CASE WHEN replaced THEN 'same_side_more_extreme' ELSE 'right_window_violation' END, -1,
          CASE WHEN replaced THEN 'successor_structure_id' ELSE '' END, hit_session, '' FROM m_anchors WHERE state = 'invalidated')""",
    "m_pe": "SELECT * FROM m_pevents WHERE kind_group = 'pivot'",
    "m_piv": """SELECT symbol, kind, state, bar_id, price, CASE WHEN state = 'confirmed' THEN confirm_bar END AS confirm,
        CASE WHEN state = 'confirmed' THEN confirm_session ELSE session_id END AS session_id FROM m_tier WHERE state <> 'invalidated'""",
    "m_piv_runs": runs("m_piv", "symbol"),
    "m_legs": legs("m_piv", "symbol", "pivot_v0_2_chain,alternating_extreme_structural_pivots", "v0_2", "v2"),
    "m_major": major("m_legs", "symbol", "v0_2", "v2"),
    "m_bars5": "SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_id) - 1 AS BIGINT) AS i FROM m_fam5",
    "m_tier5": anchors("m_bars5", "pivot", 3, 3, "v2"),
    "m_piv5": """SELECT symbol, kind, state, bar_id, price, CASE WHEN state = 'confirmed' THEN confirm_bar END AS confirm,
        CASE WHEN state = 'confirmed' THEN confirm_session ELSE session_id END AS session_id FROM m_tier5 WHERE state <> 'invalidated'""",
    "m_piv5_runs": runs("m_piv5", "symbol"),
    "m_legs5": legs("m_piv5", "symbol", "pivot_v0_2_chain,alternating_extreme_structural_pivots", "v0_2", "v2"),
    "m_major5": major("m_legs5", "symbol", "v0_2", "v2", "m_bars5"),
    "m_win": "SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY bar_id) - 1 AS BIGINT) AS p FROM m_window",
    # Full rebuild: the pivots visible after every event bar.
    "m_steps": """SELECT symbol, t, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS next_t
        FROM (SELECT DISTINCT symbol, event_bar_id AS t FROM m_pe)""",
    "m_seen": """
      SELECT s.symbol, s.t, p.kind, p.bar_id, p.price,
        CASE WHEN p.state = 'confirmed' AND p.confirm_bar <= s.t THEN 'confirmed' ELSE 'candidate' END AS state,
        CASE WHEN p.state = 'confirmed' AND p.confirm_bar <= s.t THEN p.confirm_bar END AS confirm,
        CASE WHEN p.state = 'confirmed' AND p.confirm_bar <= s.t THEN p.confirm_session ELSE p.session_id END AS session_id
      FROM m_steps s JOIN m_tier p ON p.symbol = s.symbol AND p.bar_id <= s.t AND (p.state <> 'invalidated' OR p.hit_bar > s.t)""",
    "m_seen_runs": runs("m_seen", "symbol, t"),
    "m_legs_at": "SELECT *, start_bar_id || ',' || end_bar_id AS anchors FROM ("
        + legs("m_seen", "symbol, t", "pivot_v0_2_chain,alternating_extreme_structural_pivots", "v0_2", "v2") + ")",
    "m_major_at": major("m_legs_at", "symbol, t", "v0_2", "v2"),
    "m_leg_events": diff("m_legs_at", "end_pivot_visible", "end_pivot_confirmed", "pivot_pair_no_longer_visible"),
    "m_major_events": diff("m_major_at", "lower_high_visible", "proving_leg_broke_prior_low", "candidate_no_longer_survives"),
    "m_vendor": f"""
      SELECT symbol, ts_local_ns // {MIN_NS} AS minute_key, {ymd('ts_local_ns')} AS session_date, open, high, low,
        close + CASE WHEN (ts_local_ns // {60 * MIN_NS}) % 11 = 0 THEN 0.25 ELSE 0 END AS close, turnover AS amount,
        volume + CASE WHEN (ts_local_ns // {60 * MIN_NS}) % 5 = 0 THEN 3 ELSE 0 END AS volume, open_interest AS position
      FROM m_hour WHERE (ts_local_ns // {60 * MIN_NS}) % 7 <> 0""",
    "m_built": f"""SELECT symbol, ts_local_ns // {MIN_NS} AS minute_key, session_date, open, high, low, close, turnover AS amount, volume,
        open_interest AS position FROM m_hour""",
    "m_parity": """
      SELECT coalesce(t.symbol, v.symbol) AS symbol, coalesce(t.session_date, v.session_date) AS session_date,
        coalesce(t.minute_key, v.minute_key) AS bar_local_id,
        CASE WHEN t.symbol IS NULL THEN 'missing_tick' WHEN v.symbol IS NULL THEN 'missing_vendor'
          WHEN t.open <> v.open OR t.high <> v.high OR t.low <> v.low OR t.close <> v.close OR t.amount <> v.amount OR t.volume <> v.volume
            OR t.position <> v.position THEN 'mismatch' ELSE 'match' END AS status, """
        + ", ".join(f"t.{f} AS tick_{f}, v.{f} AS vendor_{f}, t.{f} - v.{f} AS delta_{f}" for f in ("open", "high", "low", "close", "amount", "volume", "position"))
        + """ FROM m_built t FULL OUTER JOIN (SELECT v.* FROM m_vendor v JOIN (SELECT symbol, min(minute_key) AS lo, max(minute_key) AS hi
              FROM m_built GROUP BY symbol) r ON v.symbol = r.symbol AND v.minute_key BETWEEN r.lo AND r.hi) v
          ON t.symbol = v.symbol AND t.minute_key = v.minute_key""",
    "m_cstats": """SELECT 'ag' AS root, session_date, symbol, max_by(open_interest, ts_utc_ns) AS final_open_interest, sum(volume) AS total_volume,
        min_by(open_interest, ts_utc_ns) AS first_open_interest FROM m_cbars GROUP BY session_date, symbol""",
    "m_csel": """SELECT root, session_date, symbol, coalesce(lag(final_open_interest) OVER w, first_open_interest) AS selection_open_interest,
        coalesce(lag(total_volume) OVER w, 0) AS selection_volume FROM m_cstats WINDOW w AS (PARTITION BY symbol ORDER BY session_date)""",
    "m_front": """SELECT root, session_date, symbol AS selected_symbol, selection_open_interest, selection_volume FROM (
        SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY selection_open_interest DESC, selection_volume DESC,
          CASE WHEN due >= now THEN due - now ELSE 10000 + now - due END, symbol DESC) AS rn
        FROM (SELECT *, 200000 + CAST(right(symbol, 4) AS BIGINT) AS due, session_date // 100 AS now FROM m_csel)) WHERE rn = 1""",
    "m_window": f"""SELECT b.* FROM m_bars b JOIN (SELECT symbol, i AS c FROM m_bars WHERE bar_id = {CENTER_BAR}) x USING (symbol)
        WHERE i BETWEEN c - 65 AND c + 65""",
    "m_range": "SELECT symbol, min(bar_id) AS lo, max(bar_id) AS hi FROM m_window GROUP BY symbol",
    "m_state": f"""
      SELECT symbol, structure_id, kind, max_by(after, event_bar_id) AS state, any_value(bar_id) AS start_bar_id, max(confirm_id) AS confirm_bar_id,
        max_by(e_session, event_bar_id) AS session_id, max_by(reason, event_bar_id) AS reason_codes, any_value(codes) AS explanation_codes,
        any_value(price) AS price, any_value(crosses) AS crosses
      FROM m_pe WHERE event_bar_id <= {CURSOR_BAR} GROUP BY symbol, structure_id, kind
      HAVING max_by(after, event_bar_id) <> 'invalidated'""",
    "m_objects": """
      SELECT symbol, structure_id, kind, state, bar_id AS start_bar_id, CASE WHEN state = 'confirmed' THEN confirm_bar END AS confirm_bar_id, session_id, codes FROM m_tier
      UNION ALL SELECT symbol, structure_id, kind, state, bar_id, confirm, session_id, codes FROM m_p1""",
    "m_visible": f"""SELECT * FROM m_objects WHERE start_bar_id <= {CURSOR_BAR} AND (state = 'candidate' OR (state = 'confirmed'
        AND coalesce(confirm_bar_id, start_bar_id) <= {CURSOR_BAR}))""",
    "m_draw": """
      SELECT symbol, 'pivot-marker:v1:' || structure_id AS overlay_id, 'pivot-marker' AS kind, structure_id AS source_structure_id, CAST(bar_id AS VARCHAR) AS anchor_bars,
        bar_id AS first_anchor, bar_id AS last_anchor, [price] AS prices, replace(replace(kind, '_high', '.high'), '_low', '.low') || '.' || state AS style_key,
        CASE kind WHEN 'pivot_st_high' THEN 'STH' WHEN 'pivot_st_low' THEN 'STL' WHEN 'pivot_high' THEN 'PH' ELSE 'PL' END
          || CASE WHEN state = 'candidate' THEN '?' ELSE '' END AS display_label, kind_group AS layer
      FROM m_anchors WHERE state <> 'invalidated'
      UNION ALL
      SELECT l.symbol, 'leg-line:v1:' || structure_id, 'leg-line', structure_id, start_bar_id || ',' || end_bar_id, start_bar_id, end_bar_id,
        CASE WHEN kind = 'leg_up' THEN [s.low, e.high] ELSE [s.high, e.low] END, replace(kind, '_', '.') || '.' || state,
        CASE kind WHEN 'leg_up' THEN 'LU' ELSE 'LD' END || CASE WHEN state = 'candidate' THEN '?' ELSE '' END, 'leg'
      FROM m_legs l JOIN m_bars s ON s.symbol = l.symbol AND s.bar_id = start_bar_id JOIN m_bars e ON e.symbol = l.symbol AND e.bar_id = end_bar_id""",
}


def compose(statement: str) -> str:
    """Prefix the views a statement uses, each after the views it uses itself."""
    done: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bm_\w+\b", text)):
            if name in VIEWS and name not in done:
                need(VIEWS[name])
                done.append(name)

    need(statement)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in done)
    recursive = "RECURSIVE " if "m_recursion" in statement else ""
    if statement.lstrip().startswith("m_recursion"):
        return f"WITH {recursive}{head}, {statement}"
    return f"WITH {head} {statement}" if done else statement


BAR = ("symbol, bar_id, ts_utc_ns, ts_local_ns, session_id, session_date, open, high, low, close, volume, turnover, open_interest")
VIEW_COLUMNS = f"""symbol, session_date, ts_local_ns // {MIN_NS} AS minute_key, {minute_text(f'ts_local_ns // {MIN_NS}')} AS bob,
  {minute_text(f'ts_local_ns // {MIN_NS} + 1')} AS eob, open, high, low, close, turnover AS amount, volume, open_interest AS position"""
PIVOT_OBJECT = """symbol, structure_id, kind, state, bar_id AS start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id,
  CASE WHEN state = 'confirmed' THEN confirm_bar ELSE -1 END AS confirm_bar_id, session_id, session_date,
  CAST(bar_id AS VARCHAR) AS anchor_bar_ids, codes AS explanation_codes"""
P1_OBJECT = """symbol, structure_id, kind, state, bar_id AS start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id, coalesce(confirm, -1) AS confirm_bar_id,
  session_id, session_date, CAST(bar_id AS VARCHAR) AS anchor_bar_ids, codes AS explanation_codes"""
LEG_OBJECT = """symbol, structure_id, kind, state, start_bar_id, end_bar_id, coalesce(confirm_bar_id, -1) AS confirm_bar_id, session_id,
  session_id AS session_date, start_bar_id || ',' || end_bar_id AS anchor_bar_ids, codes AS explanation_codes"""
MAJOR_OBJECT = """symbol, structure_id, kind, state, start_bar_id, end_bar_id, coalesce(confirm_bar_id, -1) AS confirm_bar_id, session_id,
  session_id AS session_date, anchors AS anchor_bar_ids, codes AS explanation_codes"""
PIVOT_EVENT = """symbol, event_id, structure_id, kind, event_type, event_bar_id, event_order, after AS state_after_event, reason AS reason_codes,
  bar_id AS start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id, confirm_id AS confirm_bar_id, CAST(bar_id AS VARCHAR) AS anchor_bar_ids,
  coalesce(successor, '') AS successor_structure_id, changed AS changed_fields, e_session AS session_id, e_session AS session_date"""
DERIVED_EVENT = """e.symbol, event_id, structure_id, kind, event_type, event_bar_id, state_after_event, reason_codes, start_bar_id, end_bar_id,
  coalesce(confirm_bar_id, -1) AS confirm_bar_id, anchor_bar_ids, b.session_id, b.session_date"""
STATE = """symbol, structure_id, kind, state, start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id, confirm_bar_id, session_id, session_id AS session_date,
  CAST(start_bar_id AS VARCHAR) AS anchor_bar_ids, reason_codes, explanation_codes"""
YEARS = "'2024' AS years"
PARITY = ", ".join(f"round(tick_{f}, 6) AS tick_{f}, round(vendor_{f}, 6) AS vendor_{f}, round(delta_{f}, 6) AS delta_{f}"
                   for f in ("open", "high", "low", "close", "amount", "volume", "position"))
ABS = lambda cols: "coalesce(max(greatest(" + ", ".join(f"abs(delta_{c})" for c in cols) + ")), 0)"
SUMMARY = f"""symbol, count(*) AS row_count, count(*) FILTER (status IN ('match', 'mismatch')) AS compared_rows,
  count(*) FILTER (status = 'match') AS matched_rows, count(*) FILTER (status = 'mismatch') AS mismatched_rows,
  count(*) FILTER (status = 'missing_tick') AS missing_tick_rows, count(*) FILTER (status = 'missing_vendor') AS missing_vendor_rows,
  round({ABS(['open', 'high', 'low', 'close'])}, 6) AS max_abs_price_delta, round({ABS(['volume'])}, 6) AS max_abs_volume_delta,
  round({ABS(['amount'])}, 6) AS max_abs_amount_delta, round({ABS(['position'])}, 6) AS max_abs_position_delta"""


def r6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def ema_sql(bars: str, where: str = "", seeds: str = "m_bars") -> str:
    cols = ", ".join(f"CAST(close AS DOUBLE) AS ema_{n}" for n in EMA_LENGTHS)
    step = ", ".join(f"(2.0 / ({n} + 1.0))::DOUBLE * b.close + (1.0::DOUBLE - (2.0 / ({n} + 1.0))::DOUBLE) * e.ema_{n}" for n in EMA_LENGTHS)
    return f"""m_recursion AS (
      SELECT symbol, i, bar_id, {cols} FROM {bars} WHERE i = 0
      UNION ALL SELECT b.symbol, b.i, b.bar_id, {step} FROM m_recursion e JOIN {bars} b ON b.symbol = e.symbol AND b.i = e.i + 1)"""


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["S01_minute_csv"] = f"""SELECT {minute_text(f'ts_utc_ns // {MIN_NS}', '+00:00')} AS ts_event, open, high, low, close, volume, symbol,
      {minute_text(f'ts_local_ns // {MIN_NS}')} AS ET_datetime FROM m_b"""
    q["S02_tick_csv"] = """SELECT symbol, row_no, trading_day AS "TradingDay", update_time AS "UpdateTime", milli AS "UpdateMillisec",
      price AS "LastPrice", volume AS "Volume", turnover AS "Turnover", open_interest AS "OpenInterest" FROM m_ticks"""
    q["S03_reference_minute_csv"] = f"""SELECT symbol, session_date, minute_key, {minute_text('minute_key')} AS bob, {minute_text('minute_key + 60')} AS eob,
      open, high, low, close, amount, volume, position FROM m_vendor"""
    q["S04_bar_scan"] = f"SELECT symbol, bar_id, open, close FROM m_b WHERE bar_id >= {CENTER_BAR}"
    q["S05_legacy_bar_scan"] = f"SELECT {BAR.replace('turnover', 'CAST(NULL AS DOUBLE) AS turnover').replace('open_interest', 'CAST(NULL AS DOUBLE) AS open_interest')} FROM m_b"
    q["S06_trade_scan"] = "SELECT symbol, event_order, session_date, price, size FROM m_trades"
    q["S07_feature_scan"] = "SELECT symbol, bar_id, prev_bar_id, edge_valid, round(CAST(hl_gap AS DOUBLE), 6) AS feature_value FROM m_edges"
    q["S08_structure_scan"] = f"SELECT {LEG_OBJECT} FROM m_legs1"
    q["S09_structure_bundle"] = f"SELECT {P1_OBJECT} FROM m_p1 UNION ALL SELECT {LEG_OBJECT} FROM m_legs1"
    q["S10_event_scan"] = f"SELECT {PIVOT_EVENT} FROM m_pe WHERE event_bar_id <= {CURSOR_BAR}"
    q["S11_parity_scan"] = "SELECT symbol, bar_local_id, status, round(delta_volume, 6) AS delta_volume, round(delta_close, 6) AS delta_close FROM m_parity WHERE status <> 'match'"

    q["N01_canonical_minute_bars"] = q["S05_legacy_bar_scan"]
    q["N02_session_dates"] = "SELECT symbol, session_date, count(*) AS bars, min(bar_id) AS first_bar_id FROM m_b GROUP BY symbol, session_date"
    q["N03_raw_validation"] = """SELECT count(*) AS row_count, count(*) FILTER (volume <= 100) AS null_values,
      count(DISTINCT symbol) - 1 AS extra_symbols FROM m_b"""
    q["N04_minute_alignment"] = f"SELECT symbol, count(*) AS misaligned FROM m_trades WHERE ts_utc_ns % {MIN_NS} <> 0 GROUP BY symbol"
    q["N05_series_invariants"] = """
      SELECT symbol, CAST(sum(CASE WHEN copies > 1 THEN copies - 1 ELSE 0 END) AS BIGINT) AS duplicate_bar_ids,
        count(*) FILTER (lo < top) AS sessions_going_back, CAST(sum(bad) AS BIGINT) AS nan_prices
      FROM (SELECT *, max(hi) OVER (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
            FROM (SELECT symbol, bar_id, count(*) AS copies, min(session_date) AS lo, max(session_date) AS hi, sum(bad) AS bad
                  FROM (SELECT symbol, bar_id, session_date, 0 AS bad FROM m_b
                        UNION ALL SELECT symbol, bar_id, session_date - 1, 1 FROM m_b WHERE bar_id % 50 = 0
                        UNION ALL SELECT symbol, bar_id + 100000, session_date - 5, 0 FROM m_b WHERE bar_id % 70 = 0)
                  GROUP BY symbol, bar_id)) GROUP BY symbol"""
    q["N06_cumulative_deltas"] = 'SELECT symbol, trading_day AS "TradingDay", row_no, size, turnover_delta FROM m_deltas'
    q["N07_trade_filter"] = 'SELECT symbol, session_date AS "TradingDay", count(*) AS trades, sum(size) AS size FROM m_trades GROUP BY symbol, session_date'
    q["N08_exchange_time"] = "SELECT symbol, session_date, event_order, ts_local_ns, ts_utc_ns FROM m_trades"
    ref = "session_date || '|' || symbol || '|' || update_time || '|' || milli || '|' || event_order"
    q["N09_trade_identity"] = f"""SELECT sha256(symbol || '.csv|' || {ref}) AS event_id, event_order, symbol, symbol AS instrument_id, 'SHFE' AS exchange,
      session_id, 'published' AS event_action, {ref} AS source_event_ref, round(value - 0.5, 6) AS bid_price_1, 1.0::DOUBLE AS bid_size_1,
      round(value + 0.5, 6) AS ask_price_1, 2.0::DOUBLE AS ask_size_1 FROM m_trades"""
    q["N10_instrument_check"] = """SELECT symbol, trading_day AS "TradingDay", row_no, 'other' AS "InstrumentID" FROM m_ticks WHERE row_no % 40 = 0"""

    q["K01_year_partitioned_write"] = """SELECT symbol, session_date // 10000 AS year, count(*) AS bars, sum(volume) AS volume, min(bar_id) AS first_bar_id
      FROM m_b GROUP BY symbol, session_date // 10000"""
    q["K02_bar_profile"] = f"""SELECT symbol, count(*) AS row_count, count(DISTINCT session_date) AS session_count, min(bar_id) AS min_bar_id,
      max(bar_id) AS max_bar_id, min(session_date) AS min_session_date, max(session_date) AS max_session_date, {YEARS} FROM m_b GROUP BY symbol"""
    q["K03_trade_profile"] = f"""SELECT symbol, count(*) AS row_count, min(event_order) AS min_event_order, max(event_order) AS max_event_order,
      min(ts_utc_ns) AS min_ts_utc_ns, max(ts_utc_ns) AS max_ts_utc_ns, min(session_date) AS min_session_date,
      max(session_date) AS max_session_date, {YEARS} FROM m_trades GROUP BY symbol"""
    q["K04_feature_profile"] = f"""SELECT symbol, feature_key, count(*) AS row_count, min(bar_id) AS min_bar_id, max(bar_id) AS max_bar_id,
      min(session_date) AS min_session_date, max(session_date) AS max_session_date, {YEARS} FROM m_long GROUP BY symbol, feature_key"""
    q["K05_structure_profile"] = f"""SELECT symbol, kind, count(*) AS row_count, min(bar_id) AS min_start_bar_id, max(bar_id) AS max_start_bar_id,
      min(session_date) AS min_session_date, max(session_date) AS max_session_date, count(*) FILTER (state = 'candidate') AS candidate_count,
      count(*) FILTER (state = 'confirmed') AS confirmed_count, count(*) FILTER (state = 'invalidated') AS invalidated_count, {YEARS}
      FROM m_anchors GROUP BY symbol, kind"""
    kinds = ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}_count" for k in ("created", "updated", "confirmed", "invalidated", "replaced"))
    q["K06_event_profile"] = f"""SELECT symbol, count(*) AS row_count, min(event_bar_id) AS min_event_bar_id, max(event_bar_id) AS max_event_bar_id,
      min(e_session) AS min_session_date, max(e_session) AS max_session_date, {kinds}, {YEARS} FROM m_pevents GROUP BY symbol"""
    q["K07_parity_profile"] = f"""SELECT {SUMMARY}, min(bar_local_id) AS min_bar_local_id, max(bar_local_id) AS max_bar_local_id,
      min(session_date) AS min_session_date, max(session_date) AS max_session_date FROM m_parity GROUP BY symbol"""

    q["B01_minute_bars"] = f"SELECT {BAR} FROM m_b"
    q["B02_minute_view_of_trades"] = f"SELECT {VIEW_COLUMNS} FROM m_b"
    q["B03_session_filter"] = f"SELECT {BAR} FROM m_b WHERE (ts_local_ns // {MIN_NS}) % 1440 BETWEEN 570 AND 974"
    q["B04_minutes_since_anchor"] = f"""SELECT symbol, bar_id, (ts_local_ns // {MIN_NS}) % 1440 - 570 AS since_rth,
      ((ts_local_ns // {MIN_NS}) + 360) % 1440 AS since_eth FROM m_b"""
    q["B05_five_minute_bars"] = f"SELECT {BAR} FROM m_fam5"
    q["B06_rth_three_minute_family"] = f"""
      SELECT symbol, min(bar_id) AS bar_id, min_by(ts_utc_ns, bar_id) AS ts_utc_ns, min_by(ts_local_ns, bar_id) AS ts_local_ns,
        min_by(session_id, bar_id) AS session_id, session_date, min_by(open, bar_id) AS open, max(high) AS high, min(low) AS low,
        max_by(close, bar_id) AS close, sum(volume) AS volume, sum(turnover) AS turnover, max_by(open_interest, bar_id) AS open_interest
      FROM (SELECT *, (ts_local_ns // {MIN_NS}) % 1440 - 570 AS since FROM m_b) WHERE since BETWEEN 0 AND 404
      GROUP BY symbol, session_date, since // 3 HAVING count(*) = 3 AND max(since) - min(since) = 2"""
    q["B09_family_window"] = f"""SELECT {BAR} FROM (SELECT *, row_number() OVER (ORDER BY bar_id) AS rn FROM m_fam5 WHERE symbol = 'click')
      WHERE rn <= (SELECT count(*) FROM m_fam5 WHERE symbol = 'click' AND session_date = {WINDOW_SESSION}) + 2"""
    counts = "symbol, '{}' AS session_profile, '{}' AS timeframe, session_date, count(*) AS bars, min(bar_id) AS first_bar_id, max(bar_id) AS last_bar_id"
    q["B09_family_index"] = f"""SELECT *, CAST(coalesce(sum(bars) OVER (PARTITION BY symbol, timeframe ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bars_before
      FROM (SELECT {counts.format('eth_full', '5m')} FROM m_fam5 GROUP BY symbol, session_date
            UNION ALL SELECT {counts.format('rth', '3m')} FROM ({q["B06_rth_three_minute_family"]}) GROUP BY symbol, session_date)"""
    q["B10_minute_view_of_bars"] = q["B02_minute_view_of_trades"]
    q["B11_contract_bar_job"] = f"SELECT {BAR} FROM m_contract_minutes"
    q["B12_canonical_bar_job"] = q["S05_legacy_bar_scan"]
    q["B13_trade_job"] = "SELECT symbol, session_date, event_order, price, size, turnover_delta, open_interest FROM m_trades"

    q["C01_contract_session_stats"] = "SELECT * FROM m_cstats"
    q["C02_selection_stats"] = "SELECT root, session_date, symbol, selection_open_interest, CAST(selection_volume AS DOUBLE) AS selection_volume FROM m_csel"
    q["C03_front_contract"] = "SELECT root, session_date, selected_symbol, selection_open_interest, CAST(selection_volume AS DOUBLE) AS selection_volume FROM m_front"
    stitched = BAR.replace("symbol", "'ag.v.0' AS symbol", 1)
    q["C04_stitched_series"] = f"SELECT {stitched} FROM m_cbars c WHERE EXISTS (SELECT 1 FROM m_front f WHERE f.session_date = c.session_date AND f.selected_symbol = c.symbol)"
    q["C05_contract_symbols"] = """SELECT s AS symbol, count(*) AS bars, CASE WHEN regexp_full_match(s, '[A-Za-z]+[0-9]{4}') THEN lower(left(s, 2)) ELSE '' END AS root,
      CASE WHEN regexp_full_match(s, '[A-Za-z]+[0-9]{4}') THEN CAST(right(s, 4) AS BIGINT) ELSE -1 END AS month
      FROM (SELECT CASE WHEN bar_id % 3 = 0 THEN symbol || 'x' ELSE upper(symbol) END AS s FROM m_cbars) GROUP BY s"""
    q["C06_component_bars"] = "SELECT symbol, count(*) AS bars FROM m_cbars GROUP BY symbol"
    q["C07_continuous_job"] = q["C04_stitched_series"]

    view = f"symbol, session_date, minute_key, {minute_text('minute_key')} AS bob, {minute_text('minute_key + 60')} AS eob, open, high, low, close, amount, volume, position"
    q["P01_reference_assembly"] = f"SELECT {view} FROM m_vendor"
    q["P02_neighbouring_days"] = "SELECT symbol, minute_key, session_date AS source_day FROM m_vendor WHERE session_date BETWEEN 20240109 AND 20240111"
    q["P03_range_restriction"] = """SELECT v.symbol, v.minute_key - 4320 AS minute_key, v.close FROM m_vendor v
      JOIN (SELECT symbol, min(minute_key) AS lo, max(minute_key) AS hi FROM m_built GROUP BY symbol) r ON v.symbol = r.symbol
      WHERE v.minute_key - 4320 BETWEEN r.lo AND r.hi"""
    q["P04_parity_rows"] = f"""SELECT symbol, session_date, bar_local_id, {minute_text('bar_local_id')} AS bob, {minute_text('bar_local_id + 60')} AS eob, status, {PARITY} FROM m_parity"""
    q["P05_parity_summary"] = f"SELECT {SUMMARY} FROM m_parity GROUP BY symbol"
    fields = ("open", "high", "low", "close", "volume", "amount", "position")
    parts = [f"SELECT symbol, 0 AS part, bar_local_id, {i} AS f, '{n}' AS field, tick_{n} AS tick_value, vendor_{n} AS vendor_value, delta_{n} AS delta FROM m_parity WHERE delta_{n} <> 0"
             for i, n in enumerate(fields)]
    parts += ["SELECT symbol, 1, bar_local_id, 0, 'missing_vendor', tick_close, NULL, NULL FROM m_parity WHERE status = 'missing_vendor'",
              "SELECT symbol, 2, bar_local_id, 0, 'missing_tick', NULL, vendor_close, NULL FROM m_parity WHERE status = 'missing_tick'"]
    q["P06_mismatch_sample"] = f"""SELECT symbol, CAST(rank AS BIGINT) AS rank, {minute_text('bar_local_id')} AS bob, field, {r6('tick_value', 'vendor_value', 'delta')}
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY part, bar_local_id, f) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY bar_local_id, f) AS n FROM ({' UNION ALL '.join(parts)}))
            WHERE n <= CASE part WHEN 0 THEN 10 ELSE 20 END) WHERE rank <= 20"""
    q["P07_parity_job"] = "SELECT symbol, status, count(*) AS minutes, sum(abs(delta_volume)) AS volume_off FROM m_parity GROUP BY symbol, status"

    for name, key in (("F01", "hl_overlap"), ("F02", "body_overlap"), ("F03", "hl_gap"), ("F04", "body_gap")):
        q[f"{name}_{key}"] = f"SELECT symbol, bar_id, {r6(key)} FROM m_edges"
    q["F11_session_boundary"] = "SELECT symbol, bar_id, session_boundary FROM m_edges"
    q["F05_edge_frame"] = "SELECT symbol, bar_id, prev_bar_id, session_id, session_date, edge_valid FROM m_edges"
    q["F06_feature_job"] = "SELECT symbol, feature_key, count(*) AS edges, round(sum(feature_value), 6) AS total FROM m_long GROUP BY symbol, feature_key"
    q["F07_feature_bundle"] = f"SELECT symbol, bar_id, prev_bar_id, edge_valid, {r6('hl_overlap', 'body_overlap', 'hl_gap', 'body_gap')} FROM m_edges"
    q["F08_bundle_alignment"] = """SELECT symbol, bar_id, problem FROM (SELECT symbol, bar_id, CASE
        WHEN bar_id % 70 = 0 AND bar_id % 90 = 0 THEN NULL WHEN bar_id % 70 = 0 THEN 'feature_without_bar'
        WHEN bar_id % 90 = 0 THEN 'bar_without_feature' WHEN bar_id % 80 = 0 THEN 'feature_missing' END AS problem FROM m_b) WHERE problem IS NOT NULL"""
    q["F09_ema"] = ema_sql("m_bars") + f" SELECT symbol, bar_id, {r6(*[f'ema_{n}' for n in EMA_LENGTHS])} FROM m_recursion"
    q["F12_leg_strength"] = """
      SELECT symbol, structure_id, kind, round(score, 6) AS score, n > 0 AND score > 0 AS strong, n AS edge_count FROM (
        SELECT symbol, structure_id, kind, n, CASE WHEN n = 0 THEN 0.0 ELSE CASE WHEN kind = 'leg_up' THEN up - down ELSE down - up END - pen END AS score
        FROM (SELECT l.symbol, l.structure_id, l.kind, count(e.i) AS n, sum(greatest(hl_gap, 0) + greatest(body_gap, 0)) AS up,
                sum(greatest(-hl_gap, 0) + greatest(-body_gap, 0)) AS down, avg(hl_overlap + body_overlap) AS pen
              FROM m_legs l LEFT JOIN m_edges e ON e.symbol = l.symbol AND e.bar_id > l.start_bar_id AND e.bar_id <= l.end_bar_id AND e.edge_valid
              GROUP BY l.symbol, l.structure_id, l.kind))"""

    q["T01_strict_pivot_scan"] = "SELECT symbol, bar_id, pivot_high, pivot_low FROM m_scan WHERE pivot_high OR pivot_low"
    q["T02_tail_candidates"] = "SELECT symbol, bar_id, tail_high, tail_low FROM m_scan WHERE tail_high OR tail_low"
    q["T03_cross_session_windows"] = "SELECT symbol, bar_id, session_id FROM m_scan WHERE crosses"
    q["T04_pivots_v1"] = f"SELECT {P1_OBJECT} FROM m_p1"
    q["T05_pivot_anchors"] = "SELECT symbol, kind, bar_id, i AS bar_index, price, crosses FROM m_anchors"
    q["T06_violation_replacement"] = "SELECT symbol, kind, bar_id, state, coalesce(hit_bar, -1) AS hit_bar_id, replaced, coalesce(successor, '') AS successor_structure_id FROM m_anchors"
    q["T07_pivot_objects"] = f"SELECT {PIVOT_OBJECT} FROM m_anchors"
    q["T08_pivot_events"] = f"""SELECT {PIVOT_EVENT.replace('event_order, ', '')}, CASE WHEN event_type = 'created' THEN round(price, 6) END AS payload_extreme_price,
      CASE WHEN event_type = 'created' THEN left_window ELSE -1 END AS payload_left_window, e_codes AS payload_explanation_codes FROM m_pevents"""
    q["T09_pivot_event_order"] = "SELECT symbol, event_id, event_bar_id, event_order FROM m_pevents"
    q["T10_pivot_tier"] = """SELECT symbol, kind, state AS what, count(*) AS n, 'objects' AS dataset FROM m_tier_st GROUP BY symbol, kind, state
      UNION ALL SELECT symbol, kind, event_type, count(*), 'events' FROM m_pevents WHERE kind_group = 'pivot_st' GROUP BY symbol, kind, event_type"""
    q["T11_legs"] = f"SELECT {LEG_OBJECT} FROM m_legs"
    q["T12_major_lower_highs"] = f"SELECT {MAJOR_OBJECT} FROM m_major"
    q["T13_structures_v1"] = f"SELECT {LEG_OBJECT} FROM m_legs1 UNION ALL SELECT {MAJOR_OBJECT} FROM m_major1"
    q["T14_structure_ids"] = "SELECT symbol, kind, bar_id AS start_bar_id, structure_id FROM m_tier_s UNION ALL SELECT symbol, kind, bar_id, structure_id FROM m_tier_st_s"
    q["T15_derived_lifecycle"] = "SELECT symbol, kind, event_type, count(*) AS events FROM m_leg_events GROUP BY symbol, kind, event_type"
    for name, view_name in (("T16_leg_events", "m_leg_events"), ("T16_major_lh_events", "m_major_events")):
        q[name] = f"SELECT {DERIVED_EVENT} FROM {view_name} e JOIN m_bars b ON b.symbol = e.symbol AND b.bar_id = e.event_bar_id"
    q["T17_changed_fields"] = "SELECT symbol, event_id, changed_fields, payload_codes FROM m_leg_events"
    q["T18_derived_event_order"] = """SELECT symbol, event_id, event_bar_id, CAST(row_number() OVER (PARTITION BY symbol, event_bar_id ORDER BY
      CASE event_type WHEN 'invalidated' THEN 0 WHEN 'updated' THEN 1 WHEN 'confirmed' THEN 2 ELSE 3 END, kind, structure_id, event_id) AS BIGINT) AS event_order FROM m_leg_events"""
    q["T21_structure_chain"] = " UNION ALL ".join(
        [f"SELECT symbol, {g} AS kind_group, state AS what, count(*) AS n, 'objects' AS dataset FROM {v} GROUP BY symbol, {g}, state"
         for g, v in (("kind_group", "m_anchors"), ("'leg'", "m_legs"), ("'major_lh'", "m_major"))]
        + [f"SELECT symbol, {g} AS kind_group, event_type AS what, count(*) AS n, 'events' AS dataset FROM {v} GROUP BY symbol, {g}, event_type"
           for g, v in (("kind_group", "m_pevents"), ("'leg'", "m_leg_events"), ("'major_lh'", "m_major_events"))])

    q["T21_chain_on_five_minute_family"] = f"SELECT {LEG_OBJECT} FROM m_legs5 UNION ALL SELECT {MAJOR_OBJECT} FROM m_major5"

    q["L03_leg_states_as_of_bar"] = f"""
      SELECT e.symbol, structure_id, kind, state, start_bar_id, end_bar_id, confirm_bar_id, b.session_id, b.session_date, anchor_bar_ids, reason_codes, explanation_codes
      FROM (SELECT symbol, structure_id, kind, max(event_bar_id) AS t, max_by(state_after_event, event_bar_id) AS state, any_value(start_bar_id) AS start_bar_id,
              any_value(end_bar_id) AS end_bar_id, coalesce(max(confirm_bar_id), -1) AS confirm_bar_id, any_value(anchor_bar_ids) AS anchor_bar_ids,
              max_by(reason_codes, event_bar_id) AS reason_codes, max_by(payload_codes, event_bar_id) FILTER (payload_codes <> '') AS explanation_codes
            FROM m_leg_events WHERE event_bar_id <= {CURSOR_BAR} GROUP BY symbol, structure_id, kind) e
      JOIN m_bars b ON b.symbol = e.symbol AND b.bar_id = e.t WHERE state <> 'invalidated'"""
    q["L01_states_as_of_bar"] = f"SELECT {STATE} FROM m_state"
    q["L04_payload_state"] = "SELECT symbol, structure_id, round(price, 6) AS extreme_price, CAST(3 AS BIGINT) AS left_window, CAST(3 AS BIGINT) AS right_window, crosses AS crosses_session_boundary FROM m_state"
    place = "(event_bar_id, event_order)"
    q["L02_states_as_of_event"] = f"""SELECT e.symbol, structure_id, kind, max_by(after, {place}) AS state, any_value(bar_id) AS start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id,
        max(confirm_id) AS confirm_bar_id, max_by(e_session, {place}) AS session_id, max_by(e_session, {place}) AS session_date,
        CAST(any_value(bar_id) AS VARCHAR) AS anchor_bar_ids, max_by(reason, {place}) AS reason_codes, any_value(codes) AS explanation_codes
      FROM m_pe e JOIN (SELECT symbol, event_bar_id AS cb, event_order AS co FROM m_pe WHERE event_id = (SELECT event_id FROM m_pe
          WHERE symbol = 'click' AND event_bar_id >= {CURSOR_BAR} ORDER BY event_bar_id, event_order LIMIT 1)) c ON c.symbol = e.symbol
      WHERE event_bar_id < cb OR (event_bar_id = cb AND event_order <= co)
      GROUP BY e.symbol, structure_id, kind HAVING max_by(after, {place}) <> 'invalidated'"""
    q["L05_transition_violations"] = """SELECT symbol, event_id, event_type, CASE WHEN event_type = 'confirmed' AND bar_id % 5 = 0 THEN 'confirmed_without_state'
      ELSE 'first_event_not_created' END AS problem FROM m_pe
      WHERE NOT (event_type = 'created' AND bar_id % 7 = 0) AND ((event_type = 'confirmed' AND bar_id % 5 = 0) OR (event_type <> 'created' AND bar_id % 7 = 0))"""
    q["L06_states_after_each_event"] = """SELECT symbol, event_id, structure_id, CASE WHEN after = 'invalidated' THEN '' ELSE after END AS state, confirm_id AS confirm_bar_id,
      e_session AS session_id, codes AS explanation_codes FROM m_pe"""
    q["L08_validity_intervals"] = """SELECT symbol, structure_id, after AS state, event_bar_id AS from_bar_id, coalesce(next_bar, -1) AS to_bar_id, confirm_id AS confirm_bar_id
      FROM (SELECT *, lead(event_bar_id) OVER (PARTITION BY symbol, structure_id ORDER BY event_bar_id) AS next_bar FROM m_pe) WHERE after <> 'invalidated'"""
    q["L08_live_counts_per_bar"] = """SELECT b.symbol, b.bar_id, count(*) FILTER (p.after = 'candidate') AS live_candidates, count(*) FILTER (p.after = 'confirmed') AS live_confirmed
      FROM m_bars b LEFT JOIN (SELECT *, lead(event_bar_id) OVER (PARTITION BY symbol, structure_id ORDER BY event_bar_id) AS next_bar FROM m_pe) p
        ON p.symbol = b.symbol AND p.event_bar_id <= b.bar_id AND (p.next_bar IS NULL OR p.next_bar > b.bar_id) AND p.after <> 'invalidated'
      GROUP BY b.symbol, b.bar_id"""

    prices = "array_to_string([CAST(x AS VARCHAR) FOR x IN prices], ',')"
    q["O01_structure_overlays"] = f"SELECT symbol, overlay_id, kind, source_structure_id, anchor_bars, {prices} AS anchor_prices, style_key, display_label FROM m_draw"
    q["O02_ghost_overlays"] = """SELECT symbol, 'pivot-marker:v1:' || structure_id || ':' || event_type || ':' || event_bar_id AS overlay_id, 'pivot-marker' AS kind,
      structure_id AS source_structure_id, CAST(bar_id AS VARCHAR) AS anchor_bars, CAST(price AS VARCHAR) AS anchor_prices,
      replace(replace(kind, '_high', '.high'), '_low', '.low') || '.' || event_type AS style_key,
      CASE kind WHEN 'pivot_st_high' THEN 'STH' WHEN 'pivot_st_low' THEN 'STL' WHEN 'pivot_high' THEN 'PH' ELSE 'PL' END
        || CASE event_type WHEN 'replaced' THEN '~' ELSE 'x' END AS display_label, coalesce(successor, '') AS successor
      FROM m_pevents WHERE event_type IN ('replaced', 'invalidated')"""
    meta = "kind AS source_kind, state AS source_state, session_id, codes AS explanation_codes, {} || CASE WHEN state = 'candidate' THEN '?' ELSE '' END AS display_label, coalesce(confirm_bar_id, -1) AS confirm_bar_id"
    q["O03_overlay_meta"] = f"""SELECT symbol, 'leg-line:v1:' || structure_id AS overlay_id, {meta.format("CASE kind WHEN 'leg_up' THEN 'LU' ELSE 'LD' END")} FROM m_legs
      UNION ALL SELECT symbol, 'major-lh-marker:v1:' || structure_id, {meta.format("'LH'")} FROM m_major"""
    q["O04_render_order"] = """SELECT symbol, overlay_id, CAST(CASE kind WHEN 'leg-line' THEN 1 ELSE 2 END AS BIGINT) AS z_order, CAST(CASE WHEN layer = 'pivot' THEN 1 ELSE 0 END AS BIGINT) AS tier_rank, first_anchor FROM m_draw"""
    q["O05_overlays_in_window"] = f"SELECT symbol, overlay_id, layer, anchor_bars FROM m_draw WHERE layer IN ('pivot', 'leg') AND last_anchor >= {CENTER_BAR} AND first_anchor <= {CURSOR_BAR}"
    q["O06_layer_counts"] = "SELECT symbol, 'eth_full' AS session_profile, '1m' AS timeframe, layer, count(*) AS overlays FROM m_draw GROUP BY symbol, layer"

    q["W01_window_by_center"] = f"SELECT {BAR} FROM m_window"
    q["W01_window_by_session"] = f"""SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_id) AS rn FROM m_hour) h
      JOIN (SELECT symbol AS s, count(*) AS n FROM m_hour WHERE session_date = {WINDOW_SESSION} GROUP BY symbol) c ON s = symbol WHERE rn <= n + 4"""
    q["W01_window_by_time"] = f"""SELECT {BAR} FROM m_bars b JOIN (SELECT symbol AS s, min(i) AS lo, max(i) AS hi FROM m_bars
      WHERE ts_utc_ns BETWEEN {CENTER_BAR * MIN_NS} AND {(CENTER_BAR + 60) * MIN_NS} GROUP BY symbol) r ON s = symbol WHERE i BETWEEN lo - 4 AND hi + 4"""
    w03 = """SELECT s.symbol, structure_id, kind, state, start_bar_id, CAST(-1 AS BIGINT) AS end_bar_id, coalesce(confirm_bar_id, -1) AS confirm_bar_id, session_id, session_id AS session_date,
      CAST(start_bar_id AS VARCHAR) AS anchor_bar_ids, {} AS explanation_codes FROM {} s JOIN m_range r ON r.symbol = s.symbol AND start_bar_id BETWEEN lo AND hi"""
    q["W03_structures_in_window"] = f"""{w03.format('explanation_codes', 'm_state')} UNION ALL {w03.format('codes', 'm_visible')}
      WHERE NOT EXISTS (SELECT 1 FROM m_state x WHERE x.symbol = s.symbol AND x.structure_id = s.structure_id)"""
    q["W04_object_visibility"] = "SELECT symbol, structure_id, state, coalesce(confirm_bar_id, -1) AS confirm_bar_id FROM m_visible"
    q["W05_events_in_window"] = f"SELECT {PIVOT_EVENT.replace('symbol', 'e.symbol', 1)} FROM m_pe e JOIN m_range r ON r.symbol = e.symbol AND bar_id BETWEEN lo AND hi WHERE event_bar_id <= {CURSOR_BAR}"
    q["W06_structure_detail"] = """SELECT d.symbol, structure_id, kind, state, a.high AS anchor_high, a.low AS anchor_low, c.close AS confirm_close
      FROM (SELECT symbol, structure_id, kind, state, start_bar_id, confirm_bar_id FROM m_state
            UNION ALL SELECT symbol, structure_id, kind, state, start_bar_id, confirm_bar_id FROM m_visible v
              WHERE NOT EXISTS (SELECT 1 FROM m_pe e WHERE e.symbol = v.symbol AND e.structure_id = v.structure_id)) d
      JOIN m_bars a ON a.symbol = d.symbol AND a.bar_id = start_bar_id LEFT JOIN m_bars c ON c.symbol = d.symbol AND c.bar_id = confirm_bar_id"""
    touching = "SELECT l.symbol, l.start_bar_id, l.end_bar_id, lo, hi FROM m_legs l JOIN m_range r ON r.symbol = l.symbol AND end_bar_id >= lo AND start_bar_id <= hi"
    q["W07_anchor_widening"] = f"""SELECT b.symbol, b.bar_id, b.close FROM m_bars b JOIN (SELECT symbol, least(min(lo), min(start_bar_id)) AS lo, greatest(max(hi), max(end_bar_id)) AS hi
      FROM ({touching}) GROUP BY symbol) x ON x.symbol = b.symbol AND b.bar_id BETWEEN lo AND hi"""
    q["W07_missing_anchor_bars"] = f"""SELECT b.symbol, b.bar_id, b.close FROM m_bars b JOIN m_range r ON r.symbol = b.symbol WHERE b.bar_id BETWEEN lo AND hi
      OR EXISTS (SELECT 1 FROM ({touching}) t WHERE t.symbol = b.symbol AND b.bar_id IN (t.start_bar_id, t.end_bar_id))"""
    ghost = "'pivot-marker:v1:' || structure_id || ':' || event_type || ':' || event_bar_id"
    q["W08_replay_deltas"] = f"""SELECT e.symbol, event_id, event_type, CASE WHEN after = 'invalidated' THEN structure_id ELSE '' END AS remove_structure_id,
      CASE WHEN after = 'invalidated' THEN '' ELSE after END AS upsert_state, CASE WHEN after = 'invalidated' THEN 'pivot-marker:v1:' || structure_id ELSE '' END AS remove_overlay_id,
      CASE WHEN after = 'invalidated' THEN {ghost} ELSE 'pivot-marker:v1:' || structure_id END AS upsert_overlay_ids
      FROM m_pe e JOIN m_range r ON r.symbol = e.symbol AND bar_id BETWEEN lo AND hi"""
    q["W09_playback_steps"] = f"""SELECT f.symbol, 'bar:' || b.bar_id AS step_id, f.bar_id, f.open, max(b.high) OVER w AS high, min(b.low) OVER w AS low, b.close,
      CASE WHEN b.ts_utc_ns - f.ts_utc_ns = {4 * MIN_NS} THEN f.bar_id ELSE coalesce(prev, -1) END AS as_of_bar_id, b.ts_utc_ns - f.ts_utc_ns = {4 * MIN_NS} AS closes_display_bar
      FROM (SELECT *, lag(bar_id) OVER (PARTITION BY symbol ORDER BY bar_id) AS prev FROM m_fam5) f
      JOIN m_bars b ON b.symbol = f.symbol AND b.ts_utc_ns BETWEEN f.ts_utc_ns AND f.ts_utc_ns + {4 * MIN_NS}
      WHERE f.ts_utc_ns BETWEEN {CENTER_BAR * MIN_NS} AND {(CENTER_BAR + 120) * MIN_NS}
      WINDOW w AS (PARTITION BY f.symbol, f.bar_id ORDER BY b.bar_id)"""
    a9 = "0.2::DOUBLE * b.close + 0.8::DOUBLE * e.v"
    q["W11_ema_lines"] = f"""m_recursion AS (
        SELECT symbol, i, CAST(close AS DOUBLE) AS v, bar_id FROM m_bars WHERE i = 0
        UNION ALL SELECT b.symbol, b.i, {a9}, b.bar_id FROM m_recursion e JOIN m_bars b ON b.symbol = e.symbol AND b.i = e.i + 1),
      m_recursion_window AS (
        SELECT symbol, p, CAST(close AS DOUBLE) AS v, bar_id FROM m_win WHERE p = 0
        UNION ALL SELECT b.symbol, b.p, {a9}, b.bar_id FROM m_recursion_window e JOIN m_win b ON b.symbol = e.symbol AND b.p = e.p + 1)
      SELECT symbol, bar_id, 'window' AS seed, round(v, 6) AS ema_9 FROM m_recursion_window
      UNION ALL SELECT r.symbol, r.bar_id, 'history', round(v, 6) FROM m_recursion r JOIN m_window w ON w.symbol = r.symbol AND w.bar_id = r.bar_id"""
    q["W13_objects_in_window"] = w03.format("codes", "m_objects")

    q["X01_live_minute_bars"] = q["B01_minute_bars"]
    q["X02_live_tick_deltas"] = 'SELECT symbol, session_date AS "TradingDay", event_order AS row_no, price, size, turnover_delta FROM m_trades'
    q["X03_live_pivot_events"] = """SELECT symbol, event_id, structure_id, kind, event_type, event_bar_id, event_order, after AS state_after_event, bar_id AS start_bar_id,
      confirm_id AS confirm_bar_id, coalesce(successor, '') AS successor_structure_id, e_session AS session_id, e_session AS session_date FROM m_pe"""
    q["X04_live_states"] = """SELECT symbol, structure_id, max_by(after, event_bar_id) AS state, kind, any_value(bar_id) AS start_bar_id, max(confirm_id) AS confirm_bar_id,
      max_by(e_session, event_bar_id) AS session_id, any_value(codes) AS explanation_codes FROM m_pe GROUP BY symbol, structure_id, kind
      HAVING max_by(after, event_bar_id) <> 'invalidated'"""
    q["W03_structure_payload"] = """SELECT s.symbol, structure_id, round(price, 6) AS extreme_price, CAST(3 AS BIGINT) AS left_window
      FROM m_state s JOIN m_range r ON r.symbol = s.symbol AND start_bar_id BETWEEN lo AND hi"""
    q["W06_leg_detail"] = f"""SELECT x.symbol, structure_id, state, CAST(2 AS BIGINT) AS n_anchors, a.high AS first_high, z.low AS last_low, 'pivot' AS structure_refs
      FROM ({q['L03_leg_states_as_of_bar']}) x JOIN m_bars a ON a.symbol = x.symbol AND a.bar_id = start_bar_id JOIN m_bars z ON z.symbol = x.symbol AND z.bar_id = end_bar_id"""
    derived_rows = " UNION ALL ".join(
        f"""SELECT e.symbol, event_id, structure_id, kind, event_type, event_bar_id, state_after_event, start_bar_id, end_bar_id,
        coalesce(confirm_bar_id, -1) AS confirm_bar_id, b.session_id FROM {v} e JOIN m_bars b ON b.symbol = e.symbol AND b.bar_id = e.event_bar_id"""
        for v in ("m_leg_events", "m_major_events"))
    all_events = f"""(SELECT symbol, event_id, structure_id, kind, event_type, event_bar_id, after AS state_after_event, bar_id AS start_bar_id,
      CAST(-1 AS BIGINT) AS end_bar_id, confirm_id AS confirm_bar_id, e_session AS session_id FROM m_pevents UNION ALL {derived_rows})"""
    near = "r.symbol = x.symbol AND greatest(x.start_bar_id, x.end_bar_id) >= lo AND x.start_bar_id <= hi"
    q["W10_chart_events"] = f"SELECT x.* FROM {all_events} x JOIN m_range r ON {near} WHERE event_bar_id <= {CURSOR_BAR}"
    all_objects = f"(SELECT {PIVOT_OBJECT} FROM m_anchors UNION ALL SELECT {LEG_OBJECT} FROM m_legs UNION ALL SELECT {MAJOR_OBJECT} FROM m_major)"
    shown = "symbol, structure_id, kind, state, start_bar_id, end_bar_id, confirm_bar_id"
    live = f"""(SELECT symbol, structure_id, kind, max_by(state_after_event, event_bar_id) AS state, any_value(start_bar_id) AS start_bar_id,
      any_value(end_bar_id) AS end_bar_id, max(confirm_bar_id) AS confirm_bar_id FROM {all_events} WHERE event_bar_id <= {CURSOR_BAR}
      GROUP BY symbol, structure_id, kind HAVING max_by(state_after_event, event_bar_id) <> 'invalidated')"""
    visible = f"""(SELECT {shown} FROM {live} UNION ALL SELECT {shown} FROM {all_objects} o WHERE start_bar_id <= {CURSOR_BAR}
      AND (state = 'candidate' OR (state = 'confirmed' AND CASE WHEN confirm_bar_id = -1 THEN start_bar_id ELSE confirm_bar_id END <= {CURSOR_BAR}))
      AND NOT EXISTS (SELECT 1 FROM {live} l WHERE l.symbol = o.symbol AND l.structure_id = o.structure_id))"""
    structures = f"SELECT x.* FROM {visible} x JOIN m_range r ON {near}"
    q["W10_chart_structures"] = structures
    q["W10_chart_bars"] = f"""SELECT {BAR} FROM m_bars b JOIN (SELECT r.symbol AS s, least(min(lo), min(start_bar_id)) AS a, greatest(max(hi), max(greatest(start_bar_id, end_bar_id))) AS z
      FROM m_range r LEFT JOIN ({structures}) t ON t.symbol = r.symbol GROUP BY r.symbol) ON s = b.symbol AND bar_id BETWEEN a AND z"""
    # Overlay rows. A drawn state has its kind, state, anchors and session; a ghost has its event's.
    label = "CASE kind WHEN 'pivot_st_high' THEN 'STH' WHEN 'pivot_st_low' THEN 'STL' WHEN 'pivot_high' THEN 'PH' WHEN 'pivot_low' THEN 'PL' WHEN 'leg_up' THEN 'LU' WHEN 'leg_down' THEN 'LD' ELSE 'LH' END"
    shape = "CASE WHEN kind LIKE 'leg%' THEN 'leg-line' WHEN kind = 'major_lh' THEN 'major-lh-marker' ELSE 'pivot-marker' END"
    layer = "CASE WHEN kind LIKE 'pivot_st%' THEN 'pivot_st' WHEN kind LIKE 'pivot%' THEN 'pivot' WHEN kind LIKE 'leg%' THEN 'leg' ELSE 'major_lh' END"
    style = "CASE WHEN kind = 'major_lh' THEN kind ELSE regexp_replace(kind, '_(high|low|up|down)$', '.\\1') END"
    keys = f"""CAST(CASE {shape} WHEN 'leg-line' THEN 1 WHEN 'pivot-marker' THEN 2 ELSE 3 END AS BIGINT) AS z_order,
      CAST(CASE WHEN {layer} = 'pivot' THEN 1 ELSE 0 END AS BIGINT) AS tier_rank, {layer} AS layer"""
    short = f"""{shape} || ':v1:' || structure_id AS overlay_id, {shape} AS kind, structure_id AS source_structure_id,
      CASE WHEN kind LIKE 'leg%' THEN a || ',' || z ELSE CAST(a AS VARCHAR) END AS anchor_bars, prices AS anchor_prices, {style} || '.' || state AS style_key,
      {label} || CASE WHEN state = 'candidate' THEN '?' ELSE '' END AS display_label, {keys}"""
    ghost_short = f"""{ghost} AS overlay_id, 'pivot-marker' AS kind, structure_id AS source_structure_id, CAST(bar_id AS VARCHAR) AS anchor_bars,
      CAST(price AS VARCHAR) AS anchor_prices, {style} || '.' || event_type AS style_key, {label} || CASE event_type WHEN 'replaced' THEN '~' ELSE 'x' END AS display_label,
      CAST(2 AS BIGINT) AS z_order, CAST(-1 AS BIGINT) AS tier_rank, {layer} AS layer"""
    long_row = """'d1' AS data_version, 'v1' AS overlay_version, kind AS source_kind, state AS source_state, session AS session_id, session AS session_date,
      codes AS explanation_codes, confirm AS confirm_bar_id, '' AS replay_event_type, CAST(-1 AS BIGINT) AS event_bar_id, '' AS reason_codes, '' AS successor_structure_id"""
    ghost_long = """'d1' AS data_version, 'v1' AS overlay_version, kind AS source_kind, 'invalidated' AS source_state, e_session AS session_id, e_session AS session_date,
      '' AS explanation_codes, CAST(-1 AS BIGINT) AS confirm_bar_id, event_type AS replay_event_type, event_bar_id, reason AS reason_codes, coalesce(successor, '') AS successor_structure_id"""
    ranged = "m_pe e JOIN m_range r ON r.symbol = e.symbol AND bar_id BETWEEN lo AND hi"
    states = f"""(SELECT e.symbol, event_id, structure_id, kind, bar_id AS a, bar_id AS z, CAST(price AS VARCHAR) AS prices, after AS state,
      e_session AS session, codes, confirm_id AS confirm FROM {ranged} WHERE after <> 'invalidated')"""
    gone = f"(SELECT e.* FROM {ranged} WHERE after = 'invalidated')"
    q["W08_replay_overlay_rows"] = f"SELECT symbol, event_id, {short}, {long_row} FROM {states} UNION ALL SELECT symbol, event_id, {ghost_short}, {ghost_long} FROM {gone}"
    # What the chart shows at the cursor, clipped to the bars it shows.
    shown_bars = f"(SELECT symbol AS s, min(bar_id) AS lo, max(bar_id) AS hi FROM ({q['W10_chart_bars']}) GROUP BY symbol)"
    anchors_of = f"(SELECT symbol AS t, structure_id AS i, any_value(anchor_bar_ids) AS ids FROM (SELECT symbol, structure_id, anchor_bar_ids FROM m_major_events UNION ALL SELECT symbol, structure_id, anchor_bar_ids FROM (SELECT {MAJOR_OBJECT} FROM m_major)) GROUP BY symbol, structure_id)"
    at_cursor = f"""(SELECT x.symbol, structure_id, kind, state, a, z, CASE WHEN kind = 'leg_up' THEN f.low || ',' || l.high WHEN kind = 'leg_down' THEN f.high || ',' || l.low
        WHEN kind LIKE '%_low' THEN CAST(f.low AS VARCHAR) ELSE CAST(f.high AS VARCHAR) END AS prices
      FROM (SELECT x.*, CASE WHEN kind = 'major_lh' THEN CAST(split_part(ids, ',', -1) AS BIGINT) ELSE start_bar_id END AS a,
              CASE WHEN kind LIKE 'leg%' THEN end_bar_id WHEN kind = 'major_lh' THEN CAST(split_part(ids, ',', -1) AS BIGINT) ELSE start_bar_id END AS z
            FROM ({structures}) x LEFT JOIN {anchors_of} ON t = x.symbol AND i = structure_id) x
      JOIN m_bars f ON f.symbol = x.symbol AND f.bar_id = a JOIN m_bars l ON l.symbol = x.symbol AND l.bar_id = z
      JOIN {shown_bars} ON s = x.symbol AND z >= lo AND a <= hi)"""
    ghosts_seen = f"(SELECT e.* FROM m_pevents e JOIN m_range r ON r.symbol = e.symbol AND bar_id BETWEEN lo AND hi WHERE after = 'invalidated' AND event_bar_id <= {CURSOR_BAR})"
    q["W10_chart_overlays"] = f"SELECT symbol, {short} FROM {at_cursor} UNION ALL SELECT symbol, {ghost_short} FROM {ghosts_seen}"
    # Without a cursor the chart shows the objects that are not invalidated, and bars out to their anchors.
    final = f"(SELECT x.* FROM {all_objects} x JOIN m_range r ON {near} WHERE state <> 'invalidated')"
    q["W10_chart_playback"] = f"""m_recursion_shown AS (
        SELECT b.*, CAST(row_number() OVER (PARTITION BY b.symbol ORDER BY b.bar_id) - 1 AS BIGINT) AS p, lag(b.bar_id) OVER (PARTITION BY b.symbol ORDER BY b.bar_id) AS prev
        FROM m_bars b JOIN (SELECT r.symbol AS s, least(min(lo), min(start_bar_id)) AS a, greatest(max(hi), max(greatest(start_bar_id, end_bar_id))) AS z
          FROM m_range r LEFT JOIN {final} t ON t.symbol = r.symbol GROUP BY r.symbol) ON s = b.symbol AND bar_id BETWEEN a AND z),
      m_recursion AS (
        SELECT symbol, p, CAST(close AS DOUBLE) AS v, bar_id FROM m_recursion_shown WHERE p = 0
        UNION ALL SELECT b.symbol, b.p, {a9}, b.bar_id FROM m_recursion e JOIN m_recursion_shown b ON b.symbol = e.symbol AND b.p = e.p + 1)
      SELECT symbol, 'bar:' || bar_id AS step_id, bar_id, close, bar_id AS as_of_bar_id, true AS closes_display_bar, round(v, 6) AS ema_9
      FROM m_recursion JOIN m_recursion_shown USING (symbol, bar_id)"""
    q["S02_tick_csv_numbered"] = q["S02_tick_csv"]
    q["T10_stored_pivot_objects"] = q["T07_pivot_objects"]
    q["T13_stored_legs"] = f"{q['T11_legs']} UNION ALL ({q['T12_major_lower_highs']})"
    q["T13_stored_leg_events"] = f"{q['T16_leg_events']} UNION ALL ({q['T16_major_lh_events']})"
    return q


def oracle_sql() -> dict[str, str]:
    return {name: compose(text) for name, text in _sql().items()}
