"""The catalogue's queries as plain SQL over the driver tables, for comparison."""

from __future__ import annotations

from itertools import combinations_with_replacement

from devicelog.plans.catalog import FILTER_END, FILTER_START
from devicelog.schema import (
    ALARM_CATEGORY_LABELS,
    ALARM_LOG_LABELS,
    AXIS_LABELS,
    CANONICAL,
    DISPLAY_LABELS,
    LIMIT_PAIRS,
    LIMITS,
    MEASUREMENTS,
    SENTINELS,
    TREND_PARAMETERS,
)

# The cells the device log has; every other canonical column is missing in it.
_CELLS = {
    "timestamp": "ts_raw",
    "alarm_overall": "alarm_raw",
    "alarm_bubble": "bubble_raw",
    "technical_fault": "fault_raw",
    "case_id": "case_raw",
    "pressure_delta_mmhg": "dp_raw",
    "sat_pre_pct": "sat_pre_raw",
    "flow_rate_lpm": "flow_raw",
    "pump_speed_rpm": "pump_raw",
    "alarm_flow_low_lpm": "flow_low_raw",
    "alarm_flow_high_lpm": "flow_high_raw",
}
_MEASURED = [c for c in MEASUREMENTS if c in _CELLS]
_FORMATS = [
    "%Y.%m.%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%Y%m%d%H%M%S",
]

_RAW = """
base AS (
  SELECT event_id AS row_ordinal, user_id AS session_id,
    CASE WHEN event_id % 97 = 0 THEN ''
         WHEN user_id % 3 = 0 THEN strftime(ts, '%Y.%m.%d %H:%M:%S.%f')
         WHEN user_id % 3 = 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
         ELSE strftime(ts, '%m/%d/%Y %H:%M:%S') END AS ts_raw,
    trim(concat(' C', CAST(user_id AS VARCHAR), ' ')) AS case_raw,
    CASE WHEN event_type = 'error' THEN 'Alarm' ELSE '' END AS alarm_raw,
    CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'E' WHEN 'click' THEN 'D'
         ELSE '--' END AS bubble_raw,
    CASE WHEN event_id % 50 = 0 THEN '1' ELSE '' END AS fault_raw,
    CASE WHEN event_id % 17 = 0 THEN '--' WHEN event_id % 19 = 0 THEN 'Lo'
         WHEN event_id % 23 = 0 THEN 'Hi' WHEN event_id % 29 = 0 THEN 'n/a'
         ELSE CAST(value AS VARCHAR) END AS flow_raw,
    CASE WHEN event_id % 13 = 0 THEN '--' ELSE json_extract_string(props, '$.k') END AS dp_raw,
    CAST(1000 + (event_id * 37) % 4000 AS VARCHAR) AS pump_raw,
    CASE WHEN user_id % 10 = 0 THEN '--'
         ELSE CAST(60 + (event_id * 7) % 40 AS VARCHAR) END AS sat_pre_raw,
    CASE WHEN user_id % 4 = 0 THEN 'A' ELSE CAST(user_id % 4 AS VARCHAR) END AS flow_low_raw,
    CASE WHEN user_id % 5 = 0 THEN 'D' ELSE '120' END AS flow_high_raw
  FROM events),
device_raw AS (
  SELECT * FROM base UNION ALL SELECT * FROM base WHERE row_ordinal % 40 = 0)"""


def _fails(i: int) -> str:
    return f"count(*) FILTER (ts_raw <> '' AND try_strptime(ts_raw, '{_FORMATS[i]}') IS NULL)"


_ELECT = f"""
elect AS (
  SELECT session_id, CASE {" ".join(f"WHEN {_fails(i)} = 0 THEN {i}" for i in range(6))} END AS ts_format
  FROM device_raw GROUP BY session_id)"""


def _number(cell: str) -> str:
    codes = ", ".join(f"'{s}'" for s in SENTINELS)
    return f"CASE WHEN {cell} IN ({codes}) THEN NULL ELSE TRY_CAST({cell} AS DOUBLE) END"


def _typed_column(c: str) -> str:
    return f"{_number(_CELLS[c]) if c in _CELLS else 'CAST(NULL AS DOUBLE)'} AS {c}"


_TYPED = f"""
typed AS (
  SELECT r.*, e.ts_format,
    CASE {" ".join(f"WHEN e.ts_format = {i} THEN try_strptime(ts_raw, '{f}')" for i, f in enumerate(_FORMATS))} END
      AS timestamp,
    case_raw AS case_id,
    {", ".join(_typed_column(c) for c in MEASUREMENTS + LIMITS)},
    alarm_raw = 'Alarm' AS alarm_active,
    CASE WHEN bubble_raw = '--' THEN 'OK' ELSE bubble_raw END AS alarm_bubble,
    {_number("fault_raw")} AS technical_fault
  FROM device_raw r JOIN elect e USING (session_id))"""

_CLEAN_COLUMNS = ["timestamp", "case_id", *MEASUREMENTS, *LIMITS]
_CLEAN_COLUMNS += ["alarm_active", "alarm_bubble", "technical_fault"]
_COLUMNS = ", ".join(_CLEAN_COLUMNS)

_LOG = f"""
log AS (
  SELECT session_id, {_COLUMNS}, min(row_ordinal) AS row_ordinal, count(*) AS copies
  FROM typed GROUP BY session_id, {_COLUMNS})"""

_EVENTS = """
alarms AS (
  SELECT session_id, row_ordinal, timestamp, case_id, 'overall' AS alarm_type, 'Alarm' AS alarm_value
  FROM log WHERE alarm_active
  UNION ALL
  SELECT session_id, row_ordinal, timestamp, case_id, 'bubble', alarm_bubble
  FROM log WHERE alarm_bubble IN ('A', 'E'))"""

_SESSIONS = """
sessions AS (
  SELECT session_id, arg_min(case_id, (timestamp IS NULL, timestamp, row_ordinal)) AS case_id,
         'device_' || lpad(CAST(session_id AS VARCHAR), 6, '0') || '.csv' AS filename,
         count(*) AS row_count, min(timestamp) AS time_start, max(timestamp) AS time_end,
         date_trunc('second', max(timestamp)) AS uploaded_at
  FROM log GROUP BY session_id)"""


def _long_of(columns: list[str]) -> str:
    selects = [
        f"SELECT session_id, row_ordinal, timestamp, alarm_active, '{c}' AS parameter, {c} AS value FROM log"
        for c in columns
    ]
    return " UNION ALL ".join(selects)


_LONG = f"\nlong AS ({_long_of(MEASUREMENTS)})"
_FENCES = """
quart AS (
  SELECT session_id, parameter, count(*) AS readings, quantile_cont(value, 0.25) AS q1,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM long WHERE value IS NOT NULL GROUP BY session_id, parameter),
fences AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence FROM quart),
placed AS (
  SELECT l.row_ordinal, l.timestamp, l.value, f.* FROM long l JOIN fences f USING (session_id, parameter)
  WHERE l.value IS NOT NULL)"""

_BASE = [_RAW, _ELECT, _TYPED, _LOG]


def _sql(body: str, *more: str) -> str:
    return "WITH" + ",".join([*_BASE, *more]) + "\n" + body.strip()


def _cells_of(columns: list[str]) -> str:
    present = [c for c in columns if c in _CELLS]
    return "\ncells AS (" + " UNION ALL ".join(
        f"SELECT session_id, '{c}' AS parameter, {_CELLS[c]} AS cell, {c} AS value FROM typed"
        for c in present
    ) + ")"


_CODES = ", ".join(f"'{s}'" for s in SENTINELS)


def _label(column: str, names: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {column} {cases} ELSE {column} END"


def _minutes(start: str, end: str) -> str:
    return f"date_diff('microsecond', {start}, {end}) / 60000000.0"


_W = "PARTITION BY session_id ORDER BY timestamp NULLS LAST, row_ordinal"
_HAS = ", ".join(f"count({c}) OVER (PARTITION BY session_id) > 0 AS has_{c}" for c in MEASUREMENTS)


def _feature(kind: str, c: str) -> str:
    frame = f"OVER ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    value = {
        "rolling_mean": f"avg({c}) {frame}",
        "rolling_std": f"coalesce(stddev_samp({c}) {frame}, 0)",
        "delta": f"coalesce({c} - lag({c}) OVER ({_W}), 0)",
    }[kind]
    return f"CASE WHEN has_{c} THEN round({value} + 1e-9, 6) END AS {kind}_{c}"


_RATIO = (
    "greatest(-50.0, least(50.0, coalesce(pressure_delta_mmhg / nullif(flow_rate_lpm, 0), 0.0)))"
)
_TARGET = f"""
target AS (
  SELECT *, coalesce(max(CAST(alarm_active AS INTEGER)) OVER
    ({_W} ROWS BETWEEN 5 FOLLOWING AND 9 FOLLOWING), 0) AS alarm_future FROM log)"""
_SPLIT = f"""
ranked AS (
  SELECT *, row_number() OVER ({_W}) - 1 AS position,
         row_number() OVER (ORDER BY session_id, timestamp NULLS LAST, row_ordinal) - 1 AS global_position,
         count(*) OVER () AS total FROM target),
split AS (
  SELECT *, CASE WHEN global_position < floor(total * 0.8) THEN 'train' ELSE 'test' END AS split FROM ranked)"""
_SCORED = """
scored AS (
  SELECT session_id, row_ordinal, CAST((row_ordinal * 7919) % 1009 AS DOUBLE) / 1008 AS risk_score,
         CAST(alarm_active AS INTEGER) AS label,
         CAST(CAST((row_ordinal * 7919) % 1009 AS DOUBLE) / 1008 >= 0.5 AS INTEGER) AS prediction FROM log),
levels AS (
  SELECT *, CASE WHEN risk_score < 0 OR risk_score > 1 THEN NULL WHEN risk_score <= 0.33 THEN 'Low'
                 WHEN risk_score <= 0.66 THEN 'Moderate' ELSE 'High' END AS risk_level FROM scored)"""

_SUMMARY = ", ".join(
    f"round({f}({c}) + 1e-9, 6) AS {c}_{n}"
    for c in MEASUREMENTS
    for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))
)
_SUMMARY_SHOWN = ", ".join(
    f"round_even(round({f}({c}), 9), 2) AS {c}_{n}"
    for c in MEASUREMENTS
    for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))
)
_TOTALS = """
totals AS (
  SELECT session_id, count(*) AS total_records, min(timestamp) AS time_start, max(timestamp) AS time_end,
         count(*) FILTER (alarm_active) AS alarm_events FROM log GROUP BY session_id)"""
_RATE1 = "round_even(100.0 * alarm_events / greatest(total_records, 1), 1)"

_CORR = "\npairs AS (" + " UNION ALL ".join(
    f"SELECT session_id, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM log"
    f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in combinations_with_replacement(_MEASURED, 2)
) + """),
corrs AS (
  SELECT session_id, a, b, corr(x, y) AS r FROM pairs GROUP BY session_id, a, b
  HAVING min(x) < max(x) AND min(y) < max(y)),
shown AS (
  SELECT *, count(*) FILTER (a = b) OVER (PARTITION BY session_id) AS varying FROM corrs)"""


def _report_sql() -> str:
    def f(c: int) -> str:
        hit = f"count(*) FILTER (label = {c} AND prediction = {c})"
        actual = f"count(*) FILTER (label = {c})"
        predicted = f"count(*) FILTER (prediction = {c})"
        return (
            f"coalesce({hit} / nullif({predicted}, 0), 0.0) AS p{c}, "
            f"coalesce({hit} / nullif({actual}, 0), 0.0) AS r{c}, "
            f"coalesce(2 * {hit} / nullif({actual} + {predicted}, 0), 0.0) AS f{c}, {actual} AS s{c}"
        )

    report = f"""
rep AS (SELECT {f(0)}, {f(1)},
        count(*) FILTER (label = prediction) / count(*) AS acc FROM scored)"""
    lines = [
        ("0", "p0", "r0", "f0", "s0"),
        ("1", "p1", "r1", "f1", "s1"),
        ("accuracy", "acc", "acc", "acc", "s0 + s1"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1"),
        (
            "weighted avg",
            "(p0 * s0 + p1 * s1) / (s0 + s1)",
            "(r0 * s0 + r1 * s1) / (s0 + s1)",
            "(f0 * s0 + f1 * s1) / (s0 + s1)",
            "s0 + s1",
        ),
    ]
    body = " UNION ALL ".join(
        f"SELECT '{n}' AS class, round({p} + 1e-9, 6) AS precision, round({r} + 1e-9, 6) AS recall, "
        f"round({f1} + 1e-9, 6) AS f1_score, CAST({s} AS BIGINT) AS support FROM rep"
        for n, p, r, f1, s in lines
    )
    return _sql(body, _SCORED, report)


def _audit_table_sql() -> str:
    measured = _cells_of(MEASUREMENTS).replace("cells AS", "mcells AS")
    limits = _cells_of(LIMITS).replace("cells AS", "lcells AS")
    parts = [
        "SELECT session_id, 'timestamp' AS step, '' AS parameter, 'status' AS metric, 'parsed' AS value FROM typed GROUP BY session_id",
        "SELECT session_id, 'timestamp', '', 'unparseable_rows', CAST(count(*) FILTER (timestamp IS NULL) AS VARCHAR) FROM typed GROUP BY session_id",
        f"SELECT session_id, 'measurements', parameter, 'sentinel_count', CAST(count(*) FILTER (cell IN ({_CODES})) AS VARCHAR) FROM mcells GROUP BY session_id, parameter",
        "SELECT session_id, 'measurements', parameter, 'total_nan_after', CAST(count(*) FILTER (value IS NULL) AS VARCHAR) FROM mcells GROUP BY session_id, parameter",
        "SELECT session_id, 'alarm_limits', parameter, 'total_nan_after', CAST(count(*) FILTER (value IS NULL) AS VARCHAR) FROM lcells GROUP BY session_id, parameter",
        "SELECT session_id, 'status_flags', '', 'alarm_active_true_count', CAST(count(*) FILTER (alarm_active) AS VARCHAR) FROM typed GROUP BY session_id",
        "SELECT session_id, 'status_flags', '', 'technical_fault_non_null', CAST(count(technical_fault) AS VARCHAR) FROM typed GROUP BY session_id",
        "SELECT session_id, 'status_flags', alarm_bubble, 'alarm_bubble_distribution', CAST(count(*) AS VARCHAR) FROM typed GROUP BY session_id, alarm_bubble",
        "SELECT session_id, 'case_id', case_id, 'rows', CAST(count(*) AS VARCHAR) FROM typed GROUP BY session_id, case_id",
        "SELECT session_id, 'dedup', '', 'duplicates_removed', CAST(sum(copies) - count(*) AS VARCHAR) FROM log GROUP BY session_id",
        "SELECT session_id, 'final_shape', '', 'rows', CAST(count(*) AS VARCHAR) FROM log GROUP BY session_id",
        f"SELECT DISTINCT session_id, 'final_shape', '', 'cols', '{len(_CELLS)}' FROM log",
    ]
    return _sql(" UNION ALL ".join(parts), measured, limits)


def _roundtrip_sql() -> str:
    """The audit table without the two lists, with the number of cases in place of the cases."""
    return f"""SELECT * FROM ({_audit_table_sql()})
WHERE metric <> 'alarm_bubble_distribution' AND step <> 'case_id'
UNION ALL
SELECT user_id, 'case_id', '', 'n_cases', '1' FROM events GROUP BY user_id"""


def _fallback_sql() -> str:
    iso, dash, slash = "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S"
    tries = ", ".join(f"try_strptime(ts_raw, '{f}')" for f in (iso, dash, slash))
    guess = " ".join(
        f"WHEN try_strptime(f.ts_raw, '{x}') IS NOT NULL THEN try_strptime(m.ts_raw, '{x}')"
        for x in (iso, dash, slash)
    )
    return f"""WITH m AS (
  SELECT event_id AS row_ordinal, user_id AS session_id,
    CASE WHEN event_id % 11 = 0 THEN 'junk' WHEN event_id % 97 = 0 THEN ''
         WHEN user_id % 3 = 0 THEN strftime(ts, '{iso}') WHEN user_id % 3 = 1 THEN strftime(ts, '{dash}')
         WHEN event_id % 7 = 0 THEN strftime(ts, '{dash}') ELSE strftime(ts, '{slash}') END AS ts_raw
  FROM events),
f AS (SELECT session_id, arg_min(ts_raw, row_ordinal) AS ts_raw FROM m WHERE ts_raw <> '' GROUP BY session_id),
c AS (SELECT session_id,
        count(*) FILTER (ts_raw <> '' AND try_strptime(ts_raw, '{dash}') IS NULL) = 0 AS device FROM m GROUP BY session_id)
SELECT m.session_id, m.row_ordinal,
  CASE WHEN c.device THEN try_strptime(m.ts_raw, '{dash}') {guess.replace("try_strptime(m.ts_raw", "try_strptime(m.ts_raw")}
       ELSE coalesce({tries.replace("ts_raw", "m.ts_raw")}) END AS timestamp
FROM m JOIN f USING (session_id) JOIN c USING (session_id)"""


def oracle_sql() -> dict[str, str]:
    start, end = f"TIMESTAMP '{FILTER_START}'", f"TIMESTAMP '{FILTER_END}'"
    sample = "session_id, row_ordinal, timestamp"
    measurements = ", ".join(MEASUREMENTS)
    cells = ", ".join(f"{_CELLS.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in CANONICAL)
    trend = ", ".join(f"'{c}'" for c in TREND_PARAMETERS)
    limit_long = " UNION ALL ".join(
        f"SELECT session_id, '{p}' AS parameter, '{side}' AS side, {c} AS value FROM log"
        for p, pair in LIMIT_PAIRS.items()
        for side, c in zip(("low", "high"), pair)
    )
    return {
        "ingest_raw": _sql(
            "SELECT session_id, row_ordinal AS record, CASE WHEN row_ordinal % 7 = 0 THEN 'first ' || row_ordinal || "
            f"',' || chr(10) || chr(10) || 'then \"' || session_id || '\"' ELSE '' END AS note, {cells} FROM device_raw"
        ),
        "load_report": """SELECT 'UNRECOGNISED_COLUMNS' AS code,
  'Columns without a canonical name, kept under their own: ' ||
  CASE WHEN user_id % 2 = 0 THEN 'Session, Record, Note' ELSE 'Note, Record, Session' END AS message,
  count(DISTINCT user_id) AS files FROM events GROUP BY ALL""",
        "stream_ingest": _sql("SELECT case_id, row_count, time_start, time_end FROM sessions", _SESSIONS),
        "map_columns": _sql(f"SELECT session_id, row_ordinal, {cells} FROM device_raw"),
        "new_files": _sql(
            "SELECT filename, 'in/' || filename AS source_file FROM sessions WHERE session_id % 2 = 0", _SESSIONS
        ),
        "build_sessions": _sql(
            "SELECT session_id, case_id, filename, row_count, time_start, time_end FROM sessions", _SESSIONS
        ),
        "store_measurements": _sql(
            f"SELECT {sample}, case_id, {measurements}, alarm_active, alarm_bubble, technical_fault FROM log"
        ),
        "alarm_events": _sql("SELECT * FROM alarms", _EVENTS),
        "list_sessions": _sql(
            "SELECT session_id, case_id, filename, uploaded_at FROM sessions "
            "ORDER BY uploaded_at DESC, session_id DESC",
            _SESSIONS,
        ),
        "session_measurements": _sql(
            f"SELECT {sample}, case_id, {measurements} FROM log "
            "ORDER BY timestamp NULLS LAST, session_id, row_ordinal"
        ),
        "multi_session_measurements": _sql(
            f"SELECT {sample}, {measurements}, alarm_active FROM log "
            "WHERE session_id IN (SELECT session_id FROM alarms) "
            "ORDER BY session_id, timestamp NULLS LAST, row_ordinal",
            _EVENTS,
        ),
        "session_alarms": _sql(
            "SELECT * FROM alarms ORDER BY timestamp NULLS LAST, session_id, row_ordinal", _EVENTS
        ),
        "multi_session_alarms": _sql(
            "SELECT * FROM alarms WHERE session_id IN (SELECT session_id FROM log WHERE technical_fault IS NOT NULL)"
            " ORDER BY session_id, timestamp NULLS LAST, row_ordinal",
            _EVENTS,
        ),
        "audit_json_roundtrip": _roundtrip_sql(),
        "clean_log": _sql(f"SELECT session_id, row_ordinal, {_COLUMNS} FROM log"),
        "parse_timestamps": _sql(f"SELECT {sample}, ts_format FROM typed"),
        "elect_ts_format": _sql("SELECT session_id, ts_format FROM elect"),
        "ts_fallback": _fallback_sql(),
        "clean_alarm_limits": _sql(f"SELECT session_id, row_ordinal, {', '.join(LIMITS)} FROM typed"),
        "dedup_rows": _sql("SELECT session_id, row_ordinal, copies FROM log"),
        "audit_timestamp": _sql(
            "SELECT session_id, 'parsed' AS status, count(*) FILTER (timestamp IS NULL) AS unparseable_rows, "
            "count(*) FILTER (ts_raw = '') AS blank_rows, max(ts_format) AS ts_format FROM typed GROUP BY session_id"
        ),
        "audit_sentinels": _sql(
            f"SELECT session_id, parameter, cell AS sentinel, count(*) AS n FROM cells "
            f"WHERE cell IN ({_CODES}) GROUP BY session_id, parameter, cell",
            _cells_of(MEASUREMENTS),
        ),
        "audit_measurements": _sql(
            f"SELECT session_id, parameter, count(*) FILTER (cell IN ({_CODES})) AS sentinel_count, "
            "count(*) FILTER (value IS NULL) AS total_nan_after FROM cells GROUP BY session_id, parameter",
            _cells_of(MEASUREMENTS),
        ),
        "audit_status_flags": _sql(
            "SELECT session_id, 'alarm_active_true_count' AS metric, '' AS code, count(*) FILTER (alarm_active) AS n "
            "FROM typed GROUP BY session_id "
            "UNION ALL SELECT session_id, 'technical_fault_non_null', '', count(technical_fault) FROM typed GROUP BY session_id "
            "UNION ALL SELECT session_id, 'alarm_bubble_distribution', alarm_bubble, count(*) FROM typed "
            "GROUP BY session_id, alarm_bubble"
        ),
        "audit_case_ids": _sql("SELECT session_id, case_id, count(*) AS n FROM typed GROUP BY session_id, case_id"),
        "audit_dedup": _sql(
            "SELECT session_id, CAST(sum(copies) - count(*) AS BIGINT) AS duplicates_removed FROM log GROUP BY session_id"
        ),
        "audit_final_shape": _sql(
            f"SELECT session_id, count(*) AS rows, CAST({len(_CELLS)} AS BIGINT) AS cols FROM log GROUP BY session_id"
        ),
        "audit_table": _audit_table_sql(),
        "audit_missing_readings": _sql(
            f"SELECT session_id, {_label('parameter', DISPLAY_LABELS)} AS parameter_label, "
            f"count(*) FILTER (cell IN ({_CODES})) AS unavailable_readings, "
            "count(*) FILTER (value IS NULL) AS total_missing FROM cells GROUP BY session_id, parameter",
            _cells_of(MEASUREMENTS),
        ),
        "filter_time_range": _sql(
            f"SELECT {sample}, {measurements} FROM log WHERE timestamp BETWEEN {start} AND {end}"
        ),
        "filter_alarm_time_range": _sql(
            f"SELECT * FROM alarms WHERE timestamp BETWEEN {start} AND {end}", _EVENTS
        ),
        "filter_alarm_only": _sql(f"SELECT {sample}, {measurements} FROM log WHERE alarm_active"),
        "time_bounds": _sql(
            "SELECT session_id, min(timestamp) AS time_start, max(timestamp) AS time_end FROM log GROUP BY session_id"
        ),
        "available_parameters": _sql(
            "SELECT session_id, parameter, count(value) AS readings FROM long GROUP BY session_id, parameter "
            "HAVING count(value) > 0",
            _LONG,
        ),
        "parameter_dim": _sql(
            f"SELECT session_id, parameter, {_label('parameter', DISPLAY_LABELS)} AS label, "
            f"{_label('parameter', AXIS_LABELS)} AS axis_label FROM long GROUP BY session_id, parameter "
            "HAVING count(value) > 0",
            _LONG,
        ),
        "trend_series": _sql(
            f"SELECT {sample}, parameter, value FROM long WHERE parameter IN ({trend})", _LONG
        ),
        "alarm_overlay": _sql(
            f"SELECT {sample}, parameter, value FROM long WHERE alarm_active AND parameter IN ({trend})", _LONG
        ),
        "alarm_log": _sql(
            'SELECT session_id, timestamp AS date_time, case_id AS "case", '
            f"{_label('alarm_type', ALARM_LOG_LABELS)} AS alarm_category, alarm_value AS device_code FROM alarms",
            _EVENTS,
        ),
        "label_cases": _sql(
            f"SELECT l.session_id, l.row_ordinal, l.timestamp, 'Case ' || s.case_id AS \"case\" "
            "FROM log l LEFT JOIN sessions s USING (session_id)",
            _SESSIONS,
        ),
        "session_alarm_join": _sql(
            "SELECT filename, alarm_type, alarm_value, count(*) AS events FROM alarms JOIN sessions USING (session_id) "
            "GROUP BY ALL",
            _EVENTS,
            _SESSIONS,
        ),
        "session_summary": _sql(
            "SELECT session_id, count(*) AS total_records, min(timestamp) AS time_start, max(timestamp) AS time_end, "
            f"round({_minutes('min(timestamp)', 'max(timestamp)')} + 1e-9, 6) AS duration_minutes, "
            "count(*) FILTER (alarm_active) AS alarm_events, "
            f"round(100.0 * count(*) FILTER (alarm_active) / count(*) + 1e-9, 6) AS alarm_rate_pct, {_SUMMARY} "
            "FROM log GROUP BY session_id"
        ),
        "session_cases": _sql(
            "SELECT session_id, case_id, count(*) AS records FROM log GROUP BY session_id, case_id"
        ),
        "parameter_stats": _sql(
            "SELECT session_id, parameter, round(avg(value) + 1e-9, 6) AS mean, min(value) AS min, max(value) AS max, "
            "round(stddev_samp(value) + 1e-9, 6) AS std_dev, round(100.0 * count(value) / count(*) + 1e-9, 6) AS coverage_pct, "
            f"count(value) AS readings, {_label('parameter', DISPLAY_LABELS)} AS label "
            "FROM long GROUP BY session_id, parameter HAVING count(value) > 0",
            _LONG,
        ),
        "alarm_kpis": _sql(
            "SELECT session_id, records, events AS alarm_events, round(100.0 * events / records + 1e-9, 6) AS coverage_pct, "
            "categories AS alarm_categories, round(100.0 * (records - events) / records + 1e-9, 6) AS remainder_pct, "
            "round(100.0 * alarm_rows / records + 1e-9, 6) AS row_coverage_pct FROM ("
            "SELECT l.session_id, l.records, l.alarm_rows, coalesce(a.events, 0) AS events, "
            "coalesce(a.categories, 0) AS categories FROM "
            "(SELECT session_id, count(*) AS records, count(*) FILTER (alarm_active OR alarm_bubble IN ('A', 'E')) "
            "AS alarm_rows FROM log GROUP BY session_id) l LEFT JOIN "
            "(SELECT session_id, count(*) AS events, count(DISTINCT alarm_type) AS categories FROM alarms "
            "GROUP BY session_id) a USING (session_id))",
            _EVENTS,
        ),
        "alarm_type_counts": _sql(
            f"SELECT session_id, alarm_type, count(*) AS events, {_label('alarm_type', ALARM_CATEGORY_LABELS)} "
            "AS alarm_category FROM alarms GROUP BY session_id, alarm_type",
            _EVENTS,
        ),
        "compare_summary": _sql(
            f"SELECT session_id, round({_minutes('t.time_start', 't.time_end')} + 1e-9, 6) AS duration_minutes, "
            "total_records, alarm_events, round(100.0 * alarm_events / total_records + 1e-9, 6) AS alarm_rate_pct, "
            + ", ".join(f"m.{c}_mean" for c in TREND_PARAMETERS)
            + ", 'Case ' || s.case_id AS \"case\", s.filename FROM totals t JOIN sessions s USING (session_id) "
            f"JOIN (SELECT session_id, {_SUMMARY} FROM log GROUP BY session_id) m USING (session_id)",
            _SESSIONS,
            _TOTALS,
        ),
        "alarm_rate_per_case": _sql(
            f"SELECT session_id, 'Case ' || case_id AS \"case\", {_RATE1} AS alarm_rate_pct "
            "FROM totals JOIN sessions USING (session_id)",
            _SESSIONS,
            _TOTALS,
        ),
        "cohort_alarm_frequency": _sql(
            f"SELECT session_id, total_records, alarm_events, {_RATE1} AS alarm_rate_pct, "
            "'Case ' || case_id AS \"case\" FROM totals JOIN sessions USING (session_id)",
            _SESSIONS,
            _TOTALS,
        ),
        "case_header": _sql(
            "SELECT session_id, strftime(time_start, '%d %b %Y  %H:%M') AS start_text, "
            "strftime(time_end, '%H:%M') AS end_text, "
            f"CAST(floor({_minutes('time_start', 'time_end')}) AS BIGINT) AS whole_minutes, total_records, alarm_events, "
            "round(100.0 * alarm_events / total_records + 1e-9, 6) AS alarm_rate_pct FROM totals",
            _TOTALS,
        ),
        "case_positions": _sql(
            "SELECT session_id, case_id, filename, row_number() OVER (ORDER BY uploaded_at DESC, session_id DESC) AS place, "
            "count(*) OVER () AS cases FROM sessions",
            _SESSIONS,
        ),
        "session_summary_display": _sql(
            "SELECT session_id, count(*) AS total_records, min(timestamp) AS time_start, max(timestamp) AS time_end, "
            f"round_even({_minutes('min(timestamp)', 'max(timestamp)')}, 1) AS duration_minutes, "
            f"count(*) FILTER (alarm_active) AS alarm_events, {_SUMMARY_SHOWN} FROM log GROUP BY session_id"
        ),
        "compare_summary_display": _sql(
            f"SELECT session_id, round_even({_minutes('t.time_start', 't.time_end')}, 1) AS duration_minutes, "
            "total_records, alarm_events, "
            + ", ".join(f"m.{c}_mean" for c in TREND_PARAMETERS)
            + ", 'Case ' || s.case_id AS \"case\", s.filename FROM totals t JOIN sessions s USING (session_id) "
            f"JOIN (SELECT session_id, {_SUMMARY_SHOWN} FROM log GROUP BY session_id) m USING (session_id)",
            _SESSIONS,
            _TOTALS,
        ),
        "cohort_stats_display": _sql(
            "SELECT parameter, round_even(quantile_cont(value, 0.5), 2) AS median, "
            "round_even(quantile_cont(value, 0.25), 1) AS q1, round_even(quantile_cont(value, 0.75), 1) AS q3, "
            "round_even(min(value), 2) AS min, round_even(max(value), 2) AS max, count(*) AS readings "
            "FROM long WHERE value IS NOT NULL GROUP BY parameter",
            _LONG,
        ),
        "cohort_stats": _sql(
            "SELECT parameter, round(quantile_cont(value, 0.5) + 1e-9, 6) AS median, "
            "round(quantile_cont(value, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(value, 0.75) + 1e-9, 6) AS q3, "
            "min(value) AS min, max(value) AS max, count(*) AS readings "
            "FROM long WHERE value IS NOT NULL GROUP BY parameter",
            _LONG,
        ),
        "box_stats": _sql(
            "SELECT session_id, parameter, readings, round(q1 + 1e-9, 6) AS q1, round(median + 1e-9, 6) AS median, round(q3 + 1e-9, 6) AS q3, "
            "round(low_fence + 1e-9, 6) AS low_fence, round(high_fence + 1e-9, 6) AS high_fence, "
            "min(value) FILTER (value BETWEEN low_fence AND high_fence) AS whisker_low, "
            "max(value) FILTER (value BETWEEN low_fence AND high_fence) AS whisker_high, "
            "count(*) FILTER (NOT value BETWEEN low_fence AND high_fence) AS outliers FROM placed GROUP BY ALL",
            _LONG,
            _FENCES,
        ),
        "box_outliers": _sql(
            f"SELECT {sample}, parameter, value FROM placed WHERE NOT value BETWEEN low_fence AND high_fence",
            _LONG,
            _FENCES,
        ),
        "histogram": _sql(
            "SELECT session_id, parameter, bin, round(lo + (bin - 1) * ((hi - lo) / 30) + 1e-9, 6) AS bin_start, "
            "round(lo + bin * ((hi - lo) / 30) + 1e-9, 6) AS bin_end, count(*) AS readings, round(mean + 1e-9, 6) AS mean FROM ("
            "SELECT session_id, parameter, lo, hi, mean, CAST(CASE WHEN hi > lo THEN "
            "least(30, floor((value - lo) / ((hi - lo) / 30)) + 1) ELSE 1 END AS INTEGER) AS bin "
            "FROM long JOIN (SELECT session_id, parameter, min(value) AS lo, max(value) AS hi, avg(value) AS mean "
            "FROM long WHERE value IS NOT NULL GROUP BY session_id, parameter) USING (session_id, parameter) "
            "WHERE value IS NOT NULL) GROUP BY session_id, parameter, bin, lo, hi, mean",
            _LONG,
        ),
        "correlation_matrix": _sql(
            "SELECT session_id, a AS parameter_a, b AS parameter_b, round(r + 1e-9, 6) AS correlation FROM shown WHERE varying >= 2 "
            "UNION ALL SELECT session_id, b, a, round(r + 1e-9, 6) FROM shown WHERE varying >= 2 AND a <> b",
            _CORR,
        ),
        "alarm_limit_bands": _sql(
            f"SELECT session_id, parameter, side, quantile_cont(value, 0.5) AS limit_value FROM ({limit_long}) "
            "WHERE value IS NOT NULL GROUP BY session_id, parameter, side"
        ),
        "compare_overlay": _sql(
            f"SELECT {sample}, round(elapsed + 1e-9, 6) AS elapsed_minutes, "
            "round(elapsed / nullif(max(elapsed) OVER (PARTITION BY session_id), 0) * 100 + 1e-9, 6) AS progress_pct, "
            "flow_rate_lpm FROM (SELECT *, "
            f"{_minutes('min(timestamp) OVER (PARTITION BY session_id)', 'timestamp')} AS elapsed "
            "FROM log WHERE timestamp IS NOT NULL)"
        ),
        "compare_parameters": _sql(
            "SELECT parameter, count(DISTINCT session_id) AS sessions, count(*) AS readings, "
            f"CAST(CASE parameter {' '.join(f'''WHEN '{c}' THEN {i}''' for i, c in enumerate(MEASUREMENTS))} END AS INTEGER) AS place "
            "FROM long WHERE value IS NOT NULL GROUP BY parameter ORDER BY place",
            _LONG,
        ),
        "default_selection": _sql(
            "SELECT session_id, case_id, filename FROM sessions ORDER BY uploaded_at DESC, session_id DESC LIMIT 2",
            _SESSIONS,
        ),
        "rolling_features": _sql(
            "SELECT session_id, row_ordinal, "
            + ", ".join(_feature(k, c) for k in ("rolling_mean", "rolling_std", "delta") for c in MEASUREMENTS)
            + f", round({_RATIO} + 1e-9, 6) AS pressure_flow_ratio FROM (SELECT *, {_HAS} FROM log)"
        ),
        "pressure_flow_ratio": _sql(
            f"SELECT session_id, row_ordinal, round({_RATIO} + 1e-9, 6) AS pressure_flow_ratio FROM log"
        ),
        "alarm_target": _sql("SELECT session_id, row_ordinal, alarm_future FROM target", _TARGET),
        "alarm_target_next": _sql(
            "SELECT session_id, row_ordinal, coalesce(max(CAST(alarm_active AS INTEGER)) OVER "
            f"({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS alarm_future FROM log"
        ),
        "train_test_split": _sql(
            "SELECT session_id, row_ordinal, position, global_position, split FROM split", _TARGET, _SPLIT
        ),
        "split_stats": _sql(
            "SELECT split, count(*) AS samples, round(avg(alarm_future) + 1e-9, 6) AS alarm_rate FROM split GROUP BY split",
            _TARGET,
            _SPLIT,
        ),
        "class_weights": _sql(
            "SELECT alarm_future AS label, count(*) AS n, "
            "round((SELECT count(*) FROM split WHERE split = 'train') / (2.0 * count(*)) + 1e-9, 6) AS weight "
            "FROM split WHERE split = 'train' GROUP BY alarm_future",
            _TARGET,
            _SPLIT,
        ),
        "auc": _sql(
            "SELECT round((sum(CASE WHEN label = 1 THEN mid ELSE 0 END) - any_value(pos) * (any_value(pos) + 1) / 2.0) "
            "/ (any_value(pos) * any_value(neg)) + 1e-9, 6) AS auc FROM ("
            "SELECT label, rank() OVER (ORDER BY risk_score) + (count(*) OVER (PARTITION BY risk_score) - 1) / 2.0 AS mid, "
            "CAST(sum(label) OVER () AS DOUBLE) AS pos, CAST(sum(1 - label) OVER () AS DOUBLE) AS neg FROM scored)",
            _SCORED,
        ),
        "classification_report": _report_sql(),
        "risk_levels": _sql(
            "SELECT session_id, row_ordinal, round(risk_score + 1e-9, 6) AS risk_score, risk_level FROM levels", _SCORED
        ),
        "risk_level_kpis": _sql(
            "SELECT session_id, round(100.0 * count(*) FILTER (risk_level = 'High') / count(*) + 1e-9, 6) AS high_pct, "
            "round(100.0 * count(*) FILTER (risk_level = 'Moderate') / count(*) + 1e-9, 6) AS moderate_pct, "
            "round(avg(risk_score) + 1e-9, 6) AS mean_score FROM levels GROUP BY session_id",
            _SCORED,
        ),
    }
