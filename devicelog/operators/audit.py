"""The audit trail of cleaning, as rows and as one JSON text per session.

All figures come from a typed log (see ``clean.typed``), which holds the raw
cells beside the typed values, duplicates included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.functions.cells import is_sentinel, quoted
from devicelog.functions.figures import lookup
from devicelog.operators.clean import RAW, copies
from devicelog.schema import CANONICAL, DISPLAY_LABELS, LIMITS, MEASUREMENTS, SENTINELS

AUDIT_JSON_SCHEMA = """
    timestamp STRUCT<status: STRING, unparseable_rows: BIGINT, sorted: BOOLEAN>,
    measurements MAP<STRING, STRUCT<sentinel_count: BIGINT,
        sentinels_found: MAP<STRING, BIGINT>, total_nan_after: BIGINT>>,
    alarm_limits MAP<STRING, BIGINT>,
    status_flags STRUCT<alarm_active_true_count: BIGINT,
        alarm_bubble_distribution: MAP<STRING, BIGINT>, technical_fault_non_null: BIGINT>,
    case_id STRUCT<n_cases: BIGINT, unique_cases: ARRAY<STRING>, note: STRING>,
    dedup STRUCT<duplicates_removed: BIGINT>,
    final_shape STRUCT<rows: BIGINT, cols: BIGINT>
"""


def _figures(typed_log: DataFrame) -> DataFrame:
    """Every figure that is a count over a session's rows, one row per session: one aggregate, no row taken apart.

    ``m_<column>`` has the device codes and missing values of a measurement, NULL
    where the file lacks the column, ``l_<column>`` the missing values of a limit.
    """
    known = [c for c in CANONICAL if c not in ("timestamp", "case_id")]

    def cells(c: str) -> str:
        codes = ", ".join(f"count_if({RAW}.{c} = {quoted(s)}) AS `{s}`" for s in SENTINELS)
        return (
            f"IF(count({RAW}.{c}) > 0, struct(count_if({is_sentinel(f'{RAW}.{c}')}) AS sentinel_count, "
            f"count_if({c} IS NULL AND {RAW}.{c} IS NOT NULL) AS total_nan_after, struct({codes}) AS codes), NULL) AS m_{c}"
        )

    present = " + ".join(f"IF(count({RAW}.{c}) > 0, 1, 0)" for c in known)
    return typed_log.groupBy("session_id").agg(
        F.expr(f"IF(count({RAW}.timestamp) > 0, 'parsed', 'column_missing') AS status"),
        F.expr(f"count_if(timestamp IS NULL AND {RAW}.timestamp IS NOT NULL) AS unparseable_rows"),
        F.expr(f"count_if({RAW}.timestamp = '') AS blank_rows"),
        F.max("ts_format").alias("ts_format"),
        *[F.expr(cells(c)) for c in MEASUREMENTS],
        *[
            F.expr(f"IF(count({RAW}.{c}) > 0, count_if({c} IS NULL AND {RAW}.{c} IS NOT NULL), NULL) AS l_{c}")
            for c in LIMITS
        ],
        F.expr("IF(count(alarm_active) > 0, count_if(alarm_active), NULL) AS alarm_active_true_count"),
        F.expr(f"IF(count({RAW}.technical_fault) > 0, count(technical_fault), NULL) AS technical_fault_non_null"),
        # Cleaning adds a missing timestamp or case id, so those two always count.
        F.expr(f"CAST(2 + max(coalesce(size(extra), 0)) + {present} AS BIGINT) AS cols"),
    )


def _by_value(typed_log: DataFrame) -> DataFrame:
    """Rows per bubble code and per case id of each session, from one scan: ``kind``, ``value``, ``n``, ``defaulted``."""
    return (
        typed_log.groupingSets(
            [[F.col("session_id"), F.col("alarm_bubble")], [F.col("session_id"), F.col("case_id")]],
            "session_id",
            "alarm_bubble",
            "case_id",
        )
        .agg(
            F.grouping("case_id").alias("is_bubble"),
            F.count(F.lit(1)).alias("n"),
            F.expr(f"count({RAW}.case_id) = 0 AS defaulted"),
        )
        .selectExpr(
            "session_id",
            "IF(is_bubble = 1, 'bubble', 'case') AS kind",
            "IF(is_bubble = 1, alarm_bubble, case_id) AS value",
            "n",
            "defaulted",
        )
        .where("kind = 'case' OR value IS NOT NULL")
    )


def timestamp_audit(typed_log: DataFrame) -> DataFrame:
    """Rows whose timestamp could not be read; blanks count as such and are shown apart."""
    return _figures(typed_log).select("session_id", "status", "unparseable_rows", "blank_rows", "ts_format")


def _stacked(figures: DataFrame, columns: list[str], prefix: str, fields: dict[str, str]) -> DataFrame:
    """A row for each of a session's columns that its file has."""
    entries = ", ".join(
        f"IF({prefix}{c} IS NULL, NULL, struct('{c}' AS parameter, "
        + ", ".join(f"{of.format(prefix + c)} AS {name}" for name, of in fields.items())
        + "))"
        for c in columns
    )
    return figures.selectExpr("session_id", f"inline(array_compact(array({entries})))")


_CELL_FIELDS = {"sentinel_count": "{}.sentinel_count", "total_nan_after": "{}.total_nan_after"}


def measurement_audit(typed_log: DataFrame) -> DataFrame:
    """Device codes and missing values per session and measurement it has."""
    return _stacked(_figures(typed_log), MEASUREMENTS, "m_", _CELL_FIELDS)


def sentinel_audit(typed_log: DataFrame) -> DataFrame:
    """How often each device code stands in each measurement column."""
    codes = {f"`{s}`": f"{{}}.codes.`{s}`" for s in SENTINELS}
    return (
        _stacked(_figures(typed_log), MEASUREMENTS, "m_", codes)
        .unpivot(["session_id", "parameter"], [f"`{s}`" for s in SENTINELS], "sentinel", "n")
        .where("n > 0")
    )


def limit_audit(typed_log: DataFrame) -> DataFrame:
    return _stacked(_figures(typed_log), LIMITS, "l_", {"total_nan_after": "{}"})


def flag_audit(typed_log: DataFrame) -> DataFrame:
    """Active alarms, readable fault codes, and rows per bubble code."""
    counts = (
        _figures(typed_log)
        .unpivot(
            ["session_id"], ["alarm_active_true_count", "technical_fault_non_null"], "metric", "n"
        )
        .where("n IS NOT NULL")
        .selectExpr("session_id", "metric", "'' AS code", "n")
    )
    return counts.unionByName(
        bubble_counts(typed_log).withColumn("metric", F.lit("alarm_bubble_distribution"))
    )


def bubble_counts(typed_log: DataFrame) -> DataFrame:
    return (
        typed_log.where("alarm_bubble IS NOT NULL")
        .groupBy("session_id", F.col("alarm_bubble").alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def case_audit(typed_log: DataFrame) -> DataFrame:
    """The distinct case ids of each session, one row each, with their rows."""
    return typed_log.groupBy("session_id", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count({RAW}.case_id) = 0 AS defaulted")
    )


def dedup_audit(typed_log: DataFrame) -> DataFrame:
    return copies(typed_log).groupBy("session_id").agg(
        F.expr("sum(copies) - count(1) AS duplicates_removed")
    )


def _merged(typed_log: DataFrame) -> DataFrame:
    """Rows left and duplicates removed per session."""
    return copies(typed_log).groupBy("session_id").agg(
        F.expr("sum(copies) - count(1) AS duplicates_removed"), F.expr("count(1) AS rows")
    )


def shape_audit(typed_log: DataFrame) -> DataFrame:
    """Duplicates removed, rows left, and columns of the cleaned file."""
    return _merged(typed_log).join(_figures(typed_log).select("session_id", "cols"), "session_id")


def audit_table(typed_log: DataFrame) -> DataFrame:
    """Every audited figure as one row: session, step, parameter, metric, value.

    Three scans: counts over a session's rows, rows per code and case id, duplicates.
    """

    def entry(step: str, parameter: str, metric: str, value: str) -> str:
        return f"struct('{step}' AS step, {parameter} AS parameter, '{metric}' AS metric, CAST({value} AS STRING) AS value)"

    def given(test: str, one: str) -> str:
        return f"IF({test} IS NULL, NULL, {one})"

    counts = [entry("timestamp", "''", m, m) for m in ("status", "unparseable_rows")]
    counts += [given(f"m_{c}", entry("measurements", f"'{c}'", m, f"m_{c}.{m}")) for c in MEASUREMENTS for m in _CELL_FIELDS]
    counts += [given(f"l_{c}", entry("alarm_limits", f"'{c}'", "total_nan_after", f"l_{c}")) for c in LIMITS]
    flags = ("alarm_active_true_count", "technical_fault_non_null")
    counts += [given(m, entry("status_flags", "''", m, m)) for m in flags]
    counts.append(entry("final_shape", "''", "cols", "cols"))
    merged = [entry("dedup", "''", "duplicates_removed", "duplicates_removed"), entry("final_shape", "''", "rows", "rows")]
    by_value = _by_value(typed_log).selectExpr(
        "session_id",
        "IF(kind = 'case', 'case_id', 'status_flags') AS step",
        "value AS parameter",
        "IF(kind = 'case', 'rows', 'alarm_bubble_distribution') AS metric",
        "CAST(n AS STRING) AS value",
    )

    def listed(df: DataFrame, entries: list[str]) -> DataFrame:
        return df.selectExpr("session_id", f"inline(array_compact(array({', '.join(entries)})))")

    return listed(_figures(typed_log), counts).unionByName(by_value).unionByName(listed(_merged(typed_log), merged))


def missing_readings(typed_log: DataFrame) -> DataFrame:
    """The reader's per-parameter table: unavailable readings and total missing."""
    return measurement_audit(typed_log).select(
        "session_id",
        lookup(F.col("parameter"), DISPLAY_LABELS).alias("parameter_label"),
        F.col("sentinel_count").alias("unavailable_readings"),
        F.col("total_nan_after").alias("total_missing"),
    )


def audit_json(typed_log: DataFrame) -> DataFrame:
    """One JSON text per session with every step of its cleaning.

    Reads the log three times, as the audit table does, so pass one that is written.
    """

    def column(c: str) -> str:
        found = ", ".join(f"struct({quoted(s)} AS key, m_{c}.codes.`{s}` AS value)" for s in SENTINELS)
        return (
            f"IF(m_{c} IS NULL, NULL, struct('{c}' AS key, struct(m_{c}.sentinel_count AS sentinel_count, "
            f"map_from_entries(filter(array({found}), e -> e.value > 0)) AS sentinels_found, "
            f"m_{c}.total_nan_after AS total_nan_after) AS value))"
        )

    def in_order(entries: str) -> str:
        by_key = "(p, q) -> CASE WHEN p.key < q.key THEN -1 WHEN p.key > q.key THEN 1 ELSE 0 END"
        return f"map_from_entries(array_sort({entries}, {by_key}))"

    def some(columns: list[str], of: Callable[[str], str], name: str) -> str:
        listed = f"array_compact(array({', '.join(of(c) for c in columns)}))"
        return f"IF(size({listed}) > 0, {in_order(listed)}, NULL) AS {name}"

    figures = _figures(typed_log).selectExpr(
        "session_id",
        "IF(status = 'parsed', struct(status, unparseable_rows, true AS sorted), "
        "struct(status, CAST(NULL AS BIGINT) AS unparseable_rows, CAST(NULL AS BOOLEAN) AS sorted)) "
        "AS timestamp",
        some(MEASUREMENTS, column, "measurements"),
        some(LIMITS, lambda c: f"IF(l_{c} IS NULL, NULL, struct('{c}' AS key, l_{c} AS value))", "alarm_limits"),
        "alarm_active_true_count",
        "technical_fault_non_null",
        "cols",
    )
    # The lists hold what the audit names: all codes and case ids of a session.
    values = _by_value(typed_log).groupBy("session_id").agg(
        F.expr("collect_list(IF(kind = 'bubble', struct(value AS key, n AS value), NULL)) AS codes"),
        F.expr("array_sort(collect_list(IF(kind = 'case', value, NULL))) AS unique_cases"),
        F.expr("count_if(kind = 'case') AS n_cases"),
        F.expr("bool_or(defaulted) FILTER (WHERE kind = 'case') AS defaulted"),
    )
    values = values.selectExpr(
        "session_id",
        f"IF(size(codes) > 0, {in_order('codes')}, NULL) AS alarm_bubble_distribution",
        "unique_cases",
        "n_cases",
        "defaulted",
    )
    # Every part has one row per session, so no session is long here.
    joined = figures.join(values, "session_id", "left").join(_merged(typed_log), "session_id", "left")
    return joined.selectExpr(
        "session_id",
        """to_json(struct(
            timestamp,
            measurements,
            alarm_limits,
            struct(alarm_active_true_count, alarm_bubble_distribution, technical_fault_non_null)
                AS status_flags,
            struct(n_cases, unique_cases,
                   IF(defaulted, "case_id defaulted to 'unknown'", NULL) AS note) AS case_id,
            struct(duplicates_removed) AS dedup,
            struct(rows, cols) AS final_shape)) AS provenance""",
    )


def read_audit(sessions: DataFrame) -> DataFrame:
    """Stored audit texts as rows; a text that cannot be read gives one ``unavailable`` row."""
    read = sessions.select(
        "session_id", F.from_json("provenance", AUDIT_JSON_SCHEMA, {"mode": "PERMISSIVE"}).alias("a")
    )
    scalars = [
        ("timestamp", "status"),
        ("timestamp", "unparseable_rows"),
        ("status_flags", "alarm_active_true_count"),
        ("status_flags", "technical_fault_non_null"),
        ("case_id", "n_cases"),
        ("dedup", "duplicates_removed"),
        ("final_shape", "rows"),
        ("final_shape", "cols"),
    ]

    def entry(step: str, parameter: str, metric: str, value: str) -> str:
        return (
            f"struct('{step}' AS step, {parameter} AS parameter, '{metric}' AS metric, "
            f"CAST({value} AS STRING) AS value)"
        )

    fixed = "array(" + ", ".join(entry(s, "''", m, f"a.{s}.{m}") for s, m in scalars) + ")"
    maps = [("measurements", "sentinel_count", "e.value.sentinel_count")]
    maps += [("measurements", "total_nan_after", "e.value.total_nan_after")]
    maps += [("alarm_limits", "total_nan_after", "e.value")]
    listed = [
        f"coalesce(transform(map_entries(a.{s}), e -> {entry(s, 'e.key', m, v)}), array())"
        for s, m, v in maps
    ]
    unavailable = f"array({entry('audit', quoted(''), 'unavailable', quoted(''))})"
    return read.selectExpr(
        "session_id",
        f"inline(IF(a.final_shape.rows IS NOT NULL, concat({fixed}, {', '.join(listed)}), {unavailable}))",
    ).where("value IS NOT NULL")
