"""Cleaning: canonical names, timestamps, numbers, flags, case ids, duplicates.

A raw frame has one row per logged sample with ``session_id``, ``row_ordinal``
(place in its file) and text cells. A column that a file does not have is NULL;
a blank cell of a column it does have is ``''``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.functions import cells, timestamps
from devicelog.functions.cells import to_number
from devicelog.operators.sizes import Sizes, attached, measured
from devicelog.schema import (
    CANONICAL,
    COLUMN_MAP,
    LIMITS,
    MEASUREMENTS,
    MEASUREMENTS_SCHEMA,
    UNKNOWN_CASE,
)

KEYS = ["session_id", "row_ordinal"]
RAW = "raw"


def map_columns(
    df: DataFrame, keys: list[str] = KEYS, column_map: dict[str, str] = COLUMN_MAP
) -> DataFrame:
    """Rename device headers to canonical names and trim headers and cells.

    Columns outside the map go to ``extra``; canonical columns the frame lacks are NULL.
    """
    source = {c.strip(): c for c in df.columns if c not in keys}
    known = {column_map[name]: c for name, c in source.items() if name in column_map}
    unknown = {name: c for name, c in source.items() if name not in column_map}

    def cell(name: str) -> str:
        return cells.stripped(f"coalesce(CAST(`{name}` AS STRING), '')")

    extra = ", ".join(f"{cells.quoted(name)}, {cell(c)}" for name, c in unknown.items())
    return df.selectExpr(
        *keys,
        *[f"{cell(known[c]) if c in known else 'CAST(NULL AS STRING)'} AS {c}" for c in CANONICAL],
        f"{f'map({extra})' if extra else 'CAST(NULL AS MAP<STRING, STRING>)'} AS extra",
    )


def _matched(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with the kind of their timestamp and its parts, in steps of their own so that each is found once."""
    rows = rows.selectExpr("*", f"{kind} AS ts_kind")
    return rows.selectExpr("*", f"{timestamps.parts('timestamp', 'ts_kind')} AS ts_parts")


def elect_formats(raw: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """One row per session: the timestamp format that fits its whole file.

    Only if no device format does, the first timestamp of the file is looked up for
    its shape; the log is not read for that if there is no such file.
    """
    votes = timestamps.election("timestamp", "fits", "row_ordinal")
    found = (
        raw.selectExpr(*KEYS, "timestamp", f"{timestamps.fitting('timestamp')} AS fits")
        .groupBy("session_id")
        .agg(*[F.expr(v) for v in votes])
    )
    odd = found.where("common = 0").select("session_id", F.col("first_filled").alias("row_ordinal"))
    if sizes is None or sizes.fits_broadcast(32):
        odd = F.broadcast(odd)
    first = _matched(raw.select(*KEYS, "timestamp").join(odd, KEYS), timestamps.kind("timestamp")).selectExpr(
        "session_id",
        f"IF({timestamps.wall('ts_parts', 'ts_kind')} IS NULL, NULL, {timestamps.shape('ts_parts', 'ts_kind')}) AS shape",
    )
    # A row that is logged twice has the same place and the same text.
    first = first.groupBy("session_id").agg(F.max("shape").alias("shape"))
    return found.join(first, "session_id", "left").selectExpr(
        "session_id", f"{timestamps.elected('shape')} AS ts_format"
    )


def typed(raw: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Typed columns beside the raw cells (kept in the struct ``raw``), duplicates included."""
    sizes = sizes or measured(raw)
    with_format = attached(raw, elect_formats(raw, sizes), sizes, row_bytes=32)
    with_parts = _matched(with_format, timestamps.elected_kind("timestamp", "ts_format"))
    return with_parts.selectExpr(
        *KEYS,
        f"{timestamps.parsed_as('timestamp', 'ts_format', 'ts_parts', 'ts_kind')} AS timestamp",
        f"{cells.stripped(f'coalesce(case_id, {cells.quoted(UNKNOWN_CASE)})')} AS case_id",
        *[f"{to_number(c)} AS {c}" for c in MEASUREMENTS + LIMITS],
        f"{cells.alarm_flag('alarm_overall')} AS alarm_active",
        f"{cells.bubble_code('alarm_bubble')} AS alarm_bubble",
        f"{to_number('technical_fault')} AS technical_fault",
        "extra",
        "ts_format",
        f"struct({', '.join(CANONICAL)}) AS {RAW}",
    )


SOURCE_COLUMNS = [c for c in MEASUREMENTS_SCHEMA.names if c not in KEYS]


def copies(typed_log: DataFrame) -> DataFrame:
    """One row per distinct cleaned row of a session, with the number of copies.

    Copies are merged before the shuffle, so many copies of one row cost one row.
    """
    return (
        typed_log.groupBy("session_id", *SOURCE_COLUMNS)
        .agg(F.min("row_ordinal").alias("row_ordinal"), F.count(F.lit(1)).alias("copies"))
        .select(*MEASUREMENTS_SCHEMA.names, "copies")
    )


def deduplicated(typed_log: DataFrame) -> DataFrame:
    return copies(typed_log).drop("copies")


def clean(raw: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """The clean log: typed and without exact duplicates."""
    return deduplicated(typed(raw, sizes))
