"""Filters and per-parameter views of a clean log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelog.functions.figures import lookup
from devicelog.schema import ALARM_LOG_LABELS, AXIS_LABELS, DISPLAY_LABELS, MEASUREMENTS


def in_time_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows from start to end, both included; rows without a timestamp drop out."""
    return df.where(F.col("timestamp").between(start, end))


def time_bounds(log: DataFrame) -> DataFrame:
    """First and last timestamp per session: the range a reader can choose from."""
    return log.groupBy("session_id").agg(
        F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end")
    )


def alarms_only(log: DataFrame) -> DataFrame:
    return log.where(F.col("alarm_active"))


def long_values(
    log: DataFrame, parameters: list[str] = MEASUREMENTS, ids: list[str] | None = None
) -> DataFrame:
    """One row per sample and parameter; missing values are kept."""
    return log.unpivot(ids or ["session_id"], parameters, "parameter", "value")


def readings(
    log: DataFrame, parameters: list[str] = MEASUREMENTS, ids: list[str] | None = None
) -> DataFrame:
    """One row per reading: missing values left out."""
    return long_values(log, parameters, ids).where(F.col("value").isNotNull())


def available_parameters(log: DataFrame) -> DataFrame:
    """Parameters with at least one reading, per session."""
    counts = log.groupBy("session_id").agg(*[F.count(c).alias(c) for c in MEASUREMENTS])
    return counts.unpivot(["session_id"], MEASUREMENTS, "parameter", "readings").where(
        "readings > 0"
    )


def labelled(df: DataFrame, parameter: str = "parameter") -> DataFrame:
    return df.withColumns(
        {
            "label": lookup(F.col(parameter), DISPLAY_LABELS),
            "axis_label": lookup(F.col(parameter), AXIS_LABELS),
        }
    )


SAMPLE = ["session_id", "row_ordinal", "timestamp"]


def trend_series(log: DataFrame, parameters: list[str]) -> DataFrame:
    """The points of the trend charts; gaps stay as NULL values."""
    return long_values(log, parameters, SAMPLE)


def alarm_overlay(log: DataFrame, parameters: list[str]) -> DataFrame:
    """The points at which an alarm was active."""
    return trend_series(alarms_only(log), parameters)


def alarm_log(events: DataFrame) -> DataFrame:
    """The alarm list under the reader's headings."""
    return events.select(
        "session_id",
        F.col("timestamp").alias("date_time"),
        F.col("case_id").alias("case"),
        lookup(F.col("alarm_type"), ALARM_LOG_LABELS).alias("alarm_category"),
        F.col("alarm_value").alias("device_code"),
    )
