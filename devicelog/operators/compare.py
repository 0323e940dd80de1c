"""Sessions side by side: navigator, default choice, common parameters, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.operators.filters import available_parameters, time_bounds
from devicelog.operators.positions import numbered
from devicelog.operators.sizes import Sizes, attached, measured
from devicelog.schema import MEASUREMENTS


def newest_first() -> list:
    return [F.desc("uploaded_at"), F.desc("session_id")]


def case_positions(sessions: DataFrame) -> DataFrame:
    """Place of each case in the newest-first list, and the length of the list."""
    cases = sessions.count()
    return numbered(sessions, newest_first(), cases).select(
        "session_id",
        "case_id",
        "filename",
        (F.col("number") + 1).cast("long").alias("place"),
        F.lit(cases).cast("long").alias("cases"),
    )


def default_selection(sessions: DataFrame, n: int = 2) -> DataFrame:
    """The cases compared when the reader has chosen none: the newest two."""
    if n < 1:
        raise ValueError("at least one case is compared")
    return sessions.orderBy(*newest_first()).limit(n).select("session_id", "case_id", "filename")


def compare_parameters(log: DataFrame) -> DataFrame:
    """Parameters with readings in any session, in canonical order."""
    places = F.create_map(*[F.lit(x) for i, c in enumerate(MEASUREMENTS) for x in (c, i)])
    return (
        available_parameters(log)
        .groupBy("parameter")
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("readings").alias("readings"))
        .withColumn("place", places[F.col("parameter")])
        .orderBy("place")
    )


def progress(log: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Minutes since the session's first sample and its share of the session's length.

    Samples without a timestamp drop out; a session of one instant has no share.
    """
    sizes = sizes or measured(log)
    timed = log.where(F.col("timestamp").isNotNull())
    elapsed = "timestampdiff(MICROSECOND, time_start, timestamp) / 6e7D"
    length = "timestampdiff(MICROSECOND, time_start, time_end) / 6e7D"
    return attached(timed, time_bounds(timed), sizes, row_bytes=48).selectExpr(
        *log.columns,
        f"{elapsed} AS elapsed_minutes",
        f"{elapsed} / nullif({length}, 0.0D) * 100 AS progress_pct",
    )


def alarms_per_file(alarm_events: DataFrame, sessions: DataFrame, sizes: Sizes) -> DataFrame:
    """Alarms by file, type and value; counted per session before the names of files are joined."""
    kinds = ["alarm_type", "alarm_value"]
    counts = alarm_events.groupBy("session_id", *kinds).agg(F.count(F.lit(1)).alias("events"))
    named = attached(counts, sessions.select("session_id", "filename"), sizes)
    return named.groupBy("filename", *kinds).agg(F.sum("events").alias("events"))
