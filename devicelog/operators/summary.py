"""One row of figures per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelog.functions.figures import count_if, lookup, percent, rounded
from devicelog.operators.sizes import Sizes, attached
from devicelog.schema import DISPLAY_LABELS, MEASUREMENTS, TREND_PARAMETERS


_MINUTES = "timestampdiff(MICROSECOND, time_start, time_end) / 6e7D"


def _totals(log: DataFrame, *more: Column) -> DataFrame:
    return log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
        count_if(F.col("alarm_active")).alias("alarm_events"),
        *more,
    )


def session_summary(log: DataFrame, display: bool = True) -> DataFrame:
    """Records, time span, alarms, and mean, minimum and maximum of each parameter.

    For display minutes have one decimal and figures two. The ids of the cases in
    a session are rows of :func:`session_cases`.
    """
    kinds = ("avg", "min", "max")
    names = {f"{kind}({c})": f"{c}_{kind.replace('avg', 'mean')}" for c in MEASUREMENTS for kind in kinds}
    totals = _totals(log, *[F.expr(f"{figure} AS {name}") for figure, name in names.items()])

    def shown(value: str, digits: int) -> str:
        # Noise of the order of summation is cut first, so that ties do not depend on partitions.
        return f"bround(round({value}, 9), {digits})" if display else value

    return totals.selectExpr(
        "session_id",
        "total_records",
        "time_start",
        "time_end",
        f"{shown(_MINUTES, 1)} AS duration_minutes",
        "alarm_events",
        "100.0D * alarm_events / total_records AS alarm_rate_pct",
        *[f"{shown(name, 2)} AS {name}" for name in names.values()],
    )


def session_cases(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id", "case_id").agg(F.count(F.lit(1)).alias("records"))


def parameter_stats(log: DataFrame) -> DataFrame:
    """Mean, extremes, spread and coverage per session and parameter with readings."""
    # Samples are aggregated as they are; only the figures are taken apart, eight rows a session.
    figures = ", ".join(
        f"struct('{c}' AS parameter, avg({c}) AS mean, min({c}) AS min, max({c}) AS max, "
        f"stddev_samp({c}) AS std_dev, 100.0D * count({c}) / count(1) AS coverage_pct, count({c}) AS readings)"
        for c in MEASUREMENTS
    )
    return (
        log.groupBy("session_id")
        .agg(F.expr(f"array({figures}) AS figures"))
        .selectExpr("session_id", "inline(figures)")
        .where("readings > 0")
        .withColumn("label", lookup(F.col("parameter"), DISPLAY_LABELS))
    )


def case_header(log: DataFrame) -> DataFrame:
    """The header card: start, end, whole minutes, alarms, alarm rate."""
    return _totals(log).select(
        "session_id",
        F.date_format("time_start", "dd MMM yyyy  HH:mm").alias("start_text"),
        F.date_format("time_end", "HH:mm").alias("end_text"),
        F.expr(f"CAST(floor({_MINUTES}) AS BIGINT) AS whole_minutes"),
        "total_records",
        "alarm_events",
        percent(F.col("alarm_events"), F.col("total_records")).alias("alarm_rate_pct"),
    )


def alarm_rates(log: DataFrame) -> DataFrame:
    """Records, alarms and alarm rate (one decimal) per session."""
    return _totals(log).select(
        "session_id",
        "total_records",
        "alarm_events",
        rounded(
            F.lit(100.0) * F.col("alarm_events") / F.greatest("total_records", F.lit(1)), 1
        ).alias("alarm_rate_pct"),
    )


def case_label() -> Column:
    return F.concat(F.lit("Case "), F.col("case_id"))


def compared(
    log: DataFrame, sessions: DataFrame, sizes: Sizes, display: bool = True
) -> DataFrame:
    """The comparison table: one row per session, all sessions in one pass."""
    summary = session_summary(log, display).select(
        "session_id",
        "duration_minutes",
        "total_records",
        "alarm_events",
        "alarm_rate_pct",
        *[f"{c}_mean" for c in TREND_PARAMETERS],
    )
    labels = sessions.select("session_id", case_label().alias("case"), "filename")
    return attached(summary, labels, sizes)


def with_case(df: DataFrame, sessions: DataFrame, sizes: Sizes) -> DataFrame:
    """Tag rows with the label of their session's case."""
    labels = sessions.select("session_id", case_label().alias("case"))
    return attached(df, labels, sizes, how="left", row_bytes=64)
