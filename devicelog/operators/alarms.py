"""Alarm events and the figures built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.functions.figures import count_if, lookup, percent
from devicelog.schema import (
    ALARM_CATEGORY_LABELS,
    ALARM_EVENTS_SCHEMA,
    ALARM_TEXT,
    BUBBLE_ALARM_CODES,
)


def alarm_events(log: DataFrame, include_technical: bool = False) -> DataFrame:
    """One row per active alarm; a sample with two alarms gives two rows."""
    found = [
        F.when(
            F.col("alarm_active"),
            F.struct(F.lit("overall").alias("alarm_type"), F.lit(ALARM_TEXT).alias("alarm_value")),
        ),
        F.when(
            F.col("alarm_bubble").isin(BUBBLE_ALARM_CODES),
            F.struct(F.lit("bubble").alias("alarm_type"), F.col("alarm_bubble").alias("alarm_value")),
        ),
    ]
    if include_technical:
        found.append(
            F.when(
                F.col("technical_fault").isNotNull(),
                F.struct(
                    F.lit("technical").alias("alarm_type"),
                    F.col("technical_fault").cast("string").alias("alarm_value"),
                ),
            )
        )
    return (
        log.select(
            "session_id",
            "row_ordinal",
            "timestamp",
            "case_id",
            F.explode(F.array_compact(F.array(*found))).alias("event"),
        )
        .select("session_id", "row_ordinal", "timestamp", "case_id", "event.*")
        .select(*ALARM_EVENTS_SCHEMA.names)
    )


def alarm_kpis(log: DataFrame) -> DataFrame:
    """Events, coverage, categories and remainder per session, in one pass over the samples.

    ``coverage_pct`` counts events, so a sample with two alarms counts twice and
    the remainder can be negative; ``row_coverage_pct`` counts samples.
    """
    overall = F.coalesce("alarm_active", F.lit(False))
    bubble = F.coalesce(F.col("alarm_bubble").isin(BUBBLE_ALARM_CODES), F.lit(False))
    counted = log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"),
        count_if(overall).alias("overall_events"),
        count_if(bubble).alias("bubble_events"),
        count_if(overall | bubble).alias("alarm_rows"),
    )
    events = F.col("overall_events") + F.col("bubble_events")
    categories = (F.col("overall_events") > 0).cast("int") + (F.col("bubble_events") > 0).cast("int")
    return counted.select(
        "session_id",
        "records",
        events.alias("alarm_events"),
        percent(events, F.col("records")).alias("coverage_pct"),
        categories.alias("alarm_categories"),
        percent(F.col("records") - events, F.col("records")).alias("remainder_pct"),
        percent(F.col("alarm_rows"), F.col("records")).alias("row_coverage_pct"),
    )


def alarm_type_counts(events: DataFrame) -> DataFrame:
    """Events per session and alarm type, most frequent first within a session."""
    return (
        events.groupBy("session_id", "alarm_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("alarm_category", lookup(F.col("alarm_type"), ALARM_CATEGORY_LABELS))
        .orderBy("session_id", F.desc("events"), "alarm_type")
    )
