"""The ``events`` table written as a device log: text cells under device headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DEVICE_LOG = """
WITH base AS (
  SELECT event_id AS row_ordinal,
         user_id AS session_id,
         CASE WHEN event_id % 97 = 0 THEN ''
              WHEN user_id % 3 = 0 THEN date_format(ts, 'yyyy.MM.dd HH:mm:ss.SSSSSS')
              WHEN user_id % 3 = 1 THEN date_format(ts, 'dd/MM/yyyy HH:mm:ss')
              ELSE date_format(ts, 'MM/dd/yyyy HH:mm:ss') END AS `Timestamp`,
         concat(' C', CAST(user_id AS STRING), ' ') AS `Case Number`,
         CASE WHEN event_type = 'error' THEN 'Alarm' ELSE '' END AS `Overall alarm status`,
         CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'E' WHEN 'click' THEN 'D'
              ELSE '--' END AS `Bubble alarm status`,
         CASE WHEN event_id % 50 = 0 THEN '1' ELSE '' END AS `Technical Fault`,
         CASE WHEN event_id % 17 = 0 THEN '--' WHEN event_id % 19 = 0 THEN 'Lo'
              WHEN event_id % 23 = 0 THEN 'Hi' WHEN event_id % 29 = 0 THEN 'n/a'
              ELSE CAST(value AS STRING) END AS `Flow rate L/min`,
         CASE WHEN event_id % 13 = 0 THEN '--'
              ELSE get_json_object(props, '$.k') END AS `Oxygenator pressure delta mmHg`,
         CAST(1000 + (event_id * 37) % 4000 AS STRING) AS `Measured pump speed PRM`,
         CASE WHEN user_id % 10 = 0 THEN '--'
              ELSE CAST(60 + (event_id * 7) % 40 AS STRING) END AS `Pre-oxygenator saturation %`,
         CASE WHEN user_id % 4 = 0 THEN 'A'
              ELSE CAST(user_id % 4 AS STRING) END AS `Flow alarm low limit L/min`,
         CASE WHEN user_id % 5 = 0 THEN 'D' ELSE '120' END AS `Flow alarm high limit L/min`
  FROM {events})
SELECT * FROM base
UNION ALL
SELECT * FROM base WHERE row_ordinal % 40 = 0
"""

_MIXED_CLOCKS = """
SELECT event_id AS row_ordinal,
       user_id AS session_id,
       CASE WHEN event_id % 11 = 0 THEN 'junk'
            WHEN event_id % 97 = 0 THEN ''
            WHEN user_id % 3 = 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
            WHEN user_id % 3 = 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
            WHEN event_id % 7 = 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
            ELSE date_format(ts, 'yyyy/MM/dd HH:mm:ss') END AS `Timestamp`
FROM {events}
"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def device_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one device sample (a session per user), with 1 in 40 written twice."""
    return spark.sql(_DEVICE_LOG, events=events(spark, folder))


def mixed_clock_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with a timestamp text that no device format fits for a whole session."""
    return spark.sql(_MIXED_CLOCKS, events=events(spark, folder))
