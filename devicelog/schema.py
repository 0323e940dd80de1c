"""Names, codes and table schemas of the device-log model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Device headers, canonical names, device codes and labels.
# They are part of the data format, so results depend on them being exact.
# ---------------------------------------------------------------------------

COLUMN_MAP = {
    "Timestamp": "timestamp",
    "Overall alarm status": "alarm_overall",
    "Bubble alarm status": "alarm_bubble",
    "Technical Fault": "technical_fault",
    "Case Number": "case_id",
    "Pre-oxygenator pressure mmHg": "pressure_pre_mmhg",
    "Post-oxygenator pressure mmHg": "pressure_post_mmhg",
    "Oxygenator pressure delta mmHg": "pressure_delta_mmhg",
    "Pre-oxygenator saturation %": "sat_pre_pct",
    "Post-oxygenator saturation %": "sat_post_pct",
    "Post-oxygenator temperature C": "temp_post_c",
    "Flow rate L/min": "flow_rate_lpm",
    "Measured pump speed PRM": "pump_speed_rpm",
    "Flow alarm low limit L/min": "alarm_flow_low_lpm",
    "Flow alarm high limit L/min": "alarm_flow_high_lpm",
    "Pre-oxygenator pressure alarm low limit mmHg": "alarm_pressure_pre_low",
    "Pre-oxygenator pressure alarm high limit mmHg": "alarm_pressure_pre_high",
    "Post-oxygenator pressure alarm low limit mmHg": "alarm_pressure_post_low",
    "Post-oxygenator pressure alarm high limit mmHg": "alarm_pressure_post_high",
    "Oxygenator pressure delta alarm low limit mmHg": "alarm_pressure_delta_low",
    "Oxygenator pressure delta alarm high limit mmHg": "alarm_pressure_delta_high",
    "Pre-oxygenator saturation alarm low limit %": "alarm_sat_pre_low",
    "Pre-oxygenator saturation alarm high limit %": "alarm_sat_pre_high",
    "Post-oxygenator saturation alarm low limit %": "alarm_sat_post_low",
    "Post-oxygenator temperature alarm low limit C": "alarm_temp_post_low",
    "Post-oxygenator temperature alarm high limit C": "alarm_temp_post_high",
}

MEASUREMENTS = [
    "pressure_pre_mmhg",
    "pressure_post_mmhg",
    "pressure_delta_mmhg",
    "sat_pre_pct",
    "sat_post_pct",
    "temp_post_c",
    "flow_rate_lpm",
    "pump_speed_rpm",
]

LIMITS = [
    "alarm_flow_low_lpm",
    "alarm_flow_high_lpm",
    "alarm_pressure_pre_low",
    "alarm_pressure_pre_high",
    "alarm_pressure_post_low",
    "alarm_pressure_post_high",
    "alarm_pressure_delta_low",
    "alarm_pressure_delta_high",
    "alarm_sat_pre_low",
    "alarm_sat_pre_high",
    "alarm_sat_post_low",
    "alarm_temp_post_low",
    "alarm_temp_post_high",
]

# Codes a device writes in place of a number.
SENTINELS = ["--", "Lo", "Hi", "A", "D", "E"]

# Device timestamp formats, tried in this order on a whole file.
TIMESTAMP_FORMATS = [
    "yyyy.M.d H:m:s.SSSSSSSSS",
    "yyyy-M-d H:m:s.SSSSSSSSS",
    "yyyy-M-d H:m:s",
    "d/M/yyyy H:m:s",
    "M/d/yyyy H:m:s",
    "yyyyMMddHHmmss",
]

# Cells read as "no timestamp" by every format.
BLANK_TIMESTAMPS = ["", "NaT", "nat", "NAT", "nan", "NaN", "NAN"]

DISPLAY_LABELS = {
    "pressure_pre_mmhg": "Pre-Oxygenator Pressure (mmHg)",
    "pressure_post_mmhg": "Post-Oxygenator Pressure (mmHg)",
    "pressure_delta_mmhg": "Oxygenator ΔPressure (mmHg)",
    "sat_pre_pct": "Pre-Oxygenator SatO₂ (%)",
    "sat_post_pct": "Post-Oxygenator SatO₂ (%)",
    "temp_post_c": "Post-Oxygenator Temperature (°C)",
    "flow_rate_lpm": "Flow Rate (L/min)",
    "pump_speed_rpm": "Pump Speed (RPM)",
}

AXIS_LABELS = {
    "flow_rate_lpm": "Blood Flow (L/min)",
    "pump_speed_rpm": "Pump Speed (RPM)",
    "pressure_pre_mmhg": "Pressure — Pre-oxygenator (mmHg)",
    "pressure_post_mmhg": "Pressure — Post-oxygenator (mmHg)",
    "pressure_delta_mmhg": "Oxygenator ΔPressure (mmHg)",
    "sat_pre_pct": "Pre-oxygenator SatO₂ (%)",
    "sat_post_pct": "Post-oxygenator SatO₂ (%)",
    "temp_post_c": "Post-oxygenator Temperature (°C)",
}

TREND_PARAMETERS = ["flow_rate_lpm", "pressure_delta_mmhg", "sat_pre_pct", "pump_speed_rpm"]

LIMIT_PAIRS = {
    "flow_rate_lpm": ("alarm_flow_low_lpm", "alarm_flow_high_lpm"),
    "pressure_pre_mmhg": ("alarm_pressure_pre_low", "alarm_pressure_pre_high"),
    "pressure_post_mmhg": ("alarm_pressure_post_low", "alarm_pressure_post_high"),
    "sat_pre_pct": ("alarm_sat_pre_low", "alarm_sat_pre_high"),
    "temp_post_c": ("alarm_temp_post_low", "alarm_temp_post_high"),
}

ALARM_TEXT = "Alarm"
BUBBLE_ALARM_CODES = ["A", "E"]
ALARM_CATEGORY_LABELS = {
    "overall": "General Alarm",
    "bubble": "Bubble / Air Alarm",
    "technical": "Technical Fault",
}
ALARM_LOG_LABELS = {"overall": "General", "bubble": "Bubble / Air", "technical": "Technical"}

# Wording of the model's features and of its explanation, shown as output.
RATIO_LABEL = "Pressure/Flow instability index"
FEATURE_WORDING = {
    "rolling_mean_": "Avg. {} (recent trend)",
    "rolling_std_": "{} — instability",
    "delta_": "{} — rate of change",
}
EXPLAIN_NONE = "No feature importance available. Train the model first."
EXPLAIN_FIRST = "The model identifies the following as the strongest early warning signals:"
EXPLAIN_LAST = "Higher values in these parameters are associated with increased alarm risk."

MAX_TRAINING_SESSIONS = 5
HISTOGRAM_BINS = 30
ROLLING_ROWS = 10
ALARM_HORIZON = 5
RISK_CUTS = (0.33, 0.66)

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

CANONICAL = list(COLUMN_MAP.values())
UNKNOWN_CASE = "unknown"

MEASUREMENTS_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("row_ordinal", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("case_id", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in MEASUREMENTS],
        *[T.StructField(c, T.DoubleType()) for c in LIMITS],
        T.StructField("alarm_active", T.BooleanType()),
        T.StructField("alarm_bubble", T.StringType()),
        T.StructField("technical_fault", T.DoubleType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

ALARM_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("row_ordinal", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("alarm_type", T.StringType()),
        T.StructField("alarm_value", T.StringType()),
    ]
)

SESSIONS_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("center_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("time_start", T.TimestampNTZType()),
        T.StructField("time_end", T.TimestampNTZType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("uploaded_at", T.TimestampNTZType()),
    ]
)

FILES_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("length", T.LongType()),
    ]
)
