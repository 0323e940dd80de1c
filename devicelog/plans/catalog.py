"""Every report and operator as a named query over the driver tables.

The ``events`` table is read as a device log (``sources/event_log.py``). Queries
on stored data read a store that is filled from it once per session and input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from devicelog.operators import (
    alarms,
    audit,
    clean,
    compare,
    distribution,
    features,
    filters,
    summary,
)
from devicelog.operators.positions import with_global_position
from devicelog.operators.sizes import Sizes
from devicelog.plans import risk
from devicelog.plans.load import load_raw
from devicelog.schema import CANONICAL, LIMITS, MEASUREMENTS, TREND_PARAMETERS
from devicelog.session import shared_folder, use_utc, written
from devicelog.sources import csv_files
from devicelog.sources import store as stores
from devicelog.sources.event_log import device_log, mixed_clock_log
from devicelog.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]

FILTER_START = "2024-01-08 00:00:00"
FILTER_END = "2024-01-21 12:00:00"


@dataclass
class Loaded:
    store: stores.Store
    typed: DataFrame
    sizes: Sizes


_loaded: dict[tuple, Loaded] = {}
_models: dict[tuple, risk.RiskModel] = {}


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    return clean.map_columns(device_log(spark, folder))


def session_files(raw: DataFrame) -> DataFrame:
    """A file name for each session."""
    return raw.select("session_id").distinct().selectExpr(
        "session_id", "concat('device_', lpad(CAST(session_id AS STRING), 6, '0'), '.csv') AS filename"
    )


def _input(spark: SparkSession, folder: str) -> tuple:
    """Names one state of the input: a changed file gives another name."""
    found = (
        spark.read.format("binaryFile")
        .load(f"{folder}/events.parquet")
        .agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"))
        .first()
    )
    return (spark.sparkContext.applicationId, folder, *found)


def loaded(spark: SparkSession, folder: str) -> Loaded:
    """The store filled from the device log, the typed rows behind it, and its sizes."""
    use_utc(spark)
    key = _input(spark, folder)
    if key not in _loaded:
        raw = raw_log(spark, folder)
        store = stores.Store(spark, shared_folder(spark))
        typed, sizes = load_raw(
            raw, session_files(raw), store, 0, with_audit=False, uploaded_at=F.col("time_end")
        )
        _loaded[key] = Loaded(store, typed, store.sizes())
    return _loaded[key]


def forget() -> None:
    """Fill the store and fit the models anew at the next query."""
    _loaded.clear()
    _models.clear()


def _from_log(query: Callable[[DataFrame, Sizes], DataFrame]) -> Query:
    """A query on the stored measurements of all sessions."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = loaded(spark, folder)
        return query(data.store.measurements(), data.sizes)

    return run


def _from_store(query: Callable[[stores.Store], DataFrame]) -> Query:
    return lambda spark, folder: query(loaded(spark, folder).store)


def _from_typed(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: query(loaded(spark, folder).typed)


def _from_raw(query: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(raw_log(use_utc(spark), folder))

    return run


def to_digits(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show.

    The small shift keeps values that lie halfway between two results, up to the
    noise of summation, on one side.
    """
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.selectExpr(
        *[f"round(`{c}` + 1e-9D, {digits}) AS `{c}`" if c in doubles else f"`{c}`" for c in df.columns]
    )


# --- scans, sources, sinks ---------------------------------------------------


def _exported(spark: SparkSession, folder: str) -> str:
    """The device log as CSV files of two layouts in the shared folder, one file for each session.

    Every seventh record has a note with a line break, a comma and quotes in its cell.
    """
    use_utc(spark)
    log = device_log(spark, folder).selectExpr(
        "* EXCEPT (session_id, row_ordinal)",
        "CAST(session_id AS STRING) AS `Session`",
        "CAST(row_ordinal AS STRING) AS `Record`",
        "IF(row_ordinal % 7 = 0, concat('first ', row_ordinal, ',\n\nthen \"', session_id, '\"'), '') AS `Note`",
    )
    target = shared_folder(spark)
    turned = list(reversed(log.columns))
    for parity, columns in ((0, log.columns), (1, turned)):
        rows = log.where(f"CAST(`Session` AS BIGINT) % 2 = {parity}").repartition("Session")
        # Partitioning by session gives each one its own file, whatever the number of cores.
        rows = rows.select(F.col("Session").alias("s"), *[F.col(f"`{c}`").alias(f" {c} ") for c in columns])
        rows.write.partitionBy("s").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(f"{target}/{parity}")
    return target


def ingest_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Write the log as CSV files with different headers and read them all back."""
    records = csv_files.read_records(spark, _exported(spark, folder))
    raw = csv_files.read_logs(records, written(csv_files.read_headers(records)))
    return raw.selectExpr(
        "CAST(extra['Session'] AS BIGINT) AS session_id",
        "CAST(extra['Record'] AS BIGINT) AS record",
        "extra['Note'] AS note",
        *CANONICAL,
    )


def load_report(spark: SparkSession, folder: str) -> DataFrame:
    raw, files, headers, records = csv_files.read_sessions(spark, _exported(spark, folder))
    counts = csv_files.row_counts(raw, files)
    report = csv_files.load_report(files.drop("session_id"), headers, counts, records.broken)
    return report.groupBy("code", "message").agg(F.count(F.lit(1)).alias("files"))


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all sessions against a store that knows those with an odd id."""
    raw = raw_log(spark, folder)
    files = session_files(raw).selectExpr(
        "filename", "concat('in/', filename) AS source_file", "1L AS length", "session_id"
    )
    known = loaded(spark, folder).store.sessions().where("session_id % 2 = 1")
    return csv_files.new_files(files, known).select("filename", "source_file")


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Stream the exported CSV files into a store; the sessions it then holds."""
    target = _exported(spark, folder)
    out = shared_folder(spark)
    stream_ingest(spark, target, f"{out}/store", f"{out}/checkpoint", identity="path").awaitTermination()
    return stores.Store(spark, f"{out}/store").sessions().select("case_id", "row_count", "time_start", "time_end")


def audit_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Audit texts written per session and read back as rows."""
    return audit.read_audit(written(audit.audit_json(loaded(spark, folder).typed)))


def alarm_sessions(store: stores.Store) -> DataFrame:
    return store.alarm_events().select("session_id").distinct()


# --- model -------------------------------------------------------------------


def trained(spark: SparkSession, folder: str, model_type: str = risk.FOREST) -> risk.RiskModel:
    """A model fitted on all sessions, once per session and input."""
    key = (*_input(spark, folder), model_type)
    if key not in _models:
        data = loaded(spark, folder)
        _models[key] = risk.RiskModel(model_type).train(
            data.store.measurements(), data.sizes, max_sessions=None
        )
    return _models[key]


def _metrics(model_type: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        metrics = trained(spark, folder, model_type).metrics
        # The AUC is NULL where the test rows have one class.
        return spark.createDataFrame(
            [tuple(metrics.values())],
            "auc DOUBLE, train_samples LONG, test_samples LONG, alarm_rate_train DOUBLE, alarm_rate_test DOUBLE",
        )

    return run


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(
        trained(spark, folder).importance,
        "feature STRING, label STRING, importance DOUBLE, importance_pct DOUBLE",
    )


def risk_explain(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(trained(spark, folder).explain(),)], "text STRING")


def risk_predict(spark: SparkSession, folder: str) -> DataFrame:
    data = loaded(spark, folder)
    return trained(spark, folder).predict(data.store.measurements(), data.sizes)


def scored_events(log: DataFrame) -> DataFrame:
    """A fixed score and outcome per sample, for the figures that need no model."""
    return log.selectExpr(
        "session_id",
        "row_ordinal",
        "CAST((row_ordinal * 7919) % 1009 AS DOUBLE) / 1008 AS risk_score",
        "CAST(coalesce(alarm_active, false) AS INT) AS label",
    ).withColumn("prediction", F.expr("CAST(risk_score >= 0.5 AS INT)"))


def auc(spark: SparkSession, folder: str) -> DataFrame:
    value = risk.auc(scored_events(loaded(spark, folder).store.measurements()), "risk_score", "label")
    return spark.createDataFrame([(value,)], "auc DOUBLE")


def _scored_levels(log: DataFrame) -> DataFrame:
    return scored_events(log).withColumn("risk_level", risk.risk_level(F.col("risk_score")))


def _split(log: DataFrame, sizes: Sizes) -> DataFrame:
    placed = with_global_position(log.select(*features.INPUTS), sizes)
    return features.train_test_split(features.alarm_target(placed, sizes), sizes)


SAMPLE = filters.SAMPLE


def _in_range(df: DataFrame) -> DataFrame:
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (FILTER_START, FILTER_END))
    return filters.in_time_range(df, start, end)


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "ingest_raw": ingest_raw,
        "map_columns": _from_raw(lambda raw: raw.drop("extra")),
        "load_report": load_report,
        "new_files": new_files,
        "build_sessions": _from_store(
            lambda s: s.sessions().select(
                "session_id", "case_id", "filename", "row_count", "time_start", "time_end"
            )
        ),
        "store_measurements": _from_store(
            lambda s: s.measurements().drop("extra", *LIMITS)
        ),
        "alarm_events": _from_log(lambda log, sizes: alarms.alarm_events(log)),
        "list_sessions": _from_store(
            lambda s: s.sessions().select("session_id", "case_id", "filename", "uploaded_at")
        ),
        "session_measurements": _from_store(
            lambda s: stores.by_time(s.measurements()).select(*SAMPLE, "case_id", *MEASUREMENTS)
        ),
        "multi_session_measurements": _from_store(
            lambda s: stores.by_session_and_time(s.measurements(alarm_sessions(s))).select(
                *SAMPLE, *MEASUREMENTS, "alarm_active"
            )
        ),
        "session_alarms": _from_store(lambda s: stores.by_time(s.alarm_events())),
        "multi_session_alarms": _from_store(
            lambda s: stores.by_session_and_time(
                s.alarm_events(s.measurements().where("technical_fault IS NOT NULL").select("session_id"))
            )
        ),
        "audit_json_roundtrip": audit_roundtrip,
        "stream_ingest": streamed,
        # cleaning
        "clean_log": _from_raw(lambda raw: clean.clean(raw).drop("extra")),
        "parse_timestamps": _from_raw(
            lambda raw: clean.typed(raw).select(*SAMPLE, "ts_format")
        ),
        "elect_ts_format": _from_raw(clean.elect_formats),
        "ts_fallback": lambda spark, folder: clean.typed(
            clean.map_columns(mixed_clock_log(use_utc(spark), folder))
        ).select(*SAMPLE),
        "clean_alarm_limits": _from_typed(lambda t: t.select("session_id", "row_ordinal", *LIMITS)),
        "dedup_rows": _from_typed(lambda t: clean.copies(t).select("session_id", "row_ordinal", "copies")),
        # audit
        "audit_timestamp": _from_typed(audit.timestamp_audit),
        "audit_sentinels": _from_typed(audit.sentinel_audit),
        "audit_measurements": _from_typed(audit.measurement_audit),
        "audit_status_flags": _from_typed(audit.flag_audit),
        "audit_case_ids": _from_typed(lambda t: audit.case_audit(t).drop("defaulted")),
        "audit_dedup": _from_typed(audit.dedup_audit),
        "audit_final_shape": _from_typed(
            lambda t: audit.shape_audit(t).select("session_id", "rows", "cols")
        ),
        "audit_table": _from_typed(audit.audit_table),
        "audit_missing_readings": _from_typed(audit.missing_readings),
        # filters and views
        "filter_time_range": _from_log(
            lambda log, sizes: _in_range(log).select(*SAMPLE, *MEASUREMENTS)
        ),
        "filter_alarm_time_range": _from_store(
            lambda s: _in_range(s.alarm_events())
        ),
        "filter_alarm_only": _from_log(
            lambda log, sizes: filters.alarms_only(log).select(*SAMPLE, *MEASUREMENTS)
        ),
        "time_bounds": _from_log(lambda log, sizes: filters.time_bounds(log)),
        "available_parameters": _from_log(lambda log, sizes: filters.available_parameters(log)),
        "parameter_dim": _from_log(
            lambda log, sizes: filters.labelled(filters.available_parameters(log)).drop("readings")
        ),
        "trend_series": _from_log(lambda log, sizes: filters.trend_series(log, TREND_PARAMETERS)),
        "alarm_overlay": _from_log(lambda log, sizes: filters.alarm_overlay(log, TREND_PARAMETERS)),
        "alarm_log": _from_store(lambda s: filters.alarm_log(s.alarm_events())),
        # joins
        "label_cases": lambda spark, folder: summary.with_case(
            loaded(spark, folder).store.measurements().select(*SAMPLE),
            loaded(spark, folder).store.sessions(),
            loaded(spark, folder).sizes,
        ),
        "session_alarm_join": lambda spark, folder: compare.alarms_per_file(
            loaded(spark, folder).store.alarm_events(),
            loaded(spark, folder).store.sessions(),
            loaded(spark, folder).sizes,
        ),
        # summaries
        "session_summary": _from_log(
            lambda log, sizes: to_digits(summary.session_summary(log, display=False))
        ),
        "session_cases": _from_log(lambda log, sizes: summary.session_cases(log)),
        "parameter_stats": _from_log(lambda log, sizes: to_digits(summary.parameter_stats(log))),
        "alarm_kpis": _from_log(lambda log, sizes: to_digits(alarms.alarm_kpis(log))),
        "alarm_type_counts": _from_store(lambda s: alarms.alarm_type_counts(s.alarm_events())),
        "compare_summary": lambda spark, folder: to_digits(
            summary.compared(
                loaded(spark, folder).store.measurements(),
                loaded(spark, folder).store.sessions(),
                loaded(spark, folder).sizes,
                display=False,
            )
        ),
        "alarm_rate_per_case": lambda spark, folder: summary.with_case(
            summary.alarm_rates(loaded(spark, folder).store.measurements()),
            loaded(spark, folder).store.sessions(),
            loaded(spark, folder).sizes,
        ).select("session_id", "case", "alarm_rate_pct"),
        "cohort_alarm_frequency": lambda spark, folder: summary.with_case(
            summary.alarm_rates(loaded(spark, folder).store.measurements()),
            loaded(spark, folder).store.sessions(),
            loaded(spark, folder).sizes,
        ),
        "case_header": _from_log(lambda log, sizes: to_digits(summary.case_header(log))),
        "case_positions": _from_store(lambda s: compare.case_positions(s.sessions())),
        # figures as shown
        "session_summary_display": _from_log(
            lambda log, sizes: summary.session_summary(log).drop("alarm_rate_pct")
        ),
        "compare_summary_display": lambda spark, folder: summary.compared(
            loaded(spark, folder).store.measurements(),
            loaded(spark, folder).store.sessions(),
            loaded(spark, folder).sizes,
        ).drop("alarm_rate_pct"),
        "cohort_stats_display": _from_log(lambda log, sizes: distribution.cohort_stats(log, sizes)),
        # distributions
        "cohort_stats": _from_log(
            lambda log, sizes: to_digits(distribution.cohort_stats(log, sizes, display=False))
        ),
        "box_stats": _from_log(lambda log, sizes: to_digits(distribution.box_stats(log, sizes))),
        "box_outliers": _from_log(distribution.box_outliers),
        "histogram": _from_log(lambda log, sizes: to_digits(distribution.histogram(log, sizes))),
        "correlation_matrix": _from_log(
            lambda log, sizes: to_digits(distribution.correlations(log))
        ),
        "alarm_limit_bands": _from_log(distribution.limit_bands),
        # comparison
        "compare_overlay": _from_log(
            lambda log, sizes: to_digits(
                compare.progress(log, sizes).select(
                    *SAMPLE, "elapsed_minutes", "progress_pct", "flow_rate_lpm"
                )
            )
        ),
        "compare_parameters": _from_log(lambda log, sizes: compare.compare_parameters(log)),
        "default_selection": _from_store(lambda s: compare.default_selection(s.sessions())),
        # features
        "rolling_features": _from_log(
            lambda log, sizes: to_digits(
                features.features(log.select(*features.INPUTS), sizes).select(
                    "session_id", "row_ordinal", *features.FEATURES
                )
            )
        ),
        "pressure_flow_ratio": _from_log(
            lambda log, sizes: to_digits(
                log.select(
                    "session_id", "row_ordinal", features.pressure_flow_ratio().alias(features.RATIO)
                )
            )
        ),
        "alarm_target": _from_log(
            lambda log, sizes: features.alarm_target(log.select(*features.INPUTS), sizes).select(
                "session_id", "row_ordinal", "alarm_future"
            )
        ),
        "alarm_target_next": _from_log(
            lambda log, sizes: features.alarm_target(log.select(*features.INPUTS), sizes, coded=False).select(
                "session_id", "row_ordinal", "alarm_future"
            )
        ),
        "train_test_split": _from_log(
            lambda log, sizes: features.train_test_split(log.select(*features.INPUTS), sizes).select(
                "session_id", "row_ordinal", "position", "global_position", "split"
            )
        ),
        # risk model
        "split_stats": _from_log(lambda log, sizes: to_digits(risk.split_stats(_split(log, sizes)))),
        "class_weights": _from_log(
            lambda log, sizes: to_digits(
                risk.class_weights(_split(log, sizes).where("split = 'train'"))
            )
        ),
        "auc": lambda spark, folder: to_digits(auc(spark, folder)),
        "classification_report": _from_log(
            lambda log, sizes: to_digits(
                risk.classification_report(scored_events(log), "label", "prediction")
            )
        ),
        "risk_levels": _from_log(
            lambda log, sizes: to_digits(
                _scored_levels(log).select("session_id", "row_ordinal", "risk_score", "risk_level")
            )
        ),
        "risk_level_kpis": _from_log(lambda log, sizes: to_digits(risk.risk_kpis(_scored_levels(log)))),
        "risk_train_metrics": _metrics(risk.FOREST),
        "risk_train_lr": _metrics(risk.LOGISTIC),
        "risk_report": lambda spark, folder: trained(spark, folder).report,
        "feature_importance": feature_importance,
        "risk_explain": risk_explain,
        "risk_predict": risk_predict,
        "risk_kpis": lambda spark, folder: risk.risk_kpis(risk_predict(spark, folder)),
    }


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of every session straight from the raw log."""
    log = clean.clean(raw_log(use_utc(spark), folder))
    return to_digits(summary.session_summary(log, display=False))


