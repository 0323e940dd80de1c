from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from helpers import column, log_frame
from pyspark.sql import functions as F

from devicelog.operators import alarms, compare, distribution, features, filters, summary
from devicelog.operators.sizes import measured
from devicelog.sources import store as stores

T0 = datetime(2026, 1, 31, 15, 0, 0)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def timed(rows: list[dict]) -> list[dict]:
    return [{"timestamp": at(i), **row} for i, row in enumerate(rows)]


def test_summary_of_a_session(spark):
    log = log_frame(
        spark,
        timed([{"flow_rate_lpm": 1.0}, {"flow_rate_lpm": 2.005, "alarm_active": True}, {"flow_rate_lpm": None}]),
    )
    row = summary.session_summary(log).first()
    assert (row.total_records, row.alarm_events, row.duration_minutes) == (3, 1, 2.0)
    assert (row.flow_rate_lpm_mean, row.flow_rate_lpm_min) == (1.5, 1.0)
    assert row.pump_speed_rpm_mean is None
    assert row.alarm_rate_pct == pytest.approx(100 / 3)


def test_display_rounds_half_to_even(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": 0.125}]))
    assert summary.session_summary(log).first().flow_rate_lpm_mean == 0.12


def test_single_row_session(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": 1.0}]))
    stats = summary.parameter_stats(log).first()
    assert (stats.std_dev, stats.coverage_pct) == (None, 100.0)
    row = compare.progress(log).first()
    assert (row.elapsed_minutes, row.progress_pct) == (0.0, None)
    assert summary.session_summary(log).first().duration_minutes == 0.0
    assert summary.case_header(log).first().whole_minutes == 0


def test_session_without_times(spark):
    log = log_frame(spark, [{"flow_rate_lpm": 1.0}])
    assert summary.session_summary(log).first().duration_minutes is None
    assert compare.progress(log).count() == 0


def test_one_row_can_give_two_alarm_events(spark):
    log = log_frame(
        spark,
        timed([{"alarm_active": True, "alarm_bubble": "A"}, {"alarm_bubble": "D"}, {"technical_fault": 4.0}]),
    )
    found = alarms.alarm_events(log).select("alarm_type", "alarm_value").collect()
    assert sorted(map(tuple, found)) == [("bubble", "A"), ("overall", "Alarm")]
    assert alarms.alarm_events(log, include_technical=True).count() == 3
    single = log.where("row_ordinal = 0")
    kpis = alarms.alarm_kpis(single).first()
    assert (kpis.alarm_events, kpis.coverage_pct, kpis.remainder_pct) == (2, 200.0, -100.0)
    assert (kpis.row_coverage_pct, kpis.alarm_categories) == (100.0, 2)


def test_alarm_labels(spark):
    log = log_frame(spark, timed([{"alarm_active": True}, {"alarm_bubble": "E"}]))
    events = alarms.alarm_events(log)
    assert {r.alarm_category for r in filters.alarm_log(events).collect()} == {"General", "Bubble / Air"}
    counts = {r.alarm_category: r.events for r in alarms.alarm_type_counts(events).collect()}
    assert counts == {"General Alarm": 1, "Bubble / Air Alarm": 1}


def test_time_filter_keeps_both_ends_and_drops_missing_times(spark):
    log = log_frame(spark, [{"timestamp": t} for t in (at(0), at(1), at(2), None)])
    found = filters.in_time_range(log, F.lit(at(0)).cast("timestamp_ntz"), F.lit(at(1)).cast("timestamp_ntz"))
    assert column(found, "row_ordinal") == [0, 1]


def test_target_as_coded_and_as_documented(spark):
    log = log_frame(spark, timed([{"alarm_active": i == 7} for i in range(12)]))
    coded = features.alarm_target(log, horizon=3)
    assert column(coded, "alarm_future") == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    following = features.alarm_target(log, horizon=3, coded=False)
    assert column(following, "alarm_future") == [0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0]


def test_rolling_features(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": v} for v in (1.0, None, 3.0, None, None, None, 6.0)]))
    found = features.features(log, rows=3)
    assert column(found, "rolling_mean_flow_rate_lpm") == [1, 1, 2, 3, 3, None, 6]
    assert column(found, "rolling_std_flow_rate_lpm") == pytest.approx([0, 0, 2**0.5, 0, 0, 0, 0])
    assert column(found, "delta_flow_rate_lpm") == [0] * 7
    # A parameter without any reading has no features.
    assert column(found, "rolling_std_pump_speed_rpm") == [None] * 7


def test_features_stay_inside_a_session(spark):
    rows = timed([{"session_id": 1 + i % 2, "flow_rate_lpm": float(i)} for i in range(8)])
    log = log_frame(spark, rows)
    both = features.features(log).where("session_id = 2")
    alone = features.features(log.where("session_id = 2"))
    assert column(both, "rolling_mean_flow_rate_lpm") == column(alone, "rolling_mean_flow_rate_lpm")


def test_pressure_flow_ratio(spark):
    rows = [(5.0, 0.0), (None, 2.0), (500.0, 1.0), (-500.0, 1.0), (6.0, 4.0), (5.0, None)]
    log = log_frame(spark, timed([{"pressure_delta_mmhg": p, "flow_rate_lpm": f} for p, f in rows]))
    assert column(features.features(log), features.RATIO) == [0, 0, 50, -50, 1.5, 0]


def test_split_is_over_all_sessions_in_order(spark):
    rows = timed([{"session_id": 1 + i // 8} for i in range(11)])
    found = features.train_test_split(log_frame(spark, rows))
    assert column(found, "split", "global_position") == ["train"] * 8 + ["test"] * 3
    each = features.train_test_split(log_frame(spark, rows), by_session=True)
    assert column(each, "split", "global_position") == ["train"] * 6 + ["test"] * 2 + ["train"] * 2 + ["test"]


def test_histogram_counts_every_reading(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": float(i % 61), "sat_pre_pct": 5.0} for i in range(200)]))
    bins = distribution.histogram(log).collect()
    flow = [r for r in bins if r.parameter == "flow_rate_lpm"]
    assert sum(r.readings for r in flow) == 200
    assert min(r.bin for r in flow) == 1 and max(r.bin for r in flow) == 30
    same = [r for r in bins if r.parameter == "sat_pre_pct"]
    assert [(r.bin, r.readings) for r in same] == [(1, 200)]


def test_correlations(spark):
    rows = [
        {"flow_rate_lpm": float(i), "pump_speed_rpm": 2.0 * i, "sat_pre_pct": -1.0 * i, "temp_post_c": 37.0}
        for i in range(5)
    ]
    found = {
        (r.parameter_a, r.parameter_b): r.correlation
        for r in distribution.correlations(log_frame(spark, timed(rows))).collect()
    }
    assert found[("flow_rate_lpm", "pump_speed_rpm")] == pytest.approx(1)
    assert found[("sat_pre_pct", "flow_rate_lpm")] == pytest.approx(-1)
    assert len(found) == 9
    assert not any("temp_post_c" in pair for pair in found)


def test_one_varying_parameter_has_no_matrix(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": float(i), "temp_post_c": 37.0} for i in range(3)]))
    assert distribution.correlations(log).count() == 0


def test_box(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": v} for v in (1.0, 2.0, 3.0, 4.0, 100.0)]))
    row = distribution.box_stats(log).first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 4.0, 1)
    assert column(distribution.box_outliers(log), "value") == [100.0]


def test_limit_bands(spark):
    rows = [{"alarm_flow_low_lpm": v, "alarm_sat_post_low": 1.0} for v in (1.0, 2.0, 4.0, None)]
    found = distribution.limit_bands(log_frame(spark, timed(rows))).collect()
    assert [(r.parameter, r.side, r.limit_value) for r in found] == [("flow_rate_lpm", "low", 2.0)]


def test_progress(spark):
    log = log_frame(spark, [{"timestamp": t} for t in (at(0), at(1), at(4), None)])
    assert column(compare.progress(log), "progress_pct") == [0.0, 25.0, 100.0]


def sessions_frame(spark, times):
    rows = [(i, f"C{i}", f"f{i}.csv", t) for i, t in enumerate(times)]
    return spark.createDataFrame(
        rows, "session_id LONG, case_id STRING, filename STRING, uploaded_at TIMESTAMP_NTZ"
    )


def test_positions_and_default_choice(spark):
    sessions = sessions_frame(spark, [at(0), at(5), at(5), at(2)])
    places = {r.session_id: (r.place, r.cases) for r in compare.case_positions(sessions).collect()}
    assert places == {2: (1, 4), 1: (2, 4), 3: (3, 4), 0: (4, 4)}
    assert [r.session_id for r in compare.default_selection(sessions).collect()] == [2, 1]
    assert compare.default_selection(sessions, 6).count() == 4
    with pytest.raises(ValueError):
        compare.default_selection(sessions, 0)


def test_session_takes_the_case_of_its_earliest_row(spark):
    log = log_frame(
        spark,
        [
            {"timestamp": None, "case_id": "late"},
            {"timestamp": at(3), "case_id": "B"},
            {"timestamp": at(1), "case_id": "A"},
        ],
    )
    files = spark.createDataFrame([(1, "f.csv")], "session_id LONG, filename STRING")
    row = stores.build_sessions(log, files, measured(log)).first()
    assert (row.case_id, row.row_count, row.time_start, row.time_end) == ("A", 3, at(1), at(3))
    assert row.device_type == "unknown"


def test_labels(spark):
    log = log_frame(spark, timed([{"flow_rate_lpm": 1.0}]))
    row = filters.labelled(filters.available_parameters(log)).first()
    assert (row.label, row.axis_label) == ("Flow Rate (L/min)", "Blood Flow (L/min)")
