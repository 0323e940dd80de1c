from __future__ import annotations

from datetime import datetime

import pytest
from helpers import column, raw_frame, rows_of

from devicelog.operators import audit, clean
from devicelog.operators.sizes import measured


def test_numbers_and_device_codes(spark):
    cells = ["--", "Lo", "Hi", "A", "D", "E", "", "n/a", "1e3", " 7 ", "1.5d", "2f", "0x1p3", "nan", ".5", "+3"]
    raw = raw_frame(spark, {"Flow rate L/min": cells})
    typed = clean.typed(raw)
    expected = [None] * 8 + [1000.0, 7.0, None, None, None, None, 0.5, 3.0]
    assert column(typed, "flow_rate_lpm") == expected
    found = {r.sentinel: r.n for r in audit.sentinel_audit(typed).collect()}
    assert found == dict.fromkeys(["--", "Lo", "Hi", "A", "D", "E"], 1)
    row = audit.measurement_audit(typed).first()
    assert (row.sentinel_count, row.total_nan_after) == (6, 12)


def test_infinity_is_a_number(spark):
    typed = clean.typed(raw_frame(spark, {"Flow rate L/min": ["inf", "-Infinity"]}))
    assert column(typed, "flow_rate_lpm") == [float("inf"), float("-inf")]


@pytest.mark.parametrize(
    ("cells", "fmt", "expected"),
    [
        (["2026.01.31 15:33:56.553", "2026.1.2 1:2:3.5"], 0, datetime(2026, 1, 2, 1, 2, 3, 500000)),
        (["2026-01-31 15:33:56.553001", "2026-1-2 1:2:3.5"], 1, datetime(2026, 1, 2, 1, 2, 3, 500000)),
        (["2026-01-31 15:33:56", "2026-1-2 1:2:3"], 2, datetime(2026, 1, 2, 1, 2, 3)),
        (["31/01/2026 15:33:56", "2/1/2026 1:2:3"], 3, datetime(2026, 1, 2, 1, 2, 3)),
        (["01/31/2026 15:33:56", "1/2/2026 1:2:3"], 4, datetime(2026, 1, 2, 1, 2, 3)),
        (["20260131153356", "20260102010203"], 5, datetime(2026, 1, 2, 1, 2, 3)),
    ],
)
def test_each_format_is_elected(spark, cells, fmt, expected):
    raw = raw_frame(spark, {"Timestamp": [*cells, ""]})
    typed = clean.typed(raw)
    assert column(typed, "ts_format") == [fmt] * 3
    assert column(typed, "timestamp")[1:] == [expected, None]


def test_ambiguous_days_are_read_day_first(spark):
    typed = clean.typed(raw_frame(spark, {"Timestamp": ["01/02/2026 00:00:00", "03/04/2026 00:00:00"]}))
    assert column(typed, "timestamp")[0] == datetime(2026, 2, 1)


def test_guess_follows_the_first_row(spark):
    cells = ["2026-01-31T15:33:56", "31/01/2026 15:33:56", "junk", ""]
    typed = clean.typed(raw_frame(spark, {"Timestamp": cells}))
    assert column(typed, "timestamp") == [datetime(2026, 1, 31, 15, 33, 56), None, None, None]
    row = audit.timestamp_audit(typed).first()
    assert (row.unparseable_rows, row.blank_rows) == (3, 1)


@pytest.mark.parametrize(
    "cell",
    [
        "2026-01-31T15:33:00Z",
        "2026-01-31T15:33:00.000Z",
        "2026/01/31 15:33:00.0",
        "2026/01/31 15:33",
        "31.01.2026 15:33:00",
        "31.1.2026 15:33",
        "31-01-2026 15:33:00",
        "31-1-2026 15:33",
        "2026-01-31T15:33:00+01:00",
        "2026-01-31 15:33:00 +0100",
        "2026-01-31T15:33Z",
        "31 Jan 2026 15:33",
        "31-Jan-2026 15:33:00",
        "31 January 2026, 15:33:00",
        "Jan 31, 2026 3:33 PM",
        "2026-Jan-31 15:33",
        "1/31/26 3:33 PM",
        "31/1/26 03:33:00 pm",
        "31.01.2026 15:33:00.000",
        "31-01-2026 15:33:00.0",
        "20260131 15:33:00",
        "20260131T15:33:00.5"[:17],
        "2026.1.31 15:33 UTC",
    ],
)
def test_guessed_shapes(spark, cell):
    typed = clean.typed(raw_frame(spark, {"Timestamp": [cell, "junk"]}))
    assert column(typed, "timestamp") == [datetime(2026, 1, 31, 15, 33), None]


def test_guess_prefers_month_first(spark):
    typed = clean.typed(raw_frame(spark, {"Timestamp": ["01/02/2026 00:00:00", "junk"]}))
    assert column(typed, "timestamp") == [datetime(2026, 1, 2), None]


def test_shapes_hold_for_all_rows(spark):
    """Another separator, joint, clock or kind of date is another format."""
    cells = ["5 Mar 2024 10:00", "6 mar 2024 11:00", "7 March 2024 12:00", "6 Mai 2024 11:00", "31 Feb 2024 11:00",
             "5-Mar-2024 10:00", "5 Mar 2024 10:00:01", "5 Mar 2024", "5 Mar 2024 25:00", "5 Mar 24 10:00"]
    typed = clean.typed(raw_frame(spark, {"Timestamp": cells}))
    wanted = [datetime(2024, 3, 5, 10), datetime(2024, 3, 6, 11), datetime(2024, 3, 7, 12)] + [None] * 7
    assert column(typed, "timestamp") == wanted


def test_times_with_zones_keep_the_clock_of_the_first(spark):
    """Across a change of clocks, times go on by the hours that passed."""
    cells = ["2024-10-27T02:30:00+02:00", "2024-10-27T02:30:00+01:00", "2024-10-27T05:00:00-0030", "2024-10-27T02:30:00Z"]
    typed = clean.typed(raw_frame(spark, {"Timestamp": cells}))
    day = (2024, 10, 27)
    assert column(typed, "timestamp") == [datetime(*day, 2, 30), datetime(*day, 3, 30), datetime(*day, 7, 30), None]


def test_halves_of_the_day_and_short_years(spark):
    cells = ["3/5/24 12:05 AM", "3/5/24 12:05 PM", "3/5/24 1:05 am", "3/5/69 1:05 pm", "13/5/24 1:05 pm", "3/5/24 13:05 pm", "3/5/24 0:05 am"]
    typed = clean.typed(raw_frame(spark, {"Timestamp": cells}))
    wanted = [datetime(2024, 3, 5, 0, 5), datetime(2024, 3, 5, 12, 5), datetime(2024, 3, 5, 1, 5), datetime(1969, 3, 5, 13, 5)]
    assert column(typed, "timestamp") == wanted + [None] * 3


def test_fractions_beyond_microseconds_are_cut(spark):
    typed = clean.typed(raw_frame(spark, {"Timestamp": ["5.3.2024 01:02:03.1234569", "6.3.2024 01:02:03.5"]}))
    assert column(typed, "timestamp") == [datetime(2024, 5, 3, 1, 2, 3, 123456), datetime(2024, 6, 3, 1, 2, 3, 500000)]


def test_no_shape_is_looked_up_where_a_device_format_fits(spark):
    raw = raw_frame(spark, {"Timestamp": ["2026-01-31 15:33:00", ""]})
    found = clean.elect_formats(raw)
    found.collect()
    assert column(clean.typed(raw), "ts_format") == [2, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("regexp_extract") < plan.count("regexp_extract") or "LocalTableScan <empty>" in final


def test_no_guess_reads_row_by_row(spark):
    cells = ["junk", "2026-01-31T15:33:56", "2026/01/31 15:33:56"]
    typed = clean.typed(raw_frame(spark, {"Timestamp": cells}))
    assert column(typed, "timestamp") == [None, *[datetime(2026, 1, 31, 15, 33, 56)] * 2]


def test_each_session_elects_its_own_format(spark):
    cells = ["31/01/2026 00:00:00", "01/31/2026 00:00:00"]
    typed = clean.typed(raw_frame(spark, {"Timestamp": cells}, session_ids=[1, 2]))
    assert column(typed, "timestamp") == [datetime(2026, 1, 31)] * 2


def test_missing_columns_differ_from_blank_ones(spark):
    typed = clean.typed(raw_frame(spark, {"Flow rate L/min": ["", "1"]}))
    assert {r.parameter for r in audit.measurement_audit(typed).collect()} == {"flow_rate_lpm"}
    assert audit.timestamp_audit(typed).first().status == "column_missing"
    assert column(typed, "case_id") == ["unknown"] * 2
    assert audit.case_audit(typed).first().defaulted
    assert column(typed, "alarm_active") == [None, None]
    shape = audit.shape_audit(typed).first()
    assert (shape.rows, shape.cols) == (2, 3)


def test_flags(spark):
    raw = raw_frame(
        spark,
        {
            "Overall alarm status": ["Alarm", "alarm", "", " Alarm "],
            "Bubble alarm status": ["--", "A", "", "E"],
            "Technical Fault": ["1", "", "x", "2.5"],
        },
    )
    typed = clean.typed(raw)
    assert column(typed, "alarm_active") == [True, False, False, True]
    assert column(typed, "alarm_bubble") == ["OK", "A", "", "E"]
    assert column(typed, "technical_fault") == [1.0, None, None, 2.5]
    found = {(r.metric, r.code): r.n for r in audit.flag_audit(typed).collect()}
    assert found[("alarm_active_true_count", "")] == 2
    assert found[("technical_fault_non_null", "")] == 2
    assert found[("alarm_bubble_distribution", "")] == 1


def test_duplicates_compare_all_columns(spark):
    raw = raw_frame(
        spark,
        {
            "Flow rate L/min": ["--", "Lo", "1", "1.0", "1"],
            "Note": ["a", "a", "a", "a", "b"],
        },
    )
    log = clean.clean(raw)
    # Device codes and spellings of a number are equal once cleaned.
    assert column(log, "row_ordinal") == [0, 2, 4]
    assert audit.dedup_audit(clean.typed(raw)).first().duplicates_removed == 2


def test_cleaning_twice_the_rows_changes_nothing(spark):
    raw = raw_frame(spark, {"Flow rate L/min": ["1", "2", "--"], "Timestamp": ["2026-01-01 00:00:00"] * 3})
    doubled = raw.unionByName(raw)
    assert rows_of(clean.clean(doubled).drop("extra")) == rows_of(clean.clean(raw).drop("extra"))


def test_shuffled_format_join_gives_the_same(spark):
    raw = raw_frame(
        spark, {"Timestamp": ["31/01/2026 00:00:00", "01/31/2026 00:00:00", ""]}, session_ids=[1, 2, 2]
    )
    shuffled = measured(raw).with_limits(10, broadcast_bytes=0)
    assert rows_of(clean.typed(raw, shuffled).drop("extra", "raw")) == rows_of(
        clean.typed(raw).drop("extra", "raw")
    )


def test_audit_counts_add_up(spark):
    cells = ["--", "Lo", "", "n/a", "3", "4"]
    typed = clean.typed(raw_frame(spark, {"Flow rate L/min": cells}))
    row = audit.measurement_audit(typed).first()
    blanks, unreadable = 1, 1
    assert row.total_nan_after == row.sentinel_count + blanks + unreadable


def test_audit_json_roundtrip(spark):
    raw = raw_frame(spark, {"Flow rate L/min": ["--", "1", "1"], "Case Number": ["7", "7", "7"]})
    texts = audit.audit_json(clean.typed(raw))
    found = {(r.step, r.parameter, r.metric): r.value for r in audit.read_audit(texts).collect()}
    assert found[("measurements", "flow_rate_lpm", "sentinel_count")] == "1"
    assert found[("dedup", "", "duplicates_removed")] == "1"
    assert found[("final_shape", "", "rows")] == "2"
    assert found[("timestamp", "", "status")] == "column_missing"


def test_unreadable_audit_text(spark):
    sessions = spark.createDataFrame([(1, "{not json"), (2, None)], "session_id LONG, provenance STRING")
    rows = audit.read_audit(sessions).collect()
    assert sorted((r.session_id, r.metric) for r in rows) == [(1, "unavailable"), (2, "unavailable")]
