"""Sessions too long for one task give the same results as short ones."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from helpers import log_frame, raw_frame, rows_of
from pyspark.sql import functions as F

from devicelog.operators import audit, compare, distribution, features, positions, quantiles
from devicelog.operators.clean import clean, typed
from devicelog.operators.sizes import measured
from devicelog.plans.catalog import raw_log
from devicelog.session import use_utc, written


@pytest.fixture(scope="module")
def log(spark):
    """The device log with a third of all rows moved into one session."""
    use_utc(spark)
    found = clean(raw_log(spark, "/root/testdata/sf0.001"))
    one = F.when(F.col("row_ordinal") % 3 == 0, F.lit(-1)).otherwise(F.col("session_id"))
    return written(found.withColumn("session_id", one.cast("long")))


@pytest.fixture(scope="module")
def whole(log):
    return measured(log)


@pytest.fixture(scope="module")
def split(whole):
    """Limits so low that every path for large data is taken."""
    return whole.with_limits(rows_per_task=25, broadcast_bytes=0)


def test_a_third_is_one_session(whole, split):
    assert whole.longest >= whole.rows / 3 - 1
    assert whole.fits_tasks
    assert not split.fits_tasks


@pytest.mark.parametrize("coded", [True, False])
def test_features_and_target(log, whole, split, coded):
    def result(sizes):
        found = features.features(log, sizes, horizon=5, coded=coded)
        return rows_of(found.select("session_id", "row_ordinal", "alarm_future", *features.FEATURES))

    assert result(whole) == result(split)


def test_target_alone_with_a_long_horizon(log, whole, split):
    def result(sizes):
        found = features.alarm_target(log, sizes, horizon=20)
        return rows_of(found.select("session_id", "row_ordinal", "alarm_future"))

    assert result(whole) == result(split)


@pytest.mark.parametrize("by_session", [True, False])
def test_split_and_positions(log, whole, split, by_session):
    def result(sizes):
        found = features.train_test_split(log, sizes, by_session=by_session)
        return rows_of(
            found.select("session_id", "row_ordinal", "position", "global_position", "split")
        )

    assert result(whole) == result(split)


def test_distributions(log, whole, split):
    for report in (
        distribution.box_stats,
        distribution.box_outliers,
        distribution.cohort_stats,
        distribution.limit_bands,
        distribution.histogram,
        compare.progress,
    ):
        assert rows_of(report(log, whole).drop("extra")) == rows_of(report(log, split).drop("extra"))


def test_numbered_rows(spark):
    df = spark.range(0, 100, numPartitions=7).select(((F.col("id") * 37) % 100).alias("v"))
    for limit in (1000, 9):
        found = positions.numbered(df, [F.col("v").desc()], 100, rows_per_task=limit).collect()
        assert sorted((r.v, r.number) for r in found) == [(v, 99 - v) for v in range(100)]


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 1.0, 1.0, 1.0],
        [0.0, -0.0, 1.0],
        [float(v) for v in range(101)],
        [1e-300, 1.0, 1e300, -1e300, 1e8],
        [random.Random(7).lognormvariate(0, 12) for _ in range(400)],
        [0.1] * 300 + [random.Random(3).gauss(0, 1) for _ in range(150)],
        [1e308, -1e308, 3.0, 4.0],
        [1.0] * 500 + [2.0] * 3,
        [float(v % 40) for v in range(2000)] + [1e9],
    ],
)
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_sketched_quantiles_match_numpy(spark, values, accuracy):
    df = spark.createDataFrame([("p", v) for v in values], "parameter STRING, value DOUBLE")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.9, "f": 1.0}
    row = quantiles._by_sketch(df, ["parameter"], wanted, accuracy).first()
    expected = np.quantile(np.array(values) / 4, list(wanted.values())) * 4
    assert row.n == len(values)
    assert [row[name] for name in wanted] == pytest.approx(list(expected), rel=1e-9, abs=1e-300)


@pytest.mark.parametrize(
    "values",
    [
        [float("inf"), float("-inf"), 1.0, 2.0, 3.0],
        [float("inf"), float("-inf")],
        [1.7976931348623157e308, float("inf"), -1.7976931348623157e308],
        [float("inf")] * 5 + [0.0],
    ],
)
def test_infinite_values_have_the_same_quantiles_both_ways(spark, values):
    df = spark.createDataFrame([("p", v) for v in values], "parameter STRING, value DOUBLE")
    wanted = {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 1.0}
    one, other = (f(df, ["parameter"], wanted).first() for f in (quantiles._builtin, quantiles._by_sketch))
    assert repr(one) == repr(other)


def test_infinite_values_leave_the_histogram_finite(spark):
    log = log_frame(spark, [{"flow_rate_lpm": v} for v in (1.0, 2.0, 3.0, float("inf"), float("-inf"))])
    rows = distribution.histogram(log, bins=2).orderBy("bin").collect()
    assert [(r.bin, r.bin_start, r.bin_end, r.readings) for r in rows] == [(1, 1.0, 2.0, 1), (2, 2.0, 3.0, 2)]


def test_quantiles_of_long_groups_take_two_scans(spark):
    """Whatever the values, skewed ones too: a sketch and a count."""
    rng = random.Random(5)
    rows = [("a", rng.lognormvariate(0, 9)) for _ in range(4000)] + [("b", 1.0)] * 3000 + [("c", float(v)) for v in range(9)]
    df = spark.createDataFrame(rows, "parameter STRING, value DOUBLE").repartition(5)
    group = "two-scans"
    spark.sparkContext.setJobGroup(group, "quantiles")
    try:
        found = quantiles._by_sketch(df, ["parameter"], {"q1": 0.25, "q3": 0.75}, 100)
        got = {r.parameter: (r.n, r.q1, r.q3) for r in found.collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for name in "abc":
        own = [v for p, v in rows if p == name]
        assert got[name] == (len(own), pytest.approx(np.quantile(own, 0.25)), pytest.approx(np.quantile(own, 0.75)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Relation [") == 1


def test_correlation_of_a_shifted_series(spark):
    rng = random.Random(9)
    rows, plain = [], []
    for k in range(400):
        x = rng.gauss(0, 1)
        y = 0.6 * x + rng.gauss(0, 1) if k % 3 else None
        plain.append((x, y))
        rows.append({"flow_rate_lpm": 1e6 + x, "pump_speed_rpm": None if y is None else 1e6 + y})
    log = log_frame(spark, rows)
    found = distribution.correlations(log)
    got = {(r.parameter_a, r.parameter_b): r.correlation for r in found.collect()}
    # The shift itself rounds the values, so the expectation is made from the same ones.
    both = [(1e6 + x - 1e6, 1e6 + y - 1e6) for x, y in plain if y is not None]
    assert got["flow_rate_lpm", "pump_speed_rpm"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)
    assert got["pump_speed_rpm", "flow_rate_lpm"] == got["flow_rate_lpm", "pump_speed_rpm"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Aggregate [session_id")


def test_the_audit_scans_the_log_three_times(spark, folder):
    raw = raw_frame(
        spark,
        {
            "Timestamp": ["2026-01-01 00:00:00", "", "x"],
            "Case Number": ["1", "2", "1"],
            "Flow rate L/min": ["--", "1", "Lo"],
            "Bubble alarm status": ["A", "--", "A"],
        },
    )
    typed(raw).write.parquet(f"{folder}/typed")
    rows = spark.read.parquet(f"{folder}/typed")
    for report in (audit.audit_table(rows), audit.audit_json(rows)):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 3
    got = {(r.step, r.parameter, r.metric): r.value for r in audit.audit_table(rows).collect()}
    assert got["measurements", "flow_rate_lpm", "sentinel_count"] == "2"
    assert got["status_flags", "A", "alarm_bubble_distribution"] == "2"
    assert (got["case_id", "1", "rows"], got["final_shape", "", "cols"]) == ("2", "4")
    text = json.loads(audit.audit_json(rows).first().provenance)
    assert text["measurements"]["flow_rate_lpm"] == {"sentinel_count": 2, "sentinels_found": {"--": 1, "Lo": 1}, "total_nan_after": 2}
    assert text["status_flags"]["alarm_bubble_distribution"] == {"A": 2, "OK": 1}
    assert text["case_id"]["unique_cases"] == ["1", "2"] and "alarm_limits" not in text


def test_rows_without_a_time_in_a_long_session(spark):
    log = log_frame(
        spark, [{"timestamp": None, "flow_rate_lpm": float(i), "alarm_active": i % 9 == 0} for i in range(60)]
    )
    whole = measured(log)
    low = whole.with_limits(rows_per_task=12, broadcast_bytes=0)

    def result(sizes):
        return rows_of(features.features(log, sizes, horizon=3).drop("extra"))

    assert result(whole) == result(low)
