"""Histograms, quartiles, box figures, correlations and limit bands."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelog.operators.filters import readings
from devicelog.operators.quantiles import quantiles
from devicelog.operators.sizes import Sizes, attached, measured
from devicelog.schema import HISTOGRAM_BINS, LIMIT_PAIRS, MEASUREMENTS
from devicelog.session import written

GROUP = ["session_id", "parameter"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _with_figures(log: DataFrame, per_session: DataFrame, names: list[str], sizes: Sizes, ids: list[str]) -> DataFrame:
    """Readings beside figures of their session and parameter.

    ``per_session`` has one row per session with columns such as ``lo_flow_rate_lpm``.
    The join is made on whole samples, before they are taken apart into readings.
    """
    row_bytes = 16 + 8 * len(names) * len(MEASUREMENTS)
    joined = attached(log.select(*ids, *MEASUREMENTS), per_session, sizes, row_bytes=row_bytes)
    entries = ", ".join(
        f"IF({c} IS NULL, NULL, struct('{c}' AS parameter, {c} AS value, "
        + ", ".join(f"{n}_{c} AS {n}" for n in names)
        + "))"
        for c in MEASUREMENTS
    )
    return joined.selectExpr(*ids, f"inline(array_compact(array({entries})))")


def histogram(log: DataFrame, sizes: Sizes | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per bin of each session and parameter, with the mean to mark.

    Bins have equal width between the smallest and largest finite value; equal values
    make one bin, infinite ones none.
    """
    sizes = sizes or measured(log)
    finite = "IF(abs({c}) < double('infinity'), {c}, NULL)"
    kinds = {"lo": f"min({finite})", "hi": f"max({finite})", "mean": "avg({c})"}
    span = log.groupBy("session_id").agg(
        *[F.expr(f"{f.format(c=c)} AS {n}_{c}") for c in MEASUREMENTS for n, f in kinds.items()]
    )
    width = f"((hi - lo) / {bins})"
    step = f"IF(hi > lo, least({bins}, floor((value - lo) / {width}) + 1), 1)"
    return (
        _with_figures(log, span, list(kinds), sizes, ["session_id"])
        .where("abs(value) < double('infinity')")
        .selectExpr(*GROUP, f"CAST({step} AS INT) AS bin", *kinds)
        .groupBy(*GROUP, "bin", *kinds)
        .agg(F.count(F.lit(1)).alias("readings"))
        .selectExpr(
            *GROUP,
            "bin",
            f"lo + (bin - 1) * {width} AS bin_start",
            f"lo + bin * {width} AS bin_end",
            "readings",
            "mean",
        )
    )


def quartiles(log: DataFrame, sizes: Sizes) -> DataFrame:
    """Quartiles and fences (1.5 quartile distances outside) per session and parameter."""
    return quantiles(readings(log), GROUP, QUARTILES, sizes).selectExpr(
        *GROUP,
        "n AS readings",
        *QUARTILES,
        "q1 - 1.5D * (q3 - q1) AS low_fence",
        "q3 + 1.5D * (q3 - q1) AS high_fence",
    )


_INSIDE = "value BETWEEN low_fence AND high_fence"


def _with_fences(log: DataFrame, found: DataFrame, sizes: Sizes, ids: list[str]) -> DataFrame:
    names = ["low_fence", "high_fence"]
    per_session = found.groupBy("session_id").agg(
        *[
            F.expr(f"max({n}) FILTER (WHERE parameter = '{c}') AS {n}_{c}")
            for c in MEASUREMENTS
            for n in names
        ]
    )
    return _with_figures(log, per_session, names, sizes, ids)


def box_stats(log: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Quartiles, whiskers and number of outliers per session and parameter."""
    sizes = sizes or measured(log)
    # Read twice, and the dearest part.
    found = written(quartiles(log, sizes))
    whiskers = (
        _with_fences(log, found, sizes, ["session_id"])
        .groupBy(*GROUP)
        .agg(
            F.expr(f"min(value) FILTER (WHERE {_INSIDE}) AS whisker_low"),
            F.expr(f"max(value) FILTER (WHERE {_INSIDE}) AS whisker_high"),
            F.expr(f"count_if(NOT {_INSIDE}) AS outliers"),
        )
    )
    return found.join(whiskers, GROUP)


def box_outliers(log: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Every reading outside its session's fences."""
    sizes = sizes or measured(log)
    ids = ["session_id", "row_ordinal", "timestamp"]
    return (
        _with_fences(log, quartiles(log, sizes), sizes, ids)
        .where(f"NOT {_INSIDE}")
        .select(*ids, "parameter", "value")
    )


def cohort_stats(
    log: DataFrame, sizes: Sizes | None = None, display: bool = True
) -> DataFrame:
    """Median, quartiles, extremes and readings per parameter over all sessions.

    For display the quartiles have one decimal and the other figures two.
    """
    sizes = sizes or measured(log)
    values = readings(log)
    middle = quantiles(values, ["parameter"], QUARTILES, sizes)
    ends = values.groupBy("parameter").agg(
        F.min("value").alias("min"), F.max("value").alias("max")
    )
    digits = {"median": 2, "q1": 1, "q3": 1, "min": 2, "max": 2}
    return middle.join(F.broadcast(ends), "parameter").selectExpr(
        "parameter",
        *[f"bround({c}, {d}) AS {c}" if display else c for c, d in digits.items()],
        "n AS readings",
    )


def limit_bands(log: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """The median configured low and high limit per session and parameter."""
    sizes = sizes or measured(log)
    limits = [c for pair in LIMIT_PAIRS.values() for c in pair]
    # A limit is set rarely and read on every row: medians over its few distinct values.
    medians = quantiles(readings(log, limits), GROUP, {"limit": 0.5}, sizes)
    of = {c: (p, side) for p, pair in LIMIT_PAIRS.items() for c, side in zip(pair, ("low", "high"))}

    def named(i: int) -> Column:
        return F.create_map(*[F.lit(x) for c, v in of.items() for x in (c, v[i])])

    return medians.select(
        "session_id",
        named(0)[F.col("parameter")].alias("parameter"),
        named(1)[F.col("parameter")].alias("side"),
        F.col("limit").alias("limit_value"),
    )


def correlations(log: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of varying parameters, over the rows that have both.

    A pair with no variation on its common rows has no row, and a session with a
    single varying parameter has none at all. All pairs are aggregated at once, from
    central moments, and become rows afterwards.
    """
    pairs = list(combinations(MEASUREMENTS, 2))
    # ``corr`` divides by zero where a parameter does not vary, an error in ANSI mode.
    moments = [F.expr(f"regr_sxy({a}, {b}) / nullif(sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})), 0D) AS `{a}*{b}`") for a, b in pairs]
    moments += [F.expr(f"IF(var_samp({c}) > 0, 1.0D, NULL) AS `{c}*{c}`") for c in MEASUREMENTS]
    names = [(c, c) for c in MEASUREMENTS] + pairs
    varying = " + ".join(f"IF(`{c}*{c}` IS NULL, 0, 1)" for c in MEASUREMENTS)
    entries = ", ".join(
        f"struct('{x}' AS parameter_a, '{y}' AS parameter_b, `{a}*{b}` AS correlation)"
        for a, b in names
        for x, y in dict.fromkeys([(a, b), (b, a)])
    )
    return (
        log.groupBy("session_id")
        .agg(*moments)
        .where(f"{varying} >= 2")
        .selectExpr("session_id", f"inline(array({entries}))")
        .where("correlation IS NOT NULL AND NOT isnan(correlation)")
    )
