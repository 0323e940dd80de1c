"""Rolling features, the forward alarm target and the ordered train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from devicelog.operators.positions import over_rows, with_global_position
from devicelog.operators.sizes import Sizes, attached, measured
from devicelog.schema import ALARM_HORIZON, MEASUREMENTS, ROLLING_ROWS

RATIO = "pressure_flow_ratio"
FEATURES = [
    *[f"rolling_mean_{c}" for c in MEASUREMENTS],
    *[f"rolling_std_{c}" for c in MEASUREMENTS],
    *[f"delta_{c}" for c in MEASUREMENTS],
    RATIO,
]


# What features, target and split are made from.
INPUTS = ["session_id", "row_ordinal", "timestamp", "alarm_active", *MEASUREMENTS]


def pressure_flow_ratio() -> Column:
    """Pressure difference over flow, 0 where unknown, kept within -50..50."""
    ratio = F.col("pressure_delta_mmhg") / F.nullif(F.col("flow_rate_lpm"), F.lit(0.0))
    return F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.coalesce(ratio, F.lit(0.0))))


def _rolling(window: WindowSpec, rows: int) -> dict[str, Column]:
    frame = window.rowsBetween(1 - rows, 0)
    columns = {}
    for c in MEASUREMENTS:
        value = F.col(c)
        columns[f"rolling_mean_{c}"] = F.avg(value).over(frame)
        columns[f"rolling_std_{c}"] = F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))
        columns[f"delta_{c}"] = F.coalesce(value - F.lag(value).over(window), F.lit(0.0))
    return columns


def alarm_ahead(window: WindowSpec, first: int, last: int) -> Column:
    """1 if any of the rows first..last after this one has an alarm, else 0."""
    alarm = F.coalesce(F.col("alarm_active"), F.lit(False)).cast("int")
    return F.coalesce(F.max(alarm).over(window.rowsBetween(first, last)), F.lit(0))


def target_rows(horizon: int, coded: bool = True) -> tuple[int, int]:
    """Rows ahead that decide the target.

    As coded the target looks at ``horizon`` rows starting ``horizon`` rows ahead; the
    documented intent, with ``coded=False``, is the next ``horizon`` rows.
    """
    return (horizon, 2 * horizon - 1) if coded else (1, horizon)


def alarm_target(
    log: DataFrame,
    sizes: Sizes | None = None,
    horizon: int = ALARM_HORIZON,
    coded: bool = True,
) -> DataFrame:
    """Add ``alarm_future``."""
    sizes = sizes or measured(log)
    first, last = target_rows(horizon, coded)
    return over_rows(
        log, sizes, lambda w: {"alarm_future": alarm_ahead(w, first, last)}, before=0, after=last
    )


def _without_empty(features: DataFrame, log: DataFrame, sizes: Sizes) -> DataFrame:
    """NULL the features of parameters that a session has no reading of."""
    if sizes.fits_tasks:
        whole = Window.partitionBy("session_id")
        has = {c: F.count(c).over(whole) > 0 for c in MEASUREMENTS}
        flagged = features.withColumns({f"_has_{c}": test for c, test in has.items()})
    else:
        counts = log.groupBy("session_id").agg(
            *[(F.count(c) > 0).alias(f"_has_{c}") for c in MEASUREMENTS]
        )
        flagged = attached(features, counts, sizes, row_bytes=32)
    kept = {
        f"{kind}_{c}": F.when(F.col(f"_has_{c}"), F.col(f"{kind}_{c}"))
        for c in MEASUREMENTS
        for kind in ("rolling_mean", "rolling_std", "delta")
    }
    return flagged.withColumns(kept).drop(*[f"_has_{c}" for c in MEASUREMENTS])


def features(
    log: DataFrame,
    sizes: Sizes | None = None,
    rows: int = ROLLING_ROWS,
    horizon: int | None = None,
    coded: bool = True,
) -> DataFrame:
    """Add the rolling mean, spread and change of each parameter and the pressure/flow index.

    With a ``horizon`` the alarm target is added in the same pass.
    """
    sizes = sizes or measured(log)
    first, last = target_rows(horizon, coded) if horizon else (0, 0)

    def columns(window: WindowSpec) -> dict[str, Column]:
        target = {"alarm_future": alarm_ahead(window, first, last)} if horizon else {}
        return {**_rolling(window, rows), **target}

    rolled = over_rows(log, sizes, columns, before=max(rows - 1, 1), after=last)
    return _without_empty(rolled, log, sizes).withColumn(RATIO, pressure_flow_ratio())


def train_test_split(
    df: DataFrame, sizes: Sizes | None = None, share: float = 0.8, by_session: bool = False
) -> DataFrame:
    """Add ``split``: the first share of the rows is ``train``, the rest ``test``.

    Rows are ordered by session and time over all sessions together; with
    ``by_session`` each session is cut at its own share.
    """
    sizes = sizes or measured(df)
    placed = with_global_position(df, sizes)
    if by_session:
        counts = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("_rows"))
        placed = attached(placed, counts, sizes, row_bytes=16)
        train = F.col("position") < F.floor(F.col("_rows") * F.lit(share))
    else:
        train = F.col("global_position") < int(df.count() * share)
    return placed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_rows")


def filled_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns among ``names`` with at least one value."""
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if counts[c] > 0]


