"""Row positions, and windows over sessions of any length.

Short sessions use one window partition each. The rows of sessions too long for
one task are range-partitioned by session and time, which cuts each of them into
many partitions; positions follow from each partition's row count. Windows then
run on slices of positions that carry the few rows of their neighbours that
their frames reach into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from devicelog.operators.sizes import ROWS_PER_TASK, Sizes, attached, by_length
from devicelog.session import written

_INDEX_BITS = 33


def time_order() -> list[Column]:
    return [F.col("timestamp").asc_nulls_last(), F.col("row_ordinal").asc()]


def session_window() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy(*time_order())


def with_position(df: DataFrame, sizes: Sizes) -> DataFrame:
    """Add ``position``, the 0-based place of a row in its session by time, if not there yet."""
    if "position" in df.columns:
        return df

    def ranked(short: DataFrame) -> DataFrame:
        place = F.row_number().over(session_window()).cast("long") - 1
        return short.withColumn("position", place)

    if sizes.fits_tasks:
        return ranked(df)
    short, long = by_length(df, sizes)
    return ranked(short).unionByName(_placed_in_sessions(long, sizes).drop("global_position"))


def with_global_position(df: DataFrame, sizes: Sizes) -> DataFrame:
    """Add ``position`` and ``global_position``, the place among all rows by (session, time)."""
    if "global_position" in df.columns:
        return df
    if sizes.sessions > sizes.rows_per_task:
        return _placed_in_sessions(df, sizes)
    earlier = Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy("session_id")
        .count()
        .select(
            "session_id",
            F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("session_start"),
        )
    )
    return (
        attached(with_position(df, sizes), starts, sizes, row_bytes=16)
        .withColumn("global_position", F.col("session_start") + F.col("position"))
        .drop("session_start")
    )


def numbered(
    df: DataFrame, order: list[Column], rows: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``number``, the 0-based place of a row in the given order.

    ``rows`` is the number of rows; a short list is numbered by one window.
    """
    if rows <= rows_per_task:
        return df.withColumn("number", F.row_number().over(Window.orderBy(*order)) - F.lit(1))
    placed = _in_order(df, order, rows, rows_per_task)
    return (
        placed.join(F.broadcast(_part_starts(placed)), "_part")
        .withColumn("number", F.col("part_start") + _index())
        .drop("_part", "_id", "part_start")
    )


def _in_order(df: DataFrame, order: list[Column], rows: int, rows_per_task: int) -> DataFrame:
    """The rows sorted across partitions, each with its partition and an id rising within it."""
    parts = max(1, -(-rows // rows_per_task))
    # Written once: the range bounds are sampled, so a second run could cut elsewhere.
    return written(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", _INDEX_BITS))


def _index() -> Column:
    return F.col("_id").bitwiseAND((1 << _INDEX_BITS) - 1)


def _part_starts(placed: DataFrame) -> DataFrame:
    """Rows before each partition; one row per partition, so the window is short."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    )


def _placed_in_sessions(df: DataFrame, sizes: Sizes) -> DataFrame:
    order = [F.col("session_id").asc(), *time_order()]
    placed = _in_order(df, order, sizes.rows, sizes.rows_per_task)
    # A run is the part of a session within one partition.
    runs = placed.groupBy("_part", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id")
    )
    before = Window.partitionBy("session_id").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = runs.select(
        "_part",
        "session_id",
        "first_id",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"),
    ).join(F.broadcast(_part_starts(placed)), "_part")
    most_runs = sizes.sessions + sizes.rows // sizes.rows_per_task + 1
    if most_runs * 48 <= sizes.broadcast_bytes:
        starts = F.broadcast(starts)
    return (
        placed.join(starts, ["_part", "session_id"])
        .withColumn("position", F.col("run_start") + F.col("_id") - F.col("first_id"))
        .withColumn("global_position", F.col("part_start") + _index())
        .drop("_part", "_id", "first_id", "run_start", "part_start")
    )


def over_rows(
    df: DataFrame,
    sizes: Sizes,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int,
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` rows ahead.

    ``columns`` builds the named expressions from the window to use.
    """
    if sizes.fits_tasks:
        return df.withColumns(columns(session_window()))
    short, long = by_length(df, sizes)
    return short.withColumns(columns(session_window())).unionByName(
        _over_slices(long, sizes, columns, before, after).select(
            *df.columns, *columns(session_window())
        )
    )


def _over_slices(
    df: DataFrame,
    sizes: Sizes,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int,
) -> DataFrame:
    step = max(sizes.rows_per_task, before, after, 1)
    own = F.floor(F.col("position") / step)
    place = F.col("position") % step
    slices = F.array(
        own,
        F.when(place >= step - before, own + 1),
        F.when((place < after) & (own > 0), own - 1),
    )
    pieces = (
        with_position(df, sizes)
        .withColumn("_own", own)
        .withColumn("_slice", F.explode(F.array_compact(slices)))
    )
    window = Window.partitionBy("session_id", "_slice").orderBy("position")
    return pieces.withColumns(columns(window)).where(F.col("_slice") == F.col("_own"))
