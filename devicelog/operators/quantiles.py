"""Exact quantiles (linear interpolation) of groups of any size.

Groups that are proven small use the built-in exact ``percentile``, which keeps a
group's distinct values in memory. Others take two rounds over the values. The
first merges a quantile sketch per group; its values somewhat below and above a
wanted rank enclose it, as the sketch's error is bounded. The second counts the
rows outside these narrow ranges and the copies of each value inside, which is all
that is shuffled, and the ranks are then exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelog.operators.sizes import Sizes, by_length
from devicelog.session import written

#: A sketch's ranks are wrong by one in so many at most.
ACCURACY = 10_000
#: Values of a group that one task may hold to sort them.
ROWS_IN_MEMORY = 100_000
_BROADCAST_GROUPS = 200_000


def quantiles(
    values: DataFrame, keys: list[str], probabilities: dict[str, float], sizes: Sizes
) -> DataFrame:
    """Quantiles of the column ``value`` per group, one named column each.

    ``sizes`` describes the log the values come from.
    """
    values = values.select(*keys, "value").where(F.col("value").isNotNull())
    limit = min(sizes.rows_per_task, ROWS_IN_MEMORY)
    largest = sizes.longest if "session_id" in keys else sizes.rows
    if largest <= limit:
        return _builtin(values, keys, probabilities)
    if "session_id" not in keys:
        return _by_sketch(values, keys, probabilities)
    short, long = by_length(values, sizes.with_limits(limit))
    return _builtin(short, keys, probabilities).unionByName(_by_sketch(long, keys, probabilities))


def _builtin(values: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    wanted = F.array(*[F.lit(p) for p in probabilities.values()])
    return (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.percentile("value", wanted).alias("q"))
        .select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(probabilities)])
    )


def _by_sketch(
    values: DataFrame, keys: list[str], probabilities: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    slack = 2.0 / accuracy
    wanted = list(probabilities.values())
    # Beyond the ends there is no edge.
    edges = [p + side for p in wanted for side in (-slack, slack)]
    inner = [e for e in edges if 0 < e < 1] or [0.5]
    sketched = F.percentile_approx("value", F.array(*[F.lit(e) for e in inner]), F.lit(accuracy))
    groups = written(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketched.alias("e")))
    if groups.count() <= _BROADCAST_GROUPS:
        groups = F.broadcast(groups)

    # In a group of few rows the slack is less than the steps between ranks, so all its values are looked at.
    few = F.col("n") < 3 * accuracy

    def edge(e: float, beyond: str) -> Column:
        none = F.lit(float(beyond))
        return F.when(few, none).otherwise(F.col("e")[inner.index(e)]) if 0 < e < 1 else none

    ranges = [(edge(low, "-inf"), edge(high, "inf")) for low, high in zip(edges[::2], edges[1::2])]
    value = F.col("value")
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | value.between(low, high)
    # A row outside counts just below the next range above it; above the last one it does not matter.
    above = F.array_min(F.array_compact(F.array(*[F.when(low > value, low) for low, _ in ranges])))
    counted = (
        values.join(groups, keys)
        .select(*keys, "n", inside.alias("inside"), F.when(inside, value).otherwise(above).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "n", "value", "inside")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    order = Window.partitionBy(*keys).orderBy("value", "inside")
    placed = counted.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        own = (F.col("upto") - F.col("copies") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(own, F.when(F.col("inside"), value).otherwise(F.raise_error(F.lit("a rank lies outside its range")))))

    ends = [f(_place(p)).cast("long") for p in wanted for f in (F.floor, F.ceil)]
    found = placed.groupBy(*keys, "n").agg(*[at(rank).alias(f"v{i}") for i, rank in enumerate(ends)])
    return found.select(
        *keys, "n", *[_interpolated(p, f"v{2 * i}", f"v{2 * i + 1}").alias(name) for i, (name, p) in enumerate(probabilities.items())]
    )


def _place(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(p))


def _interpolated(p: float, low_name: str, high_name: str) -> Column:
    place, low_value, high_value = _place(p), F.col(low_name), F.col(high_name)
    low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
    between = (high - place) * low_value + (place - low) * high_value
    return F.when((low == high) | (low_value == high_value), low_value).otherwise(between)
