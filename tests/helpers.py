from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from devicelog.operators.clean import KEYS, map_columns
from devicelog.schema import MEASUREMENTS_SCHEMA


def raw_frame(spark: SparkSession, columns: dict[str, list], session_ids=None) -> DataFrame:
    """A mapped raw frame from device headers to cells, one session unless ids are given."""
    n = len(next(iter(columns.values())))
    ids = session_ids or [1] * n
    rows = [(ids[i], i, *[cells[i] for cells in columns.values()]) for i in range(n)]
    schema = "session_id LONG, row_ordinal LONG, " + ", ".join(f"`{c}` STRING" for c in columns)
    return map_columns(spark.createDataFrame(rows, schema), KEYS)


def log_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A clean log; missing columns are NULL and rows are numbered."""
    full = []
    for i, row in enumerate(rows):
        base = {"session_id": 1, "row_ordinal": i, "case_id": "C1", "alarm_active": False, **row}
        full.append(tuple(base.get(name) for name in MEASUREMENTS_SCHEMA.names))
    return spark.createDataFrame(full, MEASUREMENTS_SCHEMA)


def column(df: DataFrame, name: str, order: str = "row_ordinal") -> list:
    return [row[0] for row in df.orderBy(order).select(name).collect()]


def rows_of(df: DataFrame) -> list[tuple]:
    """All rows with sorted columns, doubles to nine places, in a common order."""

    def value(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    names = sorted(df.columns)
    found = [tuple(value(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect()]
    return sorted(found, key=repr)


