"""Sizes that decide how sessions are joined and split.

One aggregate over the session id tells how many sessions there are and how
long the longest is. A table with one row per session is broadcast only when
that count proves it small, and a session is handled by one task only when it
is short enough for one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Sizes:
    """Rows and sessions of a log; the two limits can be lowered in tests."""

    sessions: int
    rows: int
    longest: int
    rows_per_task: int = ROWS_PER_TASK
    broadcast_bytes: int = BROADCAST_BYTES

    @property
    def fits_tasks(self) -> bool:
        """Every session is short enough to be sorted or merged by one task."""
        return self.longest <= self.rows_per_task

    def fits_broadcast(self, row_bytes: int) -> bool:
        """A table with one row of this size per session is small enough to broadcast."""
        return self.sessions * row_bytes <= self.broadcast_bytes

    def with_limits(self, rows_per_task: int, broadcast_bytes: int | None = None) -> Sizes:
        return replace(
            self,
            rows_per_task=rows_per_task,
            broadcast_bytes=self.broadcast_bytes if broadcast_bytes is None else broadcast_bytes,
        )


def measured(df: DataFrame, key: str = "session_id") -> Sizes:
    """Count sessions and rows; reads only the key column."""
    row = (
        df.groupBy(key)
        .count()
        .agg(F.count(F.lit(1)), F.sum("count"), F.max("count"))
        .first()
    )
    return Sizes(sessions=row[0], rows=row[1] or 0, longest=row[2] or 0)


def by_length(df: DataFrame, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """The rows of sessions short enough for one task, and those of longer ones."""
    ids = (
        df.groupBy("session_id")
        .count()
        .where(F.col("count") > sizes.rows_per_task)
        .select("session_id")
    )
    # There are at most rows / rows_per_task of them.
    if sizes.rows // sizes.rows_per_task * 8 <= sizes.broadcast_bytes:
        ids = F.broadcast(ids)
    return df.join(ids, "session_id", "left_anti"), df.join(ids, "session_id", "left_semi")


def attached(
    rows: DataFrame,
    per_session: DataFrame,
    sizes: Sizes,
    on: list[str] | str = "session_id",
    how: str = "inner",
    row_bytes: int = 256,
) -> DataFrame:
    """Join a table with one row per session back to the rows.

    It is broadcast when its size is proven small. Otherwise the plain join
    shuffles, and the adaptive skew join splits the partitions of long sessions.
    """
    if sizes.fits_broadcast(row_bytes):
        per_session = F.broadcast(per_session)
    return rows.join(per_session, on, how)
