"""The three stored tables: sessions, measurements, alarm events.

Each load writes its own folder of every table, measurements first and sessions
last. A load counts once its sessions are written: rows of an unfinished load
are not read, and running it again replaces them. Load and session numbers are
claimed first (``claims``), so loads may run at the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicelog.operators.alarms import alarm_events
from devicelog.operators.compare import newest_first
from devicelog.operators.sizes import Sizes, attached
from devicelog.schema import ALARM_EVENTS_SCHEMA, FILES_SCHEMA, MEASUREMENTS_SCHEMA, SESSIONS_SCHEMA
from devicelog.sources.claims import Claim, Claims


def build_sessions(
    log: DataFrame,
    files: DataFrame,
    sizes: Sizes,
    provenance: DataFrame | None = None,
    uploaded_at: Column | None = None,
    device_type: str = "unknown",
    center_id: str = "unknown",
) -> DataFrame:
    """One row per session. Its case id is that of its earliest row."""
    place = F.struct(F.col("timestamp").isNull(), "timestamp", "row_ordinal")
    found = log.groupBy("session_id").agg(
        F.min_by("case_id", place).alias("case_id"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp").alias("time_start"),
        F.max("timestamp").alias("time_end"),
    )
    found = attached(found, files.select("session_id", "filename"), sizes)
    if provenance is None:
        found = found.withColumn("provenance", F.lit(None).cast("string"))
    else:
        found = found.join(provenance, "session_id", "left")
    now = F.now().cast("timestamp_ntz") if uploaded_at is None else uploaded_at
    return found.withColumns(
        {
            "device_type": F.lit(device_type),
            "center_id": F.lit(center_id),
            "uploaded_at": F.date_trunc("second", now).cast("timestamp_ntz"),
        }
    ).select(*SESSIONS_SCHEMA.names)


class Store:
    """Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._claims = Claims(spark, f"{self.folder}/claims")

    def append(
        self,
        load_id: int,
        log: DataFrame,
        sessions_of: Callable[[DataFrame], DataFrame],
        files: DataFrame | None = None,
    ) -> None:
        """Write one load; writing the same load id again replaces it.

        ``sessions_of`` gives the sessions of the stored measurements, ``files`` the
        paths and lengths of the files they come from.
        """
        by_time = ["session_id", "timestamp", "row_ordinal"]
        self._write(
            "measurements",
            load_id,
            # Ranges cut long sessions into several files and keep each session's rows together.
            log.select(*MEASUREMENTS_SCHEMA.names)
            .repartitionByRange(*by_time)
            .sortWithinPartitions(*by_time),
        )
        stored = self.spark.read.schema(MEASUREMENTS_SCHEMA).parquet(
            self._part("measurements", load_id)
        )
        self._write("alarm_events", load_id, alarm_events(stored))
        if files is not None:
            self._write("files", load_id, files.select(*FILES_SCHEMA.names))
        self._write("sessions", load_id, sessions_of(stored).select(*SESSIONS_SCHEMA.names))

    def _part(self, table: str, load_id: int) -> str:
        return f"{self.folder}/{table}/load_id={load_id}"

    def _write(self, table: str, load_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._part(table, load_id))

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("load_id", T.LongType())])
        try:
            return self.spark.read.schema(full).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def _loads(self, table: str, marker: str = "") -> set[int]:
        """Loads that have a folder in a table; a listing of the driver, no Spark job."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/load_id=*{marker}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [status.getPath() for status in files.globStatus(path) or []]
        return {int((p.getParent() if marker else p).getName().removeprefix("load_id=")) for p in found}

    def unfinished(self, table: str) -> set[int]:
        """Loads with rows in a table whose sessions are not written: those of writers at work or lost."""
        return self._loads(table) - self._loads("sessions", "/_SUCCESS")

    def _committed(self, table: str, schema: T.StructType) -> DataFrame:
        """All rows of finished loads, with ``load_id``."""
        rows = self._read(table, schema)
        unfinished = self.unfinished(table)
        return rows.where(~F.col("load_id").isin(*sorted(unfinished))) if unfinished else rows

    def _finished_sessions(self) -> DataFrame:
        return self._committed("sessions", SESSIONS_SCHEMA)

    def sessions(self) -> DataFrame:
        """All sessions, newest first."""
        return self._finished_sessions().drop("load_id").orderBy(*newest_first())

    def files(self) -> DataFrame:
        """Path and length of the file behind each session, where a load noted them."""
        return self._committed("files", FILES_SCHEMA).drop("load_id")

    def sizes(self) -> Sizes:
        """Sizes of the stored log, from the row counts of its sessions."""
        row = (
            self._finished_sessions()
            .agg(F.count(F.lit(1)), F.sum("row_count"), F.max("row_count"))
            .first()
        )
        return Sizes(sessions=row[0], rows=row[1] or 0, longest=row[2] or 0)

    def last_load_id(self) -> int:
        """The largest load id that a table has or a writer has claimed; -1 if there is none."""
        written = self._loads("sessions") | self._loads("measurements")
        return max([-1, *written, *(c.load_id for c in self._claims.all())])

    def last_session_id(self) -> int:
        """The largest session id that is stored or claimed."""
        stored = self._read("sessions", SESSIONS_SCHEMA).agg(F.max("session_id")).first()[0] or 0
        return max([stored, *(c.last_session for c in self._claims.all())])

    def claim(self, sessions: int, source: str | None = None, batch: int | None = None) -> Claim:
        """A load id and session ids of its own for a new load."""
        return self._claims.take(sessions, self.last_load_id() + 1, self.last_session_id() + 1, source, batch)

    def claim_of_batch(self, source: str, batch: int, sessions: int) -> Claim:
        """The claim of a stream's batch: the one it was given before if that has as many sessions, else a new one.

        An earlier claim of the batch with another number is given up; what it
        wrote has no sessions, or the files would be known.
        """
        known = [c for c in self._claims.all() if (c.source, c.batch) == (source, batch) and c.sessions == sessions]
        return known[-1] if known else self.claim(sessions, source, batch)

    def claim_of(self, load_id: int, sessions: int) -> Claim:
        """A given load, which is written anew, with session ids of its own."""
        known = [c for c in self._claims.all() if c.load_id == load_id and c.sessions == sessions]
        if known:
            return known[0]
        return Claim(load_id, self.claim(sessions).first_session, sessions)

    def measurements(self, session_ids: int | list[int] | DataFrame | None = None) -> DataFrame:
        """Samples of all, one or several sessions; ids may be a frame with ``session_id``."""
        return self._chosen("measurements", MEASUREMENTS_SCHEMA, session_ids)

    def alarm_events(self, session_ids: int | list[int] | DataFrame | None = None) -> DataFrame:
        return self._chosen("alarm_events", ALARM_EVENTS_SCHEMA, session_ids)

    def loads_of(self, session_ids: list[int]) -> list[int]:
        """The loads of sessions, from the sessions table; no more of them than sessions."""
        found = self._finished_sessions().where(F.col("session_id").isin(session_ids)).select("load_id").distinct()
        return sorted(row.load_id for row in found.collect())

    def _chosen(self, table: str, schema: T.StructType, session_ids: int | list[int] | DataFrame | None) -> DataFrame:
        """Rows of sessions; only the folders of their loads are listed and read."""
        rows = self._committed(table, schema)
        if session_ids is None:
            return rows.drop("load_id")
        if isinstance(session_ids, DataFrame):
            # A session lies in one load, so the load is a partition filter that Spark finds at run time.
            ids = self._finished_sessions().join(session_ids.select("session_id"), "session_id", "left_semi")
            return rows.join(ids.select("load_id", "session_id"), ["load_id", "session_id"], "left_semi").drop("load_id")
        ids = [session_ids] if isinstance(session_ids, int) else session_ids
        chosen = F.col("session_id").isin(ids)
        return rows.where(F.col("load_id").isin(self.loads_of(ids)) & chosen).drop("load_id")


def by_time(table: DataFrame) -> DataFrame:
    """Order for output: by time, samples without one last."""
    return table.orderBy(F.col("timestamp").asc_nulls_last(), "session_id", "row_ordinal")


def by_session_and_time(table: DataFrame) -> DataFrame:
    return table.orderBy("session_id", F.col("timestamp").asc_nulls_last(), "row_ordinal")
