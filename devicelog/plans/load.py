"""Loading new device files into the store: read, clean, audit, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelog.operators.audit import audit_json
from devicelog.operators.clean import deduplicated, typed
from devicelog.operators.sizes import Sizes, measured
from devicelog.schema import COLUMN_MAP
from devicelog.session import use_utc, written
from devicelog.sources import csv_files
from devicelog.sources.store import Store, build_sessions


#: So many new files are read by their names.
NAMED_FILES = 1000


@dataclass(frozen=True)
class Loaded:
    sessions: int
    report: DataFrame


def load_files(
    spark: SparkSession,
    paths: str | list[str],
    store: Store,
    load_id: int | None = None,
    column_map: dict[str, str] = COLUMN_MAP,
    device_type: str = "unknown",
    center_id: str = "unknown",
    batch: tuple[str, int] | None = None,
    identity: str = "name",
) -> Loaded:
    """Load each file that the store does not know yet; the report names the others.

    A file is known by its name, as in the original, or with ``identity`` "path" by
    its path and length, so that files of one name in several folders are loaded.
    ``batch`` names a stream and its batch, which keeps its load when it runs again.
    """
    if identity not in ("name", "path"):
        raise ValueError("identity must be 'name' or 'path'")
    use_utc(spark)
    listed = csv_files.list_files(spark, paths)
    by_path = identity == "path"
    chosen = csv_files.changed_files(listed, store.files()) if by_path else csv_files.new_files(listed, store.sessions())
    files = written(chosen)
    skipped = csv_files.skipped_report(listed.join(files.select("source_file"), "source_file", "left_anti"), by_path)
    n_files = files.count()
    if not n_files:
        return Loaded(0, skipped)
    source = paths
    if n_files <= NAMED_FILES and n_files < listed.count():
        # A few new files among many are read by name; else the folder is read, and others drop out by a join.
        source = [csv_files.as_path(row.source_file) for row in files.select("source_file").collect()]
    if batch is not None:
        claim = store.claim_of_batch(*batch, n_files)
    else:
        claim = store.claim(n_files) if load_id is None else store.claim_of(load_id, n_files)
    raw, numbered_files, headers, records = csv_files.read_sessions(spark, source, files, column_map, claim.first_session)
    # The text is parsed once; sizes, formats and types are read from columns.
    raw = written(raw)
    rows, sizes = load_raw(
        raw,
        numbered_files,
        store,
        claim.load_id,
        device_type=device_type,
        center_id=center_id,
    )
    counts = csv_files.row_counts(raw, numbered_files)
    formats = rows.groupBy("session_id").agg(F.max("ts_format").alias("ts_format")).join(numbered_files, "session_id")
    found = csv_files.load_report(numbered_files.drop("session_id"), headers, counts, records.broken, formats)
    return Loaded(sizes.sessions, found.unionByName(skipped))


def load_raw(
    raw: DataFrame,
    files: DataFrame,
    store: Store,
    load_id: int,
    with_audit: bool = True,
    uploaded_at: Column | None = None,
    device_type: str = "unknown",
    center_id: str = "unknown",
) -> tuple[DataFrame, Sizes]:
    """Clean raw rows and write them as one load.

    The typed rows are written once and read for duplicates and audit. They are
    returned with the sizes of the raw log.
    """
    sizes = measured(raw)
    rows = written(typed(raw, sizes))
    store.append(
        load_id,
        deduplicated(rows),
        lambda log: build_sessions(
            log,
            files,
            sizes,
            audit_json(rows) if with_audit else None,
            uploaded_at,
            device_type,
            center_id,
        ),
        files if "source_file" in files.columns else None,
    )
    return rows, sizes
