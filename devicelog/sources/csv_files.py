"""Reading folders of device CSV files whose headers differ.

All files come from one scan as records of cells (``csv_records``). Each file's own
header, its first record, says which place holds which column, so values never
move between columns when files order or name them differently.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelog.functions import timestamps
from devicelog.functions.cells import quoted
from devicelog.operators.positions import numbered
from devicelog.operators.sizes import BROADCAST_BYTES
from devicelog.schema import CANONICAL, COLUMN_MAP, UNKNOWN_CASE
from devicelog.session import few_listing_tasks, written
from devicelog.sources.csv_records import CSV_FILES, Records, read_records

#: A file's row beside its names, which are measured.
_BYTES_PER_FILE = 512
#: Cells beyond a header are kept under this name and their place.
BEYOND = "beyond header "


def as_path(source_file: str) -> str:
    """A path to read a listed file by: names arrive URL-encoded, and glob characters stand for themselves."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", unquote(source_file))


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: ``source_file``, ``filename``, ``length``. Contents are not read.

    Spark leaves files of zero bytes out.
    """
    few_listing_tasks(spark)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", CSV_FILES)
        .load(paths)
        .select(
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_name").alias("filename"),
            "length",
        )
    )


def new_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files whose name no session has; of two files with one name the first counts."""
    first = files.groupBy("filename").agg(
        F.min("source_file").alias("source_file"), F.min_by("length", "source_file").alias("length")
    )
    return first.join(sessions.select("filename"), "filename", "left_anti")


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose path is not stored with their length; names do not matter."""
    return files.join(stored.select("source_file", "length"), ["source_file", "length"], "left_anti").select(
        "filename", "source_file", "length"
    )


def read_headers(records: Records, column_map: dict[str, str] = COLUMN_MAP) -> DataFrame:
    """One row per file: its column names, the 1-based place of each canonical column, and where the header is.

    A repeated name gets a numbered suffix.
    """
    rows = records.rows.where("block = 0")
    # Cells as aggregates would sort the rows of all files.
    at = _small(written(rows.groupBy("source_file").agg(F.min("row_ordinal").alias("header_at"))))
    first = rows.join(at, "source_file").where("row_ordinal = header_at").withColumnRenamed("cells", "fields")
    same = "size(filter(slice(fields, 1, i), other -> other = f))"
    names = first.selectExpr(
        "source_file",
        "header_at",
        f"transform(fields, (f, i) -> IF({same} > 0, concat(f, '.', {same}), f)) AS names",
    )
    of_canonical: dict[str, list[str]] = {}
    for header, canonical in column_map.items():
        of_canonical.setdefault(canonical, []).append(header)

    def place(canonical: str) -> str:
        places = [f"nullif(array_position(names, {quoted(h)}), 0L)" for h in of_canonical.get(canonical, [])]
        return f"CAST(coalesce({', '.join([*places, 'NULL'])}) AS INT) AS {canonical}"

    known = ", ".join(quoted(h) for h in column_map)
    return names.selectExpr(
        "source_file",
        "header_at",
        "names",
        f"struct({', '.join(place(c) for c in CANONICAL)}) AS places",
        f"filter(names, n -> NOT array_contains(array({known}), n)) AS unmapped",
    )


def _small(files: DataFrame, names: bool = False) -> DataFrame:
    """A written table with a row for each file, marked for broadcast if it is measured to be small."""
    width = F.octet_length("source_file") + F.lit(_BYTES_PER_FILE)
    if names:
        width = width + 2 * F.octet_length(F.array_join("names", ",")) + 32 * F.size("names")
    size = files.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(files) if size <= BROADCAST_BYTES else files


def read_logs(records: Records, headers: DataFrame) -> DataFrame:
    """The raw rows of all files: ``source_file``, ``row_ordinal``, canonical cells, ``extra``.

    A cell is NULL only where its file lacks the column; blank cells are ``''``.
    ``wide`` marks rows with a filled cell beyond their file's header; ``extra``
    keeps such cells by their place.
    """
    rows = records.rows.drop("block").join(_small(headers, names=True), "source_file").where("row_ordinal > header_at")
    cell = "coalesce(try_element_at(cells, CAST(array_position(names, n) AS INT)), '')"
    named = f"transform(unmapped, n -> struct(n AS name, {cell} AS cell))"
    name = f"concat('{BEYOND}', i + size(names) + 1)"
    beyond = (
        f"filter(transform(slice(cells, size(names) + 1, size(cells)), (c, i) -> "
        f"struct(IF(array_contains(names, {name}), concat({name}, '.1'), {name}) AS name, c AS cell)), e -> e.cell <> '')"
    )
    rows = rows.withColumn("others", F.expr(f"IF(size(cells) > size(names), concat({named}, {beyond}), {named})"))
    return rows.selectExpr(
        "source_file",
        "row_ordinal",
        *[f"IF(places.{c} IS NULL, NULL, coalesce(try_element_at(cells, places.{c}), '')) AS {c}" for c in CANONICAL],
        "IF(size(others) > 0, map_from_entries(others), NULL) AS extra",
        # Not by ``others``, which counts of wide rows then need not make.
        "size(cells) > size(names) AND coalesce(exists(slice(cells, size(names) + 1, size(cells)), c -> c <> ''), false) AS wide",
    )


def row_counts(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Rows and too wide rows per ``source_file``."""
    counts = raw.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("wide").alias("wide_rows"))
    return counts.join(files, "session_id").select("source_file", "rows", "wide_rows")


def skipped_report(skipped: DataFrame, by_path: bool = False) -> DataFrame:
    """A finding for each file that is not loaded because its name, or its path and length, is known."""
    known = ("FILE_KNOWN", "Not loaded: this file is in the store with the same length.")
    code, message = known if by_path else ("NAME_KNOWN", "Not loaded: a file of this name is in the store or in this load.")
    return skipped.select(
        "source_file",
        "filename",
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        F.array().cast("array<string>").alias("columns"),
    )


def with_session_ids(files: DataFrame, first_id: int = 1) -> DataFrame:
    """Number the files by name, starting at ``first_id``."""
    return numbered(files, [F.asc("filename"), F.asc("source_file")], files.count()).select(
        (F.col("number") + first_id).cast("long").alias("session_id"), "source_file", "filename", "length"
    )


def read_sessions(
    spark: SparkSession,
    paths: str | list[str],
    files: DataFrame | None = None,
    column_map: dict[str, str] = COLUMN_MAP,
    first_id: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame, Records]:
    """Read files as sessions: raw rows, the numbered files, their headers and the records behind them.

    Files below ``paths`` that ``files`` does not have are left out.
    """
    files = written(with_session_ids(files if files is not None else list_files(spark, paths), first_id))
    records = read_records(spark, paths)
    headers = written(read_headers(records, column_map))
    ids = _small(files.select("session_id", "source_file"))
    raw = read_logs(records, headers).join(ids, "source_file").drop("source_file")
    return raw, files, headers, records


def load_report(
    files: DataFrame, headers: DataFrame, row_counts: DataFrame, broken: DataFrame, formats: DataFrame | None = None
) -> DataFrame:
    """Findings per file: code, message and the columns concerned.

    ``row_counts`` has the rows read and the too wide ones per ``source_file``,
    ``broken`` the files in which a quoted cell never ends, ``formats`` the
    ``ts_format`` elected for each ``source_file``.
    """
    joined = files.drop("length").join(headers, "source_file", "left").join(row_counts, "source_file", "left")
    if formats is None:
        joined = joined.withColumn("ts_format", F.lit(None).cast("int"))
    else:
        joined = joined.join(formats.select("source_file", "ts_format"), "source_file", "left")
    joined = joined.join(broken.select("source_file", F.lit(True).alias("is_broken")), "source_file", "left")

    def finding(test: Column, code: str, message: Column, columns: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(code).alias("code"), message.alias("message"), columns.alias("columns")
            ),
        )

    none = F.array().cast("array<string>")
    readable = F.col("names").isNotNull()
    findings = F.array(
        finding(F.col("is_broken"), "OPEN_QUOTE", F.lit("Not loaded: a quoted cell is still open where the file ends."), none),
        finding(~readable & F.col("is_broken").isNull(), "UNREADABLE", F.lit("Not loaded: the file has no header."), none),
        finding(
            readable & (F.coalesce("rows", F.lit(0)) == 0),
            "EMPTY_FILE",
            F.lit("The file has no rows below its header."),
            none,
        ),
        finding(
            F.col("wide_rows") > 0,
            "WIDE_ROWS",
            F.concat(F.col("wide_rows").cast("string"), F.lit(" rows have cells beyond the header; they are kept by their place.")),
            none,
        ),
        finding(
            F.size("unmapped") > 0,
            "UNRECOGNISED_COLUMNS",
            F.concat(F.lit("Columns without a canonical name, kept under their own: "), F.concat_ws(", ", "unmapped")),
            F.col("unmapped"),
        ),
        finding(
            readable & F.col("places.timestamp").isNull(),
            "NO_TIMESTAMP",
            F.lit("The header names no timestamp; reports over time leave this file out."),
            none,
        ),
        finding(
            F.col("ts_format") == timestamps.EACH_ROW,
            "NO_TIME_FORMAT",
            F.lit("No format fits the timestamps of the file; each is read by its own shape."),
            none,
        ),
        finding(
            readable & F.col("places.case_id").isNull(),
            "NO_CASE_ID",
            F.lit(f"The header names no case; every row gets the case id '{UNKNOWN_CASE}'."),
            none,
        ),
    )
    return joined.select("source_file", "filename", F.inline(F.array_compact(findings)))
