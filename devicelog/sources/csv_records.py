"""CSV records out of one scan of text lines, also where a quoted cell holds line breaks.

Lines are read by Spark's text reader, so large files are split and each byte is
read once; what later steps need is written to the shared folder. A line alone
tells whether it leaves a quoted cell open, both for a line that begins a record
and for one that begins inside a cell. Only files in which a line does are looked
at further: the state before each line follows from the lines before it, first
over the splits of a file, then within each split, and the lines of a record are
put together again. All other files keep one record per line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelog.functions.cells import quoted, stripped
from devicelog.operators.sizes import BROADCAST_BYTES
from devicelog.session import few_listing_tasks, written

#: Any case of the ending.
CSV_FILES = "*.[cC][sS][vV]"

_INDEX_MASK = (1 << 33) - 1
#: Bounds the path of a file, in a hash table.
_BYTES_PER_NAME = 8192
# The inside of a quoted cell up to its last character; possessive, so that long cells do not recurse.
_INSIDE = '[^"]*+(?:""[^"]*+)*+'
_FIELD = f'"{_INSIDE}"[^,]*+|[^",][^,]*+|'
_OPENS = f'^(?:(?:{_FIELD}),)*+"{_INSIDE}$'
_CLOSES = f'^{_INSIDE}"[^,]*+,?'


@dataclass(frozen=True)
class Records:
    """``rows``: source_file, row_ordinal, block, cells; ``broken``: files in which a quoted cell never ends."""

    rows: DataFrame
    broken: DataFrame


def quoted_cells(record: str) -> str:
    """All cells of a record, trimmed; a quoted cell loses its quotes."""
    pattern = quoted(f"({_FIELD}),")
    bare = f"replace(regexp_replace(f, {quoted(f'^"({_INSIDE})"')}, '$1'), '\"\"', '\"')"
    one = stripped(f"IF(startswith(f, '\"'), {bare}, f)")
    return f"transform(regexp_extract_all(concat({record}, ','), {pattern}, 1), f -> {one})"


#: The trimmed cells of a stored line.
_CELLS = f"IF(line IS NULL, transform(pieces, f -> {stripped('f')}), {quoted_cells('line')}) AS cells"
_PLACE = ["source_file", "row_ordinal", "block"]
_FILLED = "NOT (size(cells) = 1 AND cells[0] = '')"


def _is_open(line: str) -> str:
    return f"rlike({line}, {quoted(_OPENS)})"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line: source_file, block (start of its split), row_ordinal, its text, and how it changes the quote state.

    A line without quotes is kept as ``pieces`` between its commas, any other as ``line``.
    ``opens`` tells whether the line leaves a cell open if a record begins with it,
    ``stays`` if it begins inside a cell.
    """
    few_listing_tasks(spark)
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", CSV_FILES)
        .text(paths)
        .selectExpr(
            "_metadata.file_path AS source_file",
            "_metadata.file_block_start AS block",
            # A split holds fewer lines than bytes, so this rises through a file's splits.
            f"_metadata.file_block_start + (monotonically_increasing_id() & {_INDEX_MASK}L) AS row_ordinal",
            "replace(value, '\\ufeff', '') AS line",
        )
    )
    has_quote = "contains(line, '\"')"
    after = f"regexp_replace(line, {quoted(_CLOSES)}, '')"
    stays = f"NOT rlike(line, {quoted(_CLOSES)}) OR {_is_open(after)}"
    return lines.selectExpr(
        *_PLACE,
        f"IF({has_quote}, NULL, split(line, ',')) AS pieces",
        f"IF({has_quote}, line, NULL) AS line",
        f"IF({has_quote}, {_is_open('line')}, false) AS opens",
        f"IF({has_quote}, {stays}, true) AS stays",
    )


def _state(before: Column, fixed: Column, swaps: Column) -> Column:
    """A state after some lines: that of the last line which sets it, else the one before them; then swapped."""
    return F.pmod(F.coalesce(fixed, before) + swaps, F.lit(2))


def _swapped(lines: DataFrame) -> DataFrame:
    """Lines with the ``swaps`` within their split so far, and ``last_set``, what the last line that sets the state gives.

    A line leaves the state alone, sets it, or swaps it. So a state is the one of
    the last line that sets it, swapped as often as lines after it do; this is found
    within each split, given the state that the splits before leave.
    """
    opens, stays = F.col("opens").cast("int"), F.col("stays").cast("int")
    lines = lines.withColumn("swap", F.when((opens == 1) & (stays == 0), 1).otherwise(0))
    inside = Window.partitionBy("source_file", "block").orderBy("row_ordinal")
    lines = lines.withColumn("swaps", F.sum("swap").over(inside))
    # The state a setting line gives, with the swaps so far taken off again.
    lines = lines.withColumn("set", F.when(opens == stays, F.pmod(opens + F.col("swaps"), F.lit(2))))
    return lines.withColumn("last_set", F.last("set", ignorenulls=True).over(inside))


def _split_states(lines: DataFrame) -> DataFrame:
    """The states before and after each split: source_file, block, first_state, last_state."""
    ends = _swapped(lines).groupBy("source_file", "block").agg(
        F.max_by(F.struct("swaps", "last_set"), "row_ordinal").alias("end"), F.max("swaps").alias("n_swaps")
    )
    splits = Window.partitionBy("source_file").orderBy("block")
    earlier = splits.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before_swaps", F.coalesce(F.sum("n_swaps").over(earlier), F.lit(0)))
    own_set = F.pmod(F.col("end.last_set") + F.col("before_swaps"), F.lit(2))
    ends = ends.withColumn("own_set", own_set)
    first = _state(F.lit(0), F.last("own_set", ignorenulls=True).over(earlier), F.col("before_swaps"))
    last = _state(F.lit(0), F.last("own_set", ignorenulls=True).over(splits), F.col("before_swaps") + F.col("n_swaps"))
    return ends.select("source_file", "block", first.alias("first_state"), last.alias("last_state"))


def _with_starts(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines with ``start``, the row_ordinal of the line that begins their record, and the state ``after`` them.

    The lines are written once: only those of a record that began in an earlier split wait for its start.
    """
    # Both sides are dealt out by their split; paths are larger than their files tell.
    lines = _swapped(lines).join(states.hint("merge"), ["source_file", "block"])
    after = _state(F.col("first_state"), F.col("last_set"), F.col("swaps"))
    lines = lines.withColumn("after", after)
    inside = Window.partitionBy("source_file", "block").orderBy("row_ordinal")
    before = F.coalesce(F.lag("after").over(inside), F.col("first_state"))
    lines = lines.withColumn("begins", F.when(before == 0, F.col("row_ordinal")))
    lines = lines.withColumn("start", F.last("begins", ignorenulls=True).over(inside))
    lines = written(lines.select(*_PLACE, "text", "after", "start"))
    starts = lines.groupBy("source_file", "block").agg(F.max("start").alias("last_start"))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("earlier_start", F.max("last_start").over(earlier)).drop("last_start")
    carried = lines.where("start IS NULL").join(starts, ["source_file", "block"])
    carried = carried.withColumn("start", F.col("earlier_start")).drop("earlier_start")
    return lines.where("start IS NOT NULL").unionByName(carried)


def _whole_records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The records of files with open cells: source_file, row_ordinal, block, cells."""
    placed = _with_starts(lines.withColumn("text", F.coalesce("line", F.array_join("pieces", ","))), states)
    alone = "row_ordinal = start AND after = 0"
    parts = F.array_sort(F.collect_list(F.struct("row_ordinal", "text")))
    joined = placed.where(f"NOT ({alone})").groupBy("source_file", "start").agg(
        F.min("block").alias("block"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")
    )
    single = placed.where(alone).select(*_PLACE, "text")
    records = single.unionByName(joined.withColumnRenamed("start", "row_ordinal"))
    return records.selectExpr(*_PLACE, f"{quoted_cells('text')} AS cells")


def read_records(spark: SparkSession, paths: str | list[str]) -> Records:
    """The records of all files but blank ones, from one scan.

    A file in which a quoted cell never ends has no records and is named in
    ``broken``. Line breaks inside a cell are line feeds. Rows keep the order of
    their file by ``row_ordinal``.
    """
    lines = written(read_lines(spark, paths))
    open_files = written(lines.where("opens").select("source_file").distinct())
    n_open = open_files.count()
    if not n_open:
        return Records(lines.selectExpr(*_PLACE, _CELLS).where(_FILLED), open_files)
    if n_open * _BYTES_PER_NAME <= BROADCAST_BYTES:
        open_files = F.broadcast(open_files)
    open_lines = lines.join(open_files, "source_file", "left_semi")
    states = written(_split_states(open_lines.select(*_PLACE, "opens", "stays")))
    ends = states.groupBy("source_file").agg(F.max_by("last_state", "block").alias("state"))
    broken = written(ends.where("state = 1").select("source_file"))
    glued = written(_whole_records(open_lines.join(broken, "source_file", "left_anti"), states))
    plain = lines.join(open_files, "source_file", "left_anti").selectExpr(*_PLACE, _CELLS)
    return Records(plain.unionByName(glued).where(_FILLED), broken)
