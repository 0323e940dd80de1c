"""Incremental loading: every new file in a folder is loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from devicelog.plans.load import load_files
from devicelog.session import few_listing_tasks
from devicelog.sources.csv_files import CSV_FILES, as_path
from devicelog.sources.store import Store

#: Bounds the names on the driver. A load has fixed costs of many jobs, so a folder of small files needs large batches.
FILES_PER_BATCH = 20_000

_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def stream_ingest(
    spark: SparkSession,
    folder: str,
    store_folder: str,
    checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
    identity: str = "name",
) -> StreamingQuery:
    """Load all files not seen before, in micro-batches, then stop.

    The stream carries file names, not contents: a format is elected per whole
    file, so each batch reads its files through the batch loader. The store
    notes which load a batch of this checkpoint is, so a batch that is run again
    replaces what it had written itself, and nothing else. ``identity`` says by what
    the store knows a file (``load_files``).
    """
    store = Store(spark, store_folder)
    few_listing_tasks(spark)
    names = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", CSV_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("source_file"))
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        # At most files_per_batch names.
        paths = [as_path(row.source_file) for row in batch.collect()]
        if paths:
            load_files(spark, paths, store, batch=(checkpoint, batch_id), identity=identity)

    return (
        names.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
