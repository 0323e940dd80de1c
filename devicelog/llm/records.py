"""Token ids as files of length-delimited binary records, with an offset index.

A record is
    length of the body          8 bytes, little-endian
    masked CRC-32 of those      4 bytes
    body                        doc_id (8), flags (1), bytes per id (1), ids
    masked CRC-32 of the body   4 bytes
    line feed                   1 byte
The mask rotates a checksum by 15 bits and adds a constant, so that checksums
of data that hold checksums stay useful. The line feed is what Spark's text
writer puts after each row: that writer takes the bytes of a string as they are,
so records reach any file system that Spark writes to, through its committer.
Files follow each other in doc_id order and each holds about ``FILE_BYTES`` of
text. The index is a separate Parquet table with the place of every record.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelog.llm.pieces import Encoder, Ids, slices
from devicelog.llm.sizes import leave, take_up
from devicelog.llm.token_counts import byte_letters
from devicelog.session import shared_folder, small_batches

FILE_BYTES = 24 << 20
_HEAD, _BODY = "<QI", "<qBB"
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    body = struct.pack(_BODY, doc_id or 0, doc_id is None, width) + ids
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body)), b"\n"))


def parse(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length of the record, doc_id and ids of each record of a file; raises ValueError if one is damaged."""
    at = 0
    while at < len(data):
        size, check = struct.unpack_from(_HEAD, data, at)
        if check != masked(data[at : at + 8]) or at + 17 + size > len(data):
            raise ValueError(f"damaged record length at {at}")
        body = data[at + 12 : at + 12 + size]
        if struct.unpack_from("<I", data, at + 12 + size)[0] != masked(body):
            raise ValueError(f"damaged record at {at}")
        doc_id, is_null, width = struct.unpack_from(_BODY, body)
        yield at, size + 17, None if is_null else doc_id, np.frombuffer(body, dtype=f"<u{width}", offset=struct.calcsize(_BODY))
        at += size + 17


def _bytes_of_ids(tokenizer) -> np.ndarray:
    """How many bytes each id stands for: a byte-level vocabulary writes each byte as one character."""
    lengths = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        lengths[i] = len(token)
    return lengths


def _encoder(tokenizer_path: str, end_id: int) -> tuple[Encoder, int]:
    """The encoder of a tokenizer file, and the bytes of an id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.model._resize_cache(0)  # words come once; the cache here has all of them
    width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = f"<u{width}"
    lengths = _bytes_of_ids(tokenizer)
    # The same merges for words that are written as the vocabulary writes bytes.
    merges = Tokenizer(tokenizer.model)
    merges.pre_tokenizer = WhitespaceSplit()
    letters = {byte: letter for letter, byte in byte_letters().items()}

    def many(pieces: list[str]) -> Ids:
        found = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), kind, sizes.sum()), sizes

    def words(some: list[str], blank: bool) -> Ids:
        """Words are encoded a thousand at a time as one text and told apart by their bytes."""
        if tokenizer.normalizer is not None:
            return many([" " * blank + w for w in some])
        ids, sizes, lead = [], [], letters[32] * blank
        for at in range(0, len(some), 1000):
            group = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in some[at : at + 1000]]
            own = np.array(merges.encode_batch_fast([lead + f" {lead}".join(group)], add_special_tokens=False)[0].ids)
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + len(lead))
            sizes.append(np.diff(np.searchsorted(np.cumsum(lengths[own]), ends) + 1, prepend=0))
            ids.append(own.astype(kind))
        return np.concatenate(ids), np.concatenate(sizes)

    return Encoder(words, many, kind), width


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id and ``record`` of each text, in doc_id order over the partitions.

    ``tokenizer_path`` is a file of the tokenizers library that every executor
    has, with a byte-level pre-tokenizer. Strings of special tokens in a text become
    those tokens, as the library has it by default. Ids take two bytes if the vocabulary allows, else four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = take_up(key, lambda: _encoder(tokenizer_path, end_id))
        end = end_id.to_bytes(width, "little")
        gc.disable()  # hundreds of thousands of cached strings hold no cycles
        for whole in batches:
            for batch in slices(whole, 1):
                ids, sizes = encoder.batch(batch.column(1))
                raw, ends = ids.tobytes(), (np.cumsum(sizes) * width).tolist()
                records = [frame(i, raw[x:y] + end, width)[:-1] for i, x, y in zip(batch.column(0).to_pylist(), [0, *ends], ends)]
                columns = [batch.column(0), pa.array(records, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "record"])
        gc.enable()
        leave(key, (encoder, width))

    key = ("records.encode", tokenizer_path, end_id)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Ranges also go by a hash of the texts, so that rows of one id, or without one, are many tasks.
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = chosen.repartitionByRange(int(size // FILE_BYTES) + 1, *order[:2]).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "doc_id long, record binary")


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write every text's ids to files below ``path``; an empty table gives a folder without records."""
    encode(docs, tokenizer_path, end_id).select(F.col("record").cast("string")).write.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records read back: file, ordinal, offset, size, doc_id, n_tokens, ids_crc32, ids (4-byte little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "ordinal", "offset", "size", "doc_id", "n_tokens", "ids_crc32", "ids"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for k, (offset, size, doc_id, ids) in enumerate(parse(data.as_py())):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((name, k, offset, size, doc_id, len(ids), zlib.crc32(raw), raw))
                    held += len(raw)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = "file string, ordinal long, offset long, size long, doc_id long, n_tokens long, ids_crc32 long, ids binary"
    return named.mapInArrow(run, schema)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """The offset index of the files below ``path``: a row for each record, with ``start``, the ids before it.

    Ids before a file are summed over blocks of files, then within a block, so no
    task gets a row for every file.
    """
    read_records(spark, path).drop("ids").write.parquet(index_path)
    index = spark.read.parquet(index_path)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("place", number)
    files = files.withColumn("block", F.floor(F.col("place") / 4096))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(blocks, "block").select(
        "file", (F.col("block_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("file_start")
    )
    own = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(starts, "file").select(
        *index.columns, (F.col("file_start") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("start")
    )


def shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """Records in a random order that ``seed`` fixes, cut out of the files by the index: doc_id, ids (4-byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, offset, size, order in zip(*(batch.column(k) for k in range(4))):
                at = offset.as_py()
                (_, _, doc_id, ids) = next(parse(data.as_py()[at : at + size.as_py()]))
                rows.append((order.as_py(), doc_id, ids.astype("<u4").tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["shuffle_key", "doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    key = F.xxhash64(F.lit(seed), "file", "ordinal").alias("shuffle_key")
    places = index.select("file", "offset", "size", key)
    cut = files.join(places, "file").select(
        F.substring("content", F.col("offset") + 1, F.col("size")).alias("content"), F.lit(0).alias("offset"), "size", "shuffle_key"
    )
    schema = "shuffle_key long, doc_id long, ids binary"
    return cut.mapInArrow(run, schema).orderBy("shuffle_key").select("doc_id", "ids")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write records and index to the shared folder and return the index.

    Columns: file, ordinal, offset, size, doc_id, n_tokens, ids_crc32, start.
    Null texts are empty and give the end id alone, null ids come first, repeated
    rows stay, other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark)
    write_records(docs, f"{folder}/records", tokenizer_path, end_id)
    return write_index(spark, f"{folder}/records", f"{folder}/index")
