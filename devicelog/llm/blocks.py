"""Documents packed into blocks, and packed exchanges between blocks and buckets.

Counting every window of every text as a row of its own would move many times
the size of the input. Here some megabytes of texts make a block, which is
written once. A block sends each distinct key once, with the other keys of its
bucket in one packed row, so a key that a third of all documents hold still
arrives as one entry per block. Buckets grow in number with the input, and what
a bucket finds out returns to the blocks that asked.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.llm.sizes import give_back
from devicelog.session import written

BLOCK_BYTES = 4 << 20
#: Arrays over a block are made in slices of so many items, so that steps in between stay small.
SLICE = 1 << 18
#: Packets of a block that are handed over together, in bytes.
PACKET_BYTES = 1 << 20
#: Returned keys are broadcast to the blocks up to this measured size; above it, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: Stands for a null doc_id, which comes before all others.
NULL_ID = -(2**63)

U64 = np.uint64


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [(a.dtype.str, a.tobytes()) if isinstance(a, np.ndarray) else a for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def unpack(payload: bytes) -> list[np.ndarray | bytes]:
    parts = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
    return [np.frombuffer(p[1], dtype=p[0]) if isinstance(p, tuple) else p for p in parts]


class Block:
    """Texts of some documents in the order of (doc_id, text hash).

    ``data`` has their UTF-8 bytes one after the other, ``bounds`` where each
    begins and ends, ``carried`` the other columns as an Arrow batch.
    """

    def __init__(self, payload: bytes):
        self.ids, self.ties, lengths, data, carried = unpack(payload)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.bytes = data
        self.data = np.frombuffer(data, dtype=np.uint8)
        self._carried = carried

    @property
    def carried(self) -> pa.Table | None:
        return pa.ipc.open_stream(self._carried).read_all() if self._carried else None

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            yield self.bytes[a:b]

    def window_starts(self, bounds: np.ndarray, size: int, width: int) -> np.ndarray:
        """Whether ``width`` items from each of ``size`` places stay inside one document."""
        change = np.zeros(size + 1, dtype=np.int32)
        starts, ends = bounds[:-1], bounds[1:] - width + 1
        fits = ends > starts
        np.add.at(change, starts[fits], 1)
        np.add.at(change, ends[fits], -1)
        return np.cumsum(change[:-1], dtype=np.int32) > 0


def make_blocks(docs: DataFrame, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` as blocks: block_id, raw_bytes, data.

    Null texts are empty, null ids come first, repeated rows stay. ``carry``
    names columns to keep beside the texts. A longer text makes a block alone.
    """
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes, int, int]] = []
        sources: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, sources, size, made
            held.sort(key=lambda row: row[:2])
            kept = b""
            if carry:
                starts = np.cumsum([0, *[s.num_rows for s in sources]])
                table = pa.Table.from_batches(sources).select([f"k{i}" for i in range(len(carry))])
                table = table.take(pa.array([int(starts[row[3]]) + row[4] for row in held]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table.combine_chunks())
                kept = sink.getvalue().to_pybytes()
            payload = pack(
                np.array([row[0] for row in held], dtype=np.int64),
                np.array([row[1] for row in held], dtype=np.uint64),
                np.array([len(row[2]) for row in held], dtype=np.int64),
                b"".join(row[2] for row in held),
                kept,
            )
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | made], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                names=["block_id", "raw_bytes", "data"],
            )
            held, sources, size, made = [], [], 0, made + 1
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            sources.append(batch)
            for i, (doc_id, text) in enumerate(zip(ids, batch.column(1).cast(pa.binary()).to_pylist())):
                text = text or b""
                held.append((NULL_ID if doc_id is None else doc_id, xxhash.xxh3_64_intdigest(text), text, len(sources) - 1, i))
                size += len(text)
                if size >= block_bytes:
                    yield flush()
                    sources = [batch]
        if held:
            yield flush()
        give_back()

    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    chosen += [F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(carry)]
    return written(docs.select(*chosen).mapInArrow(run, "block_id long, raw_bytes long, data binary"))


def bucket_count(blocks: DataFrame, bytes_each: int) -> int:
    """A number of buckets that grows with the texts."""
    total = blocks.agg(F.sum("raw_bytes")).first()[0] or 0
    return int(total // bytes_each) + 1


def send(
    blocks: DataFrame, emit: Callable[[int, Block, list], Iterable[tuple[int, bytes]]]
) -> DataFrame:
    """Rows (bucket, block_id, payload) that ``emit(block_id, block, found)`` makes of each block."""
    has_found = "found" in blocks.columns

    def rows_of(block_id: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([block_id] * len(rows), pa.int64())]
        columns.append(pa.array([r[1] for r in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "block_id", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block_id = batch.column(0)[i].as_py()
                found = [unpack(p) for p in (batch.column(2)[i].as_py() or [])] if has_found else []
                rows, held = [], 0
                for row in emit(block_id, Block(batch.column(1)[i].as_py()), found):
                    rows.append(row)
                    held += len(row[1])
                    if held >= PACKET_BYTES:
                        yield rows_of(block_id, rows)
                        rows, held = [], 0
                if rows:
                    yield rows_of(block_id, rows)
                rows = found = None
                give_back()

    columns = ["block_id", "data", *(["found"] if has_found else [])]
    return blocks.select(*columns).mapInArrow(run, "bucket int, block_id long, payload binary")


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket's items."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def settle(packets: DataFrame, decide: Callable[[list[tuple[int, list]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Bring each bucket's packets together; ``decide`` answers with rows (block_id, payload)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("block_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        payloads = table.column("payload")
        rows = list(decide([(ids[i], unpack(payloads[i].as_py())) for i in order]))
        give_back()
        return pa.table(
            {"block_id": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())}
        )

    return packets.groupBy("bucket").applyInArrow(run, "block_id long, payload binary")


def with_found(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with the list ``found`` of its answers, which are written first and measured."""
    found = answers.groupBy("block_id").agg(F.collect_list("payload").alias("found"))
    found = written(found)
    size = found.agg(F.sum(F.expr("aggregate(found, 0L, (n, x) -> n + length(x))"))).first()[0] or 0
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("merge")
    return blocks.join(side, "block_id", "left")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def widened(h: np.ndarray, other: np.ndarray, shift: int, salt: int) -> np.ndarray:
    """Hash of a run from the hash of its first items and that of the items ``shift`` further on."""
    size = len(other) - shift
    return h[: max(size, 0)] * U64((2 * salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1) | 1) + other[shift:]


def sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` over each ``width`` neighbours, from the first of them on."""
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[:-rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of ``width`` hashes for each window, and where one of a valid window lies.

    Equal windows have equal smallest hashes, whatever surrounds them.
    """
    size, windows = len(hashes), len(hashes) - width + 1
    lowest = np.empty(windows, dtype=U64)
    for a in range(0, windows, SLICE):
        b = min(windows, a + SLICE)
        lowest[a:b] = sliding(np.minimum, hashes[a : b + width - 1], width)
    chosen = []
    for a in range(0, size, SLICE):
        b = min(size, a + SLICE)
        # The windows that hold one of these places; there are none before the first and after the last.
        first, last = max(0, a - width + 1), min(windows, b)
        held = np.zeros(b - a + width - 1, dtype=U64)
        start = first - (a - width + 1)
        held[start : start + last - first] = np.where(valid[first:last], lowest[first:last], U64(0))
        own = hashes[a:b]
        chosen.append(a + np.flatnonzero((sliding(np.maximum, held, width) == own) & (own != 0)))
    return lowest, np.concatenate(chosen)


def repeated_anchors(
    blocks: DataFrame, anchors_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], hot: int, bytes_each: int
) -> DataFrame:
    """Blocks with the anchors they share: found has arrays (anchor, whether over ``hot`` places have it).

    ``anchors_of`` gives a block's distinct anchors and at how many places (or
    documents) each lies; an anchor counts as shared from two places on.
    """
    n = bucket_count(blocks, bytes_each)

    def emit(_: int, block: Block, __: list) -> Iterator[tuple[int, bytes]]:
        keys, counts = anchors_of(block)
        for b, at in by_bucket(((keys & U64(0xFFFFFFFF)) % U64(n)).astype(np.int64), n):
            yield b, pack(keys[at], counts[at].astype(np.uint32))

    def decide(packets: list[tuple[int, list]]) -> Iterator[tuple[int, bytes]]:
        _, place = np.unique(np.concatenate([p[0] for _, p in packets]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([p[1] for _, p in packets]))
        at = 0
        for block_id, (keys, _) in packets:
            own = total[place[at : at + len(keys)]]
            at += len(keys)
            shared = own >= 2
            if shared.any():
                yield block_id, pack(keys[shared], own[shared] > hot)

    return with_found(blocks, settle(send(blocks, emit), decide))


def known(found: list) -> tuple[np.ndarray, np.ndarray]:
    """The answers of all buckets as one sorted array of keys and what was said of them."""
    if not found:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
    keys, said = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(keys)
    return keys[order], said[order]


def place_in(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted ``keys`` each value is, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at, there = np.empty(len(values), dtype=np.int32), np.empty(len(values), dtype=bool)
    for a in range(0, len(values), SLICE):
        own = values[a : a + SLICE]
        at[a : a + SLICE] = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        there[a : a + SLICE] = keys[at[a : a + SLICE]] == own
    return at, there
