"""Repeated byte strings by prefix-free parsing.

A rolling hash over 36 bytes triggers phrases: each window of ``length`` bytes
belongs to the trigger with the smallest hash inside it, and neighbouring
windows of one trigger make a phrase, the bytes they cover. Neighbours overlap
by ``length - 1`` bytes, so no phrase has to be continued to compare a window,
and equal windows lie in phrases of equal triggers.

The dictionary is the distinct phrases. Occurrences of one phrase are ordered by
(doc_id, start): all but the first are repeats as a whole. The suffixes of the
remaining dictionary phrases of a trigger are sorted up to ``length`` bytes, by
doubling the depth of their ranks, and equal ones are put in corpus order; all
but the first are repeats.

The suffix arrays are kept per trigger and to that depth: the order between
triggers, and of longer suffixes, decides nothing here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from devicelog.llm import blocks as B
from devicelog.llm.sizes import give_back
from devicelog.session import written

TRIGGER = 36
#: Phrases of triggers found at more places are cut into single windows, so that
#: equal ones meet inside the blocks, and each window goes to the bucket of its own
#: bytes, so that no task gets a phrase per document.
HOT = 20_000
#: Bytes of text in a block: a worker holds some thirty times as much for a moment.
BLOCK_BYTES = 3 << 20
U64 = np.uint64


def _byte_hashes() -> np.ndarray:
    return B.mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _trigger_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 36 bytes from each place."""
    values, size = _byte_hashes(), max(0, len(data) - TRIGGER + 1)
    out = np.empty(size, dtype=U64)
    for a in range(0, size, B.SLICE):
        h1 = values[data[a : a + B.SLICE + TRIGGER - 1]]
        h2 = B.widened(h1, h1, 1, 1)
        h4 = B.widened(h2, h2, 2, 2)
        h8 = B.widened(h4, h4, 4, 3)
        h16 = B.widened(h8, h8, 8, 4)
        h32 = B.widened(h16, h16, 16, 5)
        out[a : a + B.SLICE] = B.mixed(B.widened(h32, h4, 32, 6))
    return out


def _parse(block: B.Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Triggers of the windows, their places, all trigger hashes and which windows are whole."""
    size = len(block.data) - length + 1
    if size < 1:
        return None
    valid = block.window_starts(block.bounds, len(block.data) + 1, length)[:size]
    hashes = _trigger_hashes(block.data)
    lowest, chosen = B.anchors(hashes, valid, length - TRIGGER + 1)
    return lowest, chosen, hashes[chosen], valid


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, for fewer than 2**32 keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rises = np.zeros(len(keys), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=rises[1:])
    del ordered
    new = np.empty(len(keys), dtype=np.uint32)
    new[order] = np.cumsum(rises, dtype=np.uint32)
    return new


def _paired(ranks: np.ndarray, others: np.ndarray) -> np.ndarray:
    pairs = ranks.astype(U64)
    pairs <<= U64(32)
    pairs |= others
    return pairs


def suffix_ranks(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``text`` at some places by their first ``depth`` bytes, 8 or more.

    Every suffix has that many bytes. Ranks of depth d give those of up to 2d.
    """
    padded = np.concatenate([text, np.zeros(2 * depth, dtype=np.uint8)])
    words = np.ndarray(len(text) + depth, dtype=">u8", buffer=padded, strides=(1,))
    ranks, reach = _ranked(words.astype(U64)), 8
    while 2 * reach < depth:
        ranks, reach = _ranked(_paired(ranks[:-reach], ranks[reach:])), 2 * reach
    return _ranked(_paired(ranks[at], ranks[at + (depth - reach)]))


def _runs(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of set flags; a place where ``cut`` is set begins anew."""
    before = np.concatenate([[False], flags[:-1]])
    starts = np.flatnonzero(flags & (~before | cut))
    after = np.concatenate([flags[1:], [False]])
    ends = np.flatnonzero(flags & (~after | np.concatenate([cut[1:], [True]]))) + 1
    return starts, ends


def covered_spans(blocks: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """Blocks with ``found``: arrays (start, end) of byte runs that windows of earlier places cover."""

    def anchors_of(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        parsed = _parse(block, length)
        if parsed is None:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        return np.unique(parsed[2], return_counts=True)

    marked = B.repeated_anchors(blocks, anchors_of, hot, 16 << 20)
    n = B.bucket_count(blocks, 3 << 20)

    def emit(_: int, block: B.Block, found: list) -> Iterator[tuple[int, bytes]]:
        shared, is_hot = B.known(found)
        parsed = _parse(block, length) if len(shared) else None
        if parsed is None:
            return
        lowest, places, values, valid = parsed
        at, there = B.place_in(shared, lowest)
        changed = np.concatenate([[True], lowest[1:] != lowest[:-1]])
        starts, ends = _runs(valid & there, changed | (there & is_hot[at] if len(shared) else False))
        # Triggers that lie close to themselves: a phrase may repeat a window of its own.
        order = np.lexsort((places, values))
        near = (np.diff(places[order]) <= 2 * length + 65) & (np.diff(values[order]) == 0)
        inner = np.isin(lowest[starts], values[order][1:][near])
        document = np.searchsorted(block.bounds, starts, side="right") - 1
        owners: dict[bytes, int] = {}
        first, again = [], []
        raw = block.bytes
        for i, (a, b) in enumerate(zip(starts.tolist(), (ends + length - 1).tolist())):
            if owners.setdefault(raw[a:b], i) == i:
                first.append(i)
            else:
                again.append(i)
        again, first = np.array(again, dtype=np.int64), np.array(first, dtype=np.int64)
        if len(again):
            yield -1, B.pack(starts[again], ends[again] + length - 1)
        keys = lowest[starts[first]]
        dealt = keys & U64(0xFFFFFFFF)
        # All windows of a hot trigger are phrases of their own: equal ones still meet.
        single = np.flatnonzero(is_hot[at[starts[first]]])
        own = starts[first][single].tolist()
        dealt[single] = np.array([xxhash.xxh64_intdigest(raw[a : a + length]) & 0xFFFFFFFF for a in own], dtype=U64)
        for b, some in B.by_bucket((dealt % U64(n)).astype(np.int64), n):
            i = first[some]
            text = b"".join(raw[a:z] for a, z in zip(starts[i].tolist(), (ends[i] + length - 1).tolist()))
            yield b, B.pack(
                keys[some], block.ids[document[i]], block.ties[document[i]], starts[i] - block.bounds[document[i]],
                starts[i], (ends[i] - starts[i] + length - 1).astype(np.uint32), inner[i], text,
            )

    def decide(packets: list[tuple[int, list]]) -> Iterator[tuple[int, bytes]]:
        keys, ids, ties, offsets, starts, sizes, inner = (
            np.concatenate([p[k] for _, p in packets]) for k in range(7)
        )
        owner_block = np.repeat([b for b, _ in packets], [len(p[0]) for _, p in packets])
        text = b"".join(p[7] for _, p in packets)
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = ends - sizes
        order = np.lexsort((offsets, ties, ids))
        owners: dict[bytes, int] = {}
        first, again = [], []
        for i, a, b in zip(order.tolist(), begins[order].tolist(), ends[order].tolist()):
            (first if owners.setdefault(text[a:b], i) == i else again).append(i)
        del owners
        first, again = np.array(first, dtype=np.int64), np.array(again, dtype=np.int64)
        spans = [(owner_block[again], starts[again], starts[again] + sizes[again])]
        _, group, members = np.unique(keys[first], return_inverse=True, return_counts=True)
        open_ = first[(members[group] > 1) | inner[first]]
        if len(open_):
            lengths = sizes[open_].astype(np.int64)
            source = np.frombuffer(text, dtype=np.uint8)
            moved = np.cumsum(lengths) - lengths
            phrase = np.repeat(np.arange(len(open_)), lengths)
            within = np.arange(len(phrase)) - moved[phrase]
            dictionary = source[begins[open_][phrase] + within]
            window = within <= lengths[phrase] - length
            at = np.flatnonzero(window)
            _, earliest = np.unique(suffix_ranks(dictionary, at, length), return_index=True)
            repeat = np.ones(len(at), dtype=bool)
            repeat[earliest] = False
            flags = np.zeros(len(dictionary), dtype=bool)
            flags[at[repeat]] = True
            run_starts, run_ends = _runs(flags, within == 0)
            own = open_[phrase[run_starts]]
            begin = starts[own] + within[run_starts]
            spans.append((owner_block[own], begin, begin + (run_ends - run_starts) + length - 1))
        block, begin, end = (np.concatenate([s[k] for s in spans]) for k in range(3))
        for block_id in np.unique(block).tolist():
            mine = block == block_id
            yield block_id, B.pack(begin[mine], end[mine])

    packets = written(B.send(marked, emit))
    local = packets.filter("bucket < 0").select("block_id", "payload")
    answers = B.settle(packets.filter("bucket >= 0"), decide)
    return B.with_found(blocks, local.unionByName(answers))


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts earlier.

    Earlier means a smaller doc_id, or an earlier start in the same document;
    strings are judged on the input and never cross documents. Returns one row
    per input row: doc_id, kept (binary), n_bytes, n_removed, n_spans,
    kept_sha256, and the columns named by ``carry``.

    Null texts are empty, a null doc_id comes before all others, rows that share
    a doc_id are ordered by a hash of their texts (of identical rows one stays
    whole), an empty table gives an empty result. Other columns are ignored,
    whatever their names. ``hot`` decides how phrases are dealt out, not which
    strings are found.
    """
    carry = carry or []
    if length < TRIGGER + 1:
        raise ValueError(f"strings must have more than {TRIGGER} bytes")
    fields = [T.StructField(f"k{i}", docs.schema[name].dataType) for i, name in enumerate(carry)]
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("kept", T.BinaryType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            *fields,
        ]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = B.Block(batch.column(0)[i].as_py())
                change = np.zeros(len(block.data) + 1, dtype=np.int32)
                for start, end in (B.unpack(p) for p in batch.column(1)[i].as_py() or []):
                    np.add.at(change, start, 1)
                    np.add.at(change, end, -1)
                gone = np.cumsum(change[:-1]) > 0
                rows = []
                opens = gone & ~np.concatenate([[False], gone[:-1]])
                for doc_id, a, b in zip(block.ids.tolist(), block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
                    cut = gone[a:b]
                    removed = int(np.count_nonzero(cut))
                    kept = block.data[a:b][~cut].tobytes() if removed else block.bytes[a:b]
                    spans = int(np.count_nonzero(opens[a:b])) + int(removed and cut[0] and not opens[a])
                    rows.append((None if doc_id == B.NULL_ID else doc_id, kept, b - a, removed, spans, hashlib.sha256(kept).hexdigest()))
                out = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                kept_columns = block.carried
                for k in range(len(carry)):
                    out.append(kept_columns.column(f"k{k}").combine_chunks())
                    names.append(f"k{k}")
                yield from pa.Table.from_arrays(out, names=names).to_batches()
                del block, gone, rows, out
                give_back()

    blocks = covered_spans(B.make_blocks(docs, carry, BLOCK_BYTES), length, hot)
    out = blocks.select("data", "found").mapInArrow(finish, schema)
    return out.withColumnsRenamed({f"k{i}": name for i, name in enumerate(carry)})
