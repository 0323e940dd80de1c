"""Long repeated word spans by compaction of a De Bruijn graph.

A window of ``length`` words is an edge between its first and its last
``length - 1`` words, the nodes. Only windows whose anchor (the smallest hash of
six words inside) lies in two documents can repeat; they are the edges looked at.
A node is passed through if every occurrence of it comes from one and the same
word and goes on to one and the same word. Edges joined by such nodes make one
unbranched path, and wherever one of its edges occurs, the whole path does. So
each path is compared as one item, by its words in the source, and the smallest
doc_id that holds it decides for all of its windows.
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
from devicelog.llm.words import find_words, run_hashes, word_hashes
from devicelog.session import written

ANCHOR = 6
U64, U32 = np.uint64, np.uint32


def _edges(block: B.Block, length: int):
    """Words, their hashes, and the windows' validity, anchors and the anchors' places."""
    words = find_words(block.data, block.bounds)
    size = len(words) - length + 1
    if size < 1:
        return None
    hashes = word_hashes(block.data, words)
    valid = block.window_starts(words.bounds, len(words) + 1, length)[:size]
    small = run_hashes(hashes, ANCHOR)
    lowest, chosen = B.anchors(small, valid, length - ANCHOR + 1)
    return words, hashes, valid, lowest, chosen, small


def _distinct(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, whether any of the values differs within a key, and the values of each key's first."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    differs = np.zeros(len(first), dtype=bool)
    group = np.cumsum(new) - 1
    for v in values:
        v = v[order]
        np.logical_or.at(differs, group, v != v[first][group])
    return ordered[first], differs, [v[order][first] for v in values]


def _paths(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([[False], flags[:-1]])
    after = np.concatenate([flags[1:], [False]])
    starts = np.flatnonzero(flags & (~before | cut))
    ends = np.flatnonzero(flags & (~after | np.concatenate([cut[1:], [True]]))) + 1
    return starts, ends


def _candidates(block: B.Block, shared: np.ndarray, length: int):
    """Words, their hashes, which windows have a shared anchor, and the nodes."""
    words, hashes, valid, lowest, _, _ = _edges(block, length)
    return words, hashes, valid & B.place_in(shared, lowest)[1], run_hashes(hashes, length - 1)


def _said(found: list, kind: bytes) -> list:
    return [f for f in found if isinstance(f[0], bytes) and f[0] == kind]


def _paths_of(block: B.Block, found: list, length: int):
    """Words, starts and ends (in windows), doc_ids and keys of a block's paths, by the answers that it got."""
    shared = [f for f in found if not isinstance(f[0], bytes)]
    if not shared:
        return None
    words, _, flags, nodes = _candidates(block, B.known(shared)[0], length)
    breaks = np.sort(np.concatenate([np.zeros(0, dtype=U64), *[f[1] for f in _said(found, b"node")]]))
    starts, ends = _paths(flags, B.place_in(breaks, nodes[: len(flags)])[1])
    if not len(starts):
        return None
    ids = block.ids[np.searchsorted(words.bounds, starts, side="right") - 1]
    raw = block.bytes
    digests = b"".join(
        xxhash.xxh3_128_digest(b" ".join(raw[a:b].split()))
        for a, b in zip(words.starts[starts].tolist(), words.ends[ends + length - 2].tolist())
    )
    return words, starts, ends, ids, np.frombuffer(digests, dtype=U64).reshape(-1, 2)


def repeated_paths(blocks: DataFrame, length: int = 13) -> DataFrame:
    """Blocks with ``found``: shared anchors and branching nodes, from which a block makes its paths again
    (they would be more bytes than the texts), and (key, key, smallest doc_id) for paths that a smaller doc_id holds."""

    def anchors_of(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        found = _edges(block, length)
        if found is None:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        words, _, _, _, chosen, small = found
        document = np.searchsorted(words.bounds, chosen, side="right") - 1
        order = np.lexsort((document, small[chosen]))
        key, document = small[chosen][order], document[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (document[1:] != document[:-1])])[: len(key)]
        return np.unique(key[new], return_counts=True)

    marked = written(B.repeated_anchors(blocks, anchors_of, 2**62, 16 << 20).withColumnRenamed("found", "anchors"))
    n = B.bucket_count(blocks, 8 << 20)

    def emit_nodes(_: int, block: B.Block, found: list) -> Iterator[tuple[int, bytes]]:
        if not found:
            return
        _, hashes, flags, nodes = _candidates(block, B.known(found)[0], length)
        into, out_of = np.zeros(len(nodes), dtype=U32), np.zeros(len(nodes), dtype=U32)
        at = np.flatnonzero(flags)
        into[at + 1] = (hashes[at] >> U64(32)).astype(U32) | U32(1)
        out_of[at] = (hashes[at + length - 1] >> U64(32)).astype(U32) | U32(1)
        node = np.zeros(len(nodes), dtype=bool)
        node[at] = node[at + 1] = True
        at = np.flatnonzero(node)
        keys, differs, (into, out_of) = _distinct(nodes[at], into[at], out_of[at])
        for b, some in B.by_bucket(((keys & U64(0xFFFFFFFF)) % U64(n)).astype(np.int64), n):
            yield b, B.pack(keys[some], differs[some], into[some], out_of[some])

    def branching(packets: list[tuple[int, list]]) -> Iterator[tuple[int, bytes]]:
        keys, differs, into, out_of = (np.concatenate([p[k] for _, p in packets]) for k in range(4))
        distinct, other, _ = _distinct(keys, into, out_of)
        place = np.searchsorted(distinct, keys)
        np.logical_or.at(other, place, differs)
        at = 0
        for block_id, packet in packets:
            own = place[at : at + len(packet[0])]
            at += len(packet[0])
            if other[own].any():
                yield block_id, B.pack(b"node", packet[0][other[own]])

    nodes = B.settle(B.send(marked.withColumnRenamed("anchors", "found"), emit_nodes), branching)
    both = "concat(coalesce({}, array()), coalesce(found, array())) AS found"
    asked = B.with_found(marked, nodes).selectExpr("block_id", "data", both.format("anchors"))

    def emit_paths(_: int, block: B.Block, found: list) -> Iterator[tuple[int, bytes]]:
        own_paths = _paths_of(block, found, length)
        if own_paths is None:
            return
        _, _, _, ids, keys = own_paths
        order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
        k, d = keys[order], ids[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(k)]]) - 1
        for b, some in B.by_bucket(((k[first, 0] & U64(0xFFFFFFFF)) % U64(n)).astype(np.int64), n):
            yield b, B.pack(k[first[some], 0], k[first[some], 1], d[first[some]], d[last[some]])

    def earliest(packets: list[tuple[int, list]]) -> Iterator[tuple[int, bytes]]:
        low, high, smallest = (np.concatenate([p[k] for _, p in packets]) for k in range(3))
        order = np.lexsort((smallest, high, low))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
        group = np.empty(len(low), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        least = smallest[order][np.flatnonzero(new)]
        at = 0
        for block_id, (a, b, _, largest) in packets:
            own = least[group[at : at + len(a)]]
            at += len(a)
            hit = own < largest
            if hit.any():
                yield block_id, B.pack(b"least", a[hit], b[hit], own[hit])

    answers = B.settle(B.send(asked, emit_paths), earliest)
    return B.with_found(asked.withColumnRenamed("found", "asked"), answers).selectExpr("block_id", "data", both.format("asked"))


def _covered(block: B.Block, found: list, length: int) -> np.ndarray | None:
    """The words that a repeated window covers, None if there are none."""
    least = _said(found, b"least")
    own_paths = _paths_of(block, found, length) if least else None
    if own_paths is None:
        return None
    words, starts, ends, ids, keys = own_paths
    known_low, known_high, smallest = (np.concatenate([f[k] for f in least]) for k in (1, 2, 3))
    both = np.zeros(len(known_low), dtype=[("a", U64), ("b", U64)])
    both["a"], both["b"] = known_low, known_high
    order = np.argsort(both)
    own = np.zeros(len(keys), dtype=both.dtype)
    own["a"], own["b"] = keys[:, 0], keys[:, 1]
    at = np.minimum(np.searchsorted(both[order], own), len(order) - 1)
    hit = (both[order][at] == own) & (smallest[order][at] < ids)
    change = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(change, starts[hit], 1)
    np.add.at(change, ends[hit] + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeated_words(docs: DataFrame, length: int = 13, carry: list[str] | None = None) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts in a smaller doc_id.

    Windows are judged on the input. Returns one row per input row: doc_id,
    kept (the kept words joined by one space, binary), n_words, n_removed,
    kept_sha256 and the columns named by ``carry``.

    Null texts have no words; a null doc_id is smaller than all others; rows
    that share a doc_id do not count as earlier than each other, so equal rows
    stay; an empty table gives an empty result; other columns are ignored.
    Two continuations of a node are told apart by 31 bits of a word hash: of
    ten billion nodes with two continuations about five would be missed.
    """
    carry = carry or []
    if length <= ANCHOR:
        raise ValueError(f"windows must have more than {ANCHOR} words")
    fields = [T.StructField(f"k{i}", docs.schema[name].dataType) for i, name in enumerate(carry)]
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("kept", T.BinaryType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            *fields,
        ]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = B.Block(batch.column(0)[i].as_py())
                words = find_words(block.data, block.bounds)
                gone = _covered(block, [B.unpack(p) for p in batch.column(1)[i].as_py() or []], length)
                if gone is None:
                    gone = np.zeros(len(words), dtype=bool)
                rows = []
                for doc_id, text, a, b in zip(block.ids.tolist(), block.texts(), words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    cut = gone[a:b]
                    removed = int(np.count_nonzero(cut))
                    own = text.split()
                    if removed:
                        own = [own[k] for k in np.flatnonzero(~cut).tolist()]
                    kept = b" ".join(own)
                    rows.append((None if doc_id == B.NULL_ID else doc_id, kept, b - a, removed, hashlib.sha256(kept).hexdigest()))
                out = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()))]
                names = ["doc_id", "kept", "n_words", "n_removed", "kept_sha256"]
                for k in range(len(carry)):
                    out.append(block.carried.column(f"k{k}").combine_chunks())
                    names.append(f"k{k}")
                yield from pa.Table.from_arrays(out, names=names).to_batches()
                del block, gone, rows, out
                give_back()

    blocks = repeated_paths(B.make_blocks(docs, carry), length)
    out = blocks.select("data", "found").mapInArrow(finish, schema)
    return out.withColumnsRenamed({f"k{i}": name for i, name in enumerate(carry)})
