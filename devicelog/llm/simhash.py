"""Near-duplicates by SimHash fingerprints and Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last is
filled up with zeros). The binary Golay code of length 23 corrects three errors,
so each 23-bit word lies near one codeword; a word at distance 3 from its
codeword is also at distance 4 from five others. With these up to six codeword
indices as keys, two words that differ in at most one bit share a key.

Of three differing bits over three segments, either a segment has none and
another at most one (the first segment as it is, with a Golay key of the second),
or each has exactly one (Golay keys of the first two, with the half of the third
that is alike). Fingerprints that share such a key of 33 or more bits are
compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.llm.components import components
from devicelog.llm.sizes import give_back, measured
from devicelog.session import written

MAX_BITS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: The Golay code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``fp``, the SimHash of the word shingles as a signed long.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words
    than a shingle is one shingle, a null text or one without words has 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[bytes] = []
            counts = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.translate(_LOWER).split() if text else []
                joined = b" ".join(words)
                if len(words) <= shingle:
                    counts.append(1 if words else 0)
                    if words:
                        hashes.append(xxhash.xxh64_digest(joined, 42))
                    continue
                ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
                starts = np.concatenate([[0], ends[:-1]])
                last = (ends[shingle - 1 :] - 1).tolist()
                counts.append(len(last))
                parts = [joined[a:b] for a, b in zip(starts.tolist(), last)]
                hashes.append(b"".join(map(xxhash.xxh64_digest, parts, repeat(42))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_majority(b"".join(hashes), np.array(counts)), pa.int64())], names=["doc_id", "fp"]
            )
        hashes = counts = None
        give_back()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def _majority(digests: bytes, counts: np.ndarray) -> np.ndarray:
    """A bit is set if over half of a document's hashes have it; digests are big-endian."""
    hashes = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    out = np.zeros(len(counts), dtype=">u8")
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
        if b > a:
            set_bits = np.zeros(64, dtype=np.int64)
            for k in range(a, b, 65_535):
                set_bits += np.add.reduce(np.unpackbits(hashes[k : min(b, k + 65_535)], axis=1), axis=0, dtype=np.uint16)
            out[i] = np.packbits(set_bits * 2 > b - a).view(">u8")[0]
    return out.astype(np.uint64).view(np.int64)


class Golay:
    """Tables of the binary [23, 12, 7] code, made from its generator polynomial."""

    def __init__(self) -> None:
        data = np.arange(4096, dtype=np.int64) << 11
        self.codewords = np.sort(data ^ self.syndromes(data))
        weights = np.bitwise_count(self.codewords)
        errors = [0]
        bits = [1 << i for i in range(23)]
        errors += bits
        errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
        errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        errors = np.array(errors, dtype=np.int64)
        self.error = np.zeros(2048, dtype=np.int64)
        self.error[self.syndromes(errors)] = errors
        # For each error of three bits: the five codewords of weight 7 that contain it.
        self.around = np.full((2048, 5), -1, dtype=np.int64)
        sevens = self.codewords[weights == 7]
        triples = errors[np.bitwise_count(errors) == 3]
        row, column = np.nonzero((sevens[None, :] & triples[:, None]) == triples[:, None])
        self.around[self.syndromes(triples)] = sevens[column].reshape(len(triples), 5)

    @staticmethod
    def syndromes(words: np.ndarray) -> np.ndarray:
        """Remainders of words as polynomials, divided by the generator."""
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where((rest >> bit) & 1 == 1, rest ^ (_GENERATOR << (bit - 11)), rest)
        return rest

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Six columns of codeword indices (the codeword's 12 data bits) for each word; -1 where there is none."""
        syndrome = self.syndromes(words)
        nearest = words ^ self.error[syndrome]
        near = self.around[syndrome]
        further = np.where(near >= 0, (nearest[:, None] ^ near) >> 11, -1)
        return np.concatenate([(nearest >> 11)[:, None], further], axis=1)


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints: places in ``fps`` and keys, such that any two with three differing bits share one."""
    words = fps.astype(np.uint64)
    segments = [((words >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in _SEGMENTS]
    indices = [code.indices(s) for s in segments]
    places, keys = [], []

    def add(kind: int, *parts: tuple[np.ndarray, int]) -> None:
        key = np.full(len(words), kind, dtype=np.int64)
        there = np.ones(len(words), dtype=bool)
        for value, bits in parts:
            there &= value >= 0
            key = (key << bits) | np.maximum(value, 0)
        places.append(np.flatnonzero(there))
        keys.append(key[there])

    for i in range(3):
        for j in range(3):
            for k in range(6 if i != j else 0):
                add(3 * i + j, (segments[i], 23), (indices[j][:, k], 12))
    for a in range(6):
        for b in range(6):
            for half in range(2):
                alike = (segments[2] >> (9 * half)) & 511
                add(9 + half, (indices[0][:, a], 12), (indices[1][:, b], 12), (alike, 9))
    return np.concatenate(places), np.concatenate(keys)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct fingerprints in column ``fp`` that differ in one to three bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            places, keys = golay_keys(values, code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[places])], names=["key", "fp"])
        give_back()

    keyed = fps.select("fp").mapInArrow(run, "key long, fp long")
    a, b = keyed.select("key", F.col("fp").alias("u")), keyed.select("key", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    # Spark takes the keys for as many rows as there are fingerprints; they are about a hundred times as many.
    return a.hint("merge").join(b.hint("merge"), (a.key == b.key) & near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_links of every document.

    Documents link if their fingerprints differ in at most three bits; the
    component is the smallest doc_id reachable over links, itself included.
    n_links counts the other fingerprints that a document's fingerprint links to.
    Documents of one fingerprint are linked without comparing them. Null texts
    have fingerprint 0; a null doc_id never names a component unless all of its
    members have none; an empty table gives an empty result; other columns are
    ignored; repeated rows stay.
    """
    prints = written(fingerprints(docs, shingle))
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = written(links(groups))
    reached = components(pairs)
    of = groups.join(reached, groups.fp == reached.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    named = of.join(least, "root").join(degree, "fp", "left").select("fp", "component_id", "n_links")
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component."""
    return without_later(docs, near_duplicates(docs, shingle).select("doc_id", "component_id"))


def without_later(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without those whose component_id in ``found`` is another doc_id.

    Equal rows count as one. Of rows that share the smallest doc_id all stay if
    they differ; rows without a doc_id cannot be named by a decision and stay.
    """
    found = written(found)
    # A shuffled join would move all texts.
    drop = measured(found.filter("doc_id <> component_id").select("doc_id").distinct(), "8")
    kept = docs.join(drop, "doc_id", "left_anti").select(docs.columns)
    rows, distinct = found.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return kept.distinct() if rows > distinct else kept
