"""Words of packed texts as arrays: where they lie, and hashes of runs of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from devicelog.llm.blocks import SLICE, U64, mixed, widened

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts that lie one after the other."""

    starts: np.ndarray
    ends: np.ndarray
    #: Index of the first word of each document, and one past the last.
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A hash of each word's bytes, the same wherever it stands."""
    values = mixed(np.arange(1, 257, dtype=U64) * U64(_BASE))
    out = np.empty(len(words), dtype=U64)
    # Slices of whole words; a hash does not depend on where its slice begins.
    bounds = np.searchsorted(words.starts, np.arange(0, len(data) + SLICE, SLICE))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            continue
        start = int(words.starts[a])
        size = int(words.ends[b - 1]) - start
        powers = np.cumprod(np.concatenate([[U64(1)], np.full(size, _BASE, dtype=U64)]))
        sums = np.concatenate([[U64(0)], np.cumsum(values[data[start : start + size]] * powers[:-1])])
        back = np.cumprod(np.concatenate([[U64(1)], np.full(size, _INVERSE, dtype=U64)]))
        starts, ends = words.starts[a:b] - start, words.ends[a:b] - start
        out[a:b] = mixed((sums[ends] - sums[starts]) * back[starts])
    return out


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on, as far as there are that many."""
    power, span, out, done = hashes, 1, None, 0
    rest = length
    while rest:
        if rest & 1:
            out = power if out is None else widened(out, power, done, 40 + span)
            done += span
        rest >>= 1
        if rest:
            power = widened(power, power, span, span)
            span *= 2
    return mixed(out.copy())
