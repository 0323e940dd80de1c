"""Texts cut into pieces that a byte-level tokenizer treats independently, and a bounded cache of their ids.

The public patterns never match a character of a word and a blank after it
together, so a text may be cut before each blank that follows another
character, between a letter or digit and a full stop or comma, between those
and a blank, and between an ASCII letter and an ASCII mark. Words repeat, so most
ids come from the cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = re.compile(r" ?[^\W_]++(?=[.,\s]|\Z)|[.,]++(?=\s|\Z)|\n(?=\S)| ?[A-Za-z]++(?=[!-/:-@\[-`{-~])| ?\S++|\s++\S*+")

#: A Latin letter, a full stop or comma, and a blank or line feed; before the mark, which then stands in a part of its own.
_MARK = "\x1f"
_MARKED = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,])([ \n])"


def split(text: str) -> list[str]:
    return _PIECE.findall(text)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of up to 4000 rows and about ``most`` bytes of a column of strings or bytes, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > most or i - start == 4000):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


#: In place of the row of a part: it is not known, or no cut may follow it as it ends in white space.
_NEW, _OPEN = -1, -2
#: Ids one behind the other, and how many each text or piece has.
Ids = tuple[np.ndarray, np.ndarray]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts``, ``starts`` + 1 and so on, ``sizes`` of each."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def with_room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """An array with room for ``more`` entries behind those in use."""
    if used + more <= len(array):
        return array
    larger = np.empty(max(used + more, 2 * len(array)), array.dtype)
    larger[:used] = array[:used]
    return larger


class _Rows:
    """Ids of many pieces in one array; a piece is known by its row."""

    def __init__(self, kind: str):
        self._ids = np.empty(1 << 16, dtype=kind)
        self._starts = np.zeros(1 << 14, dtype=np.int64)  # and the end of the last row
        self.n = 0

    def add(self, found: Ids) -> range:
        ids, sizes = found
        first, end = self.n, int(self._starts[self.n])
        self._ids = with_room(self._ids, end, len(ids))
        self._ids[end : end + len(ids)] = ids
        self._starts = with_room(self._starts, first + 1, len(sizes))
        self._starts[first + 1 : first + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.n += len(sizes)
        return range(first, self.n)

    def joined(self, rows: np.ndarray, groups: np.ndarray) -> Ids:
        """The ids of rows one behind the other, and how many there are in each group of so many rows."""
        starts = self._starts[rows]
        sizes = self._starts[rows + 1] - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(groups)]
        return self._ids[spread(starts, sizes)], np.diff(ends, prepend=0)


class Encoder:
    """Ids of texts, as numbers of the numpy type ``kind``.

    ``encode_words`` gives the ids of words of letters, each after a blank or none
    of them; ``encode`` those of any pieces without a cut inside. When the caches
    hold ``limit`` entries, what came in one batch only goes; that changes no id.
    """

    def __init__(
        self,
        encode_words: Callable[[list[str], bool], Ids],
        encode: Callable[[list[str]], Ids],
        kind: str = "<u4",
        limit: int = 500_000,
    ):
        self._encode_words, self._encode, self._kind, self._limit = encode_words, encode, kind, limit
        #: Rows of a blank and a part, or ``_OPEN``, and of pieces.
        self._parts: dict[str, int] = {}
        self._pieces: dict[str, int] = {}
        self._rows = _Rows(kind)
        #: Whether a row came in another batch than the one that it was learned in.
        self._again = np.zeros(1 << 14, dtype=bool)

    def _make_room(self) -> None:
        """Drop the pieces, and the parts that did not come again; all of them, if most did."""
        again = self._again[: self._rows.n]
        kept = {p: row for p, row in self._parts.items() if row >= 0 and again[row]} if 2 * again.sum() < self._limit else {}
        old, self._rows = self._rows, _Rows(self._kind)
        rows = np.fromiter(kept.values(), np.int64, len(kept))
        self._parts = dict(zip(kept, self._rows.add(old.joined(rows, np.ones_like(rows)))))
        self._pieces = {}
        self._again[:] = False

    def batch(self, texts: pa.Array) -> Ids:
        if len(self._parts) + len(self._pieces) > self._limit:
            self._make_room()
        texts = texts.fill_null("")
        split_up = pc.split_pattern(pc.replace_substring_regex(texts, _MARKED, rf"\1 {_MARK}\2\3"), " ")
        sizes = pc.list_value_length(split_up).to_numpy().astype(np.int64)
        coded = split_up.flatten().dictionary_encode()
        strings, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        inner = np.ones(len(index), dtype=bool)  # parts after a blank
        inner[np.cumsum(sizes) - sizes] = False
        begins = [strings[i] for i in index[~inner].tolist()]
        index = index[inner]
        wanted = np.zeros(len(strings), dtype=bool)
        wanted[index] = True
        row_of = np.fromiter(map(self._parts.get, strings, repeat(_NEW)), np.int64, len(strings))
        self._again[row_of[wanted & (row_of >= 0)]] = True
        new = np.flatnonzero(wanted & (row_of == _NEW)).tolist()
        passing = self._learn([strings[i] for i in new])
        row_of[new] = [self._parts.get(strings[i], _NEW) for i in new]

        # No cut may follow a part that ends in white space: such texts are cut as a whole, and those that hold our mark.
        owner = np.repeat(np.arange(len(sizes)), sizes - 1)
        whole = np.fromiter((s != "" and s[-1].isspace() for s in begins), bool, len(begins))
        whole[owner[row_of[index] == _OPEN]] = True
        whole |= pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole).tolist():
            begins[i] = texts[i].as_py()
        begins = [split(s) for s in begins]
        self._learn_pieces(chain.from_iterable(begins))

        kept = self._rows.n
        found = dict(zip(passing, self._join(passing.values())))
        at = [i for i in new if row_of[i] == _NEW]
        row_of[at] = [found[strings[i]] for i in at]
        heads = np.fromiter(map(len, begins), np.int64, len(begins))
        tails = np.where(whole, 0, sizes - 1)
        ends = np.cumsum(heads + tails)
        rows = np.empty(ends[-1] if len(ends) else 0, dtype=np.int64)
        rows[spread(ends - tails - heads, heads)] = [self._pieces[p] for own in begins for p in own]
        rows[spread(ends - tails, tails)] = row_of[index[~whole[owner]]]
        out = self._rows.joined(rows, heads + tails)
        self._rows.n = kept
        if len(self._again) < kept:
            self._again = np.concatenate([self._again, np.zeros(kept, dtype=bool)])
        return out

    def _join(self, sequences: Iterable[Iterable[int]]) -> range:
        """New rows, each of some rows one behind the other."""
        sequences = list(sequences)
        groups = np.fromiter(map(len, sequences), np.int64, len(sequences))
        rows = np.fromiter(chain.from_iterable(sequences), np.int64, groups.sum())
        return self._rows.add(self._rows.joined(rows, groups))

    def _learn(self, new: list[str]) -> dict[str, list[int]]:
        """Put parts into the cache; returns the rows of those that will hardly come again."""
        parts, pieces = self._parts, self._pieces
        words = [p for p in new if p.isalpha()]
        odd, marked, more = {}, {}, set()
        for p in new:
            if p.isalpha():
                continue
            if not p or p[-1].isspace():
                parts[p] = _OPEN
            elif p[0] == _MARK:
                marked[p] = split(p[1:])
            else:
                odd[p] = own = split(" " + p)
                more.update([q[1:] for q in own if q[0] == " " and q[1:].isalpha()])
        words += more.difference(words, parts)
        if words:
            parts.update(zip(words, self._rows.add(self._encode_words(words, True))))
        # What does not follow a blank, or is no part.
        rest = [q for own in odd.values() for q in own if q[0] != " " or q[1:] not in parts]
        self._learn_pieces(chain(rest, chain.from_iterable(marked.values())))
        parts.update(zip(marked, self._join([[pieces[q] for q in own] for own in marked.values()])))
        return {p: [parts[q[1:]] if q[0] == " " and q[1:] in parts else pieces[q] for q in own] for p, own in odd.items()}

    def _learn_pieces(self, some: Iterable[str]) -> None:
        known = self._pieces
        missing = [p for p in dict.fromkeys(some) if p not in known]
        words = [p for p in missing if p.isalpha()]
        others = [p for p in missing if not p.isalpha()]
        if words:
            known.update(zip(words, self._rows.add(self._encode_words(words, False))))
        if others:
            known.update(zip(others, self._rows.add(self._encode(others))))
