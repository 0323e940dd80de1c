"""Byte-level BPE as a transducer, and streaming decoding.

The tokens of a prefix are the tokens of a shorter prefix and one last token, and
a sequence of tokens is what the merges give if and only if that holds for each
pair of neighbours. So the state after some bytes is: for each earlier place from
which a longer token may still begin, the node of the token trie reached since,
and the last token before that place. States are determinised when first reached
and kept in a table; a move names the next state and the last token that the
text has now. What all open places have in common is emitted; a place closes
when no token goes on, so the lookahead is bounded by the longest tokens.

Short pieces move side by side, a byte of all of them at a time, through states and
moves that are numbers in arrays; longer ones one by one.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.llm.pieces import Encoder, Ids, slices, spread, with_room
from devicelog.llm.sizes import give_back, leave, take_up
from devicelog.session import small_batches


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines with a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Pieces of up to so many bytes move side by side.
_SHORT = 64
#: Bytes of texts encoded at a time, and parts that a worker keeps: two workers stand beside a full JVM.
_SLICE_BYTES, _PARTS = 1 << 20, 100_000
_NO_RANK = 1 << 30


class Table:
    """Numbers by keys of 0 and more, found and added many at a time: a hash table with open addressing."""

    def __init__(self, bits: int = 12):
        self._bits, self._n = bits, 0
        self._keys, self._values = np.full(1 << bits, -1, dtype=np.int64), np.empty(1 << bits, dtype=np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        slots = self._slots(keys)
        held, values = self._keys[slots], self._values[slots]
        other = np.flatnonzero(held != keys)
        while len(other):
            values[other] = default
            other = other[held[other] >= 0]
            slots[other] = (slots[other] + 1) & (len(self._keys) - 1)
            held[other], values[other] = self._keys[slots[other]], self._values[slots[other]]
            other = other[held[other] != keys[other]]
        return values

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not in the table."""
        if 2 * (self._n + len(keys)) > len(self._keys):
            held, old = self._keys >= 0, self
            keys, values = np.concatenate([old._keys[held], keys]), np.concatenate([old._values[held], values])
            self.__init__(int(4 * len(keys) - 1).bit_length())
        self._n += len(keys)
        slots, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self._keys[slots[open_]] < 0]
            self._keys[slots[free]] = keys[free]  # of several keys for one slot one stays
            self._values[slots[free]] = values[free]
            lost = self._keys[slots[open_]] != keys[open_]
            placed = open_[~lost]
            self._values[slots[placed]] = values[placed]
            open_ = open_[lost]
            slots[open_] = (slots[open_] + 1) & (len(self._keys) - 1)


def _is_at(ordered: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values are found at the places that ``np.searchsorted`` gave."""
    return ordered[np.minimum(places, len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), dtype=bool)


class Transducer:
    """Ids of a piece of bytes by the ranks of its merges; tables are emptied at ``limit`` states."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 40_000):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("each single byte must be a token")
        self.ranks, self._limit = ranks, limit
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # Nodes of the token trie: beginnings of tokens, the shortest first, so that the children of each stand together.
        nodes = sorted({token[:k] for token in ranks for k in range(len(token) + 1)}, key=lambda node: (len(node), node))
        number = {node: i for i, node in enumerate(nodes)}
        parents = np.fromiter((number[node[:-1]] for node in nodes[1:]), np.int64, len(nodes) - 1)
        #: Of each node the byte that leads to it, its first child (one more entry ends the last), its token and its depth.
        self._label = b"\0" + b"".join([node[-1:] for node in nodes[1:]])
        self._first = array("i", (np.searchsorted(parents, np.arange(len(nodes) + 1)) + 1).tolist())
        self._token = array("i", [ranks.get(node, -1) for node in nodes])
        self._depth = array("i", map(len, nodes))
        del nodes, number
        # Pairs of tokens that make a token, two ranks in one number, and its rank.
        pairs, made = array("q"), array("q")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left = ranks.get(token[:i])
                if left is not None:
                    right = ranks.get(token[i:])
                    if right is not None:
                        pairs.append(left << 32 | right)
                        made.append(rank)
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._states: dict[tuple, dict] = {}
        self._reset()

        # The same in arrays; of each token its size, and its two parts where they are known (-2: not yet, -1: none).
        size = max(self.bytes_of) + 1
        self._size = np.zeros(size, dtype=np.int64)
        self._size[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self._edges = parents << 8 | np.frombuffer(self._label, dtype=np.uint8)[1:]  # in order: the child's number less one
        order = np.argsort(np.frombuffer(pairs, dtype=np.int64)) if pairs else np.zeros(0, dtype=np.int64)
        self._pairs, self._made = (np.array(x, dtype=np.int64)[order] for x in (pairs, made))
        self._tokens = np.array(self._token, dtype=np.int64)
        self._lefts, self._rights = np.full(size, -2, dtype=np.int64), np.full(size, -2, dtype=np.int64)
        self._reset_numbers()

    def _reset(self) -> None:
        for state in self._states.values():  # states refer to each other
            state.clear()
        places = (0, -1)
        #: A state has its moves, by byte: the next state and the last token; its places are under -1, a node and
        #: the token before in turn.
        self._start: dict = {-1: places}
        self._states = {places: self._start}

    def _reset_numbers(self) -> None:
        """States as numbers, the start is 0: their places are entries of one array, nodes and tokens before in turn;
        moves are by state and byte, the next state and the last token in one number."""
        start = np.array([0, -1], dtype=np.int32)
        self._numbers: dict[bytes, int] = {start.tobytes(): 0}
        self._places, self._place_ends = start, np.array([0, 2], dtype=np.int64)  # the ends of all states before and its own
        self._moves = Table()

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges make a token of; a single byte twice; None unless ranks rise with each merge."""
        if token not in self._splits:
            data, found = self.bytes_of[token], None
            if len(data) == 1:
                found = token, token
            for i in range(len(data) - 1, 0, -1):
                a, b = self.ranks.get(data[:i]), self.ranks.get(data[i:])
                if a is None or b is None or (a >= token and i > 1) or (b >= token and len(data) - i > 1):
                    continue
                if self._may_follow(a, b, token):
                    found = a, b
                    break
            self._splits[token] = found
        return self._splits[token]

    def _merged(self, data: bytes) -> list[bytes]:
        """The merges applied one by one, lowest rank first; only for tokens whose ranks do not rise with each merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while found := [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, before: int, token: int, below: float = float("inf")) -> bool:
        """Whether the merges of ranks ``below`` that give two tokens never merge across their border.

        Merges are undone, the last one first; of equal ones the left was first."""
        ranks, bytes_of, splits = self.ranks, self.bytes_of, self._splits
        left, right = before, token
        if left < 0:
            return self._split(right) is not None or self._merged(bytes_of[right]) == [bytes_of[right]]
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], below) < below:
                return False
            parts = splits.get(left) or self._split(left), splits.get(right) or self._split(right)
            if None in parts:
                pair = [bytes_of[before], bytes_of[token]]
                return below == float("inf") and self._merged(pair[0] + pair[1]) == pair
            (_, end), (begin, _) = parts
            if end != left and (left > right or begin == right):
                below = left
                left = end
            elif begin != right:
                below = right + 1
                right = begin
            else:
                return True

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """The move from a state by a byte: the next state and the last token."""
        places, token_of, label, first, last = [], self._token, self._label, self._first, -1
        held = iter(state[-1])
        for node, before in zip(held, held):
            child = label.find(byte, first[node], first[node + 1])
            if child >= 0:
                places += child, before
                token = token_of[child]
                if token >= 0 and last < 0 and self._may_follow(before, token):
                    last = token
        places += 0, last
        key = tuple(places)
        following = self._states.get(key)
        if following is None:
            following = self._states[key] = {-1: key}
        move = state[byte] = following, last
        return move

    def encode(self, piece: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        if len(self._states) > self._limit:
            self._reset()
        out: list[int] = []
        state, lasts = self._start, []
        for at in range(0, len(piece), 4096):
            if at:
                lasts = self._emit(state, lasts, out)
            for b in piece[at : at + 4096]:
                try:
                    state, last = state[b]
                except KeyError:
                    state, last = self._step(state, b)
                lasts.append(last)
        out += self._back(lasts, len(lasts))
        return struct.pack(f"<{len(out)}I", *out)

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes, from the last one on backwards."""
        tokens, bytes_of = [], self.bytes_of
        while end > 0:
            token = lasts[end - 1]
            tokens.append(token)
            end -= len(bytes_of[token])
        tokens.reverse()
        return tokens

    def _emit(self, state: dict, lasts: list[int], out: list[int]) -> list[int]:
        """Emit the tokens that the texts before all open places share; returns the last tokens after them."""
        shared: list[int] | None = None
        for node in state[-1][::2]:
            tokens = self._back(lasts, len(lasts) - self._depth[node])
            if shared is None:
                shared = tokens
                continue
            alike = min(len(shared), len(tokens))
            shared = shared[: next((i for i in range(alike) if shared[i] != tokens[i]), alike)]
        out += shared or []
        return lasts[sum(len(self.bytes_of[t]) for t in shared or []) :]

    def encode_all(self, pieces: list[bytes]) -> Ids:
        """The ids of all pieces one behind the other, and how many each has."""
        n = len(pieces)
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int64, n)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        counts = (whole >= 0).astype(np.int64)
        short = np.flatnonzero((whole < 0) & (sizes <= _SHORT) & (sizes > 0))
        short = short[np.argsort(-sizes[short], kind="stable")]
        data = np.frombuffer(b"".join([pieces[i] for i in short.tolist()]), dtype=np.uint8)
        starts = np.cumsum(sizes[short]) - sizes[short]
        lasts = self._lasts(data, starts, sizes[short])

        # The tokens of each piece from the last one on backwards.
        ends, active, found = starts + sizes[short], np.arange(len(short)), []
        while len(active):
            tokens = lasts[ends[active] - 1]
            found.append((active, tokens))
            counts[short[active]] += 1
            ends[active] -= self._size[tokens]
            active = active[ends[active] > starts[active]]
        long = {i: np.frombuffer(self.encode(pieces[i]), dtype="<u4") for i in np.flatnonzero((whole < 0) & (sizes > _SHORT)).tolist()}
        for i, own in long.items():
            counts[i] = len(own)
        places = np.cumsum(counts)
        out = np.empty(places[-1] if n else 0, dtype="<u4")
        known = np.flatnonzero(whole >= 0)
        out[places[known] - 1] = whole[known]
        for k, (active, tokens) in enumerate(found):
            out[places[short[active]] - 1 - k] = tokens
        for i, own in long.items():
            out[places[i] - len(own) : places[i]] = own
        return out, counts

    def _lasts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token after each byte of pieces, which are given from the longest to the shortest."""
        if len(self._numbers) > self._limit:
            self._reset_numbers()
        lasts, states = np.empty(len(data), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for k in range(sizes[0] if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k))  # so many have a byte here
            at = starts[:n] + k
            keys = states[:n] << 8 | data[at]
            moves = self._moves.get(keys)
            new = np.flatnonzero(moves < 0)
            if len(new):
                wanted, inverse = np.unique(keys[new], return_inverse=True)
                moves[new] = self._new_moves(wanted)[inverse]
            states[:n] = moves >> 32
            lasts[at] = moves & 0xFFFFFFFF
        return lasts

    def _new_moves(self, keys: np.ndarray) -> np.ndarray:
        """``_step`` for different keys, side by side."""
        states = keys >> 8
        begins = self._place_ends[states]
        held = (self._place_ends[states + 1] - begins) // 2
        at = spread(begins // 2, held) * 2
        owner = np.repeat(np.arange(len(keys)), held)
        edges = self._places[at].astype(np.int64) << 8 | (keys & 255)[owner]
        children = np.searchsorted(self._edges, edges)
        goes_on = _is_at(self._edges, children, edges)
        children += 1
        owner, children, before = owner[goes_on], children[goes_on], self._places[at[goes_on] + 1].astype(np.int64)
        tokens = self._tokens[children]
        possible = np.flatnonzero(tokens >= 0)
        possible = possible[self._may_follow_all(before[possible], tokens[possible])][::-1]
        lasts = np.full(len(keys), -1, dtype=np.int64)
        lasts[owner[possible]] = tokens[possible]  # the first place of each comes last

        places = np.bincount(owner, minlength=len(keys)) + 1
        ends = np.cumsum(places)
        flat = np.empty((ends[-1], 2), dtype=np.int32)
        flat[ends - 1, 0], flat[ends - 1, 1] = 0, lasts
        at = np.arange(len(owner)) + owner  # each state before it has one more place
        flat[at, 0], flat[at, 1] = children, before
        raw, numbers, known = flat.tobytes(), self._numbers, len(self._numbers)
        cuts = (ends * 8).tolist()
        following = np.fromiter((numbers.setdefault(raw[x:y], len(numbers)) for x, y in zip([0, *cuts], cuts)), np.int64, len(keys))
        made, first = np.unique(following, return_index=True)
        first = first[made >= known]
        if len(first):
            end, own = int(self._place_ends[known]), places[first] * 2
            self._places = with_room(self._places, end, own.sum())
            self._places[end : end + own.sum()] = flat.reshape(-1)[spread((ends[first] - places[first]) * 2, own)]
            self._place_ends = with_room(self._place_ends, known + 1, len(first))
            self._place_ends[known + 1 : known + 1 + len(first)] = end + np.cumsum(own)
        moves = following << 32 | lasts
        self._moves.add(keys, moves)
        return moves

    def _may_follow_all(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``_may_follow`` for many pairs, side by side."""
        out = np.zeros(len(tokens), dtype=bool)
        alone = before < 0
        for token in np.unique(tokens[alone]).tolist():
            out[alone & (tokens == token)] = self._may_follow(-1, token)
        pairs = np.flatnonzero(~alone)
        left, right, below = before[pairs], tokens[pairs], np.full(len(pairs), _NO_RANK)
        while len(pairs):
            pair = left << 32 | right
            place = np.searchsorted(self._pairs, pair)
            merges = _is_at(self._pairs, place, pair)
            stays = np.ones(len(pairs), dtype=bool)
            stays[merges] = self._made[place[merges]] >= below[merges]
            pairs, left, right, below = pairs[stays], left[stays], right[stays], below[stays]
            for token in np.unique(np.concatenate([left[self._lefts[left] == -2], right[self._lefts[right] == -2]])).tolist():
                self._lefts[token], self._rights[token] = self._split(token) or (-1, -1)
            end, begin = self._rights[left], self._lefts[right]
            for i in np.flatnonzero((end < 0) | (begin < 0)).tolist():
                out[pairs[i]] = self._may_follow(int(before[pairs[i]]), int(tokens[pairs[i]]))
            undo_left = (end != left) & ((left > right) | (begin == right))
            undo_right = ~undo_left & (begin != right)
            known = (end >= 0) & (begin >= 0)
            out[pairs[known & ~undo_left & ~undo_right]] = True
            left, right, below = np.where(undo_left, end, left), np.where(undo_right, begin, right), np.where(undo_left, left, right + 1)
            on = known & (undo_left | undo_right)
            pairs, left, right, below = pairs[on], left[on], right[on], below[on]
        return out


class StreamDecoder:
    """Bytes and text of ids that arrive bit by bit.

    The state is the beginning of a character whose last bytes are still to come,
    at most three bytes. Bytes that are no UTF-8 become U+FFFD, the same ones as
    if all bytes were decoded at once.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of, default=-1) + 1)]
        self._flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < size else 0
            if byte < 0x80:
                return 0
        return 0

    def take(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes of the characters that are complete now."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self._held + self._flat[places].tobytes()
        cut = len(data) - self.unfinished(data)
        self._held = data[cut:]
        return data[:cut]

    def rest(self) -> bytes:
        rest, self._held = self._held, b""
        return rest

    def feed(self, ids: np.ndarray | list[int]) -> str:
        return self.take(ids).decode("utf-8", "replace")

    def end(self) -> str:
        return self.rest().decode("utf-8", "replace")


def _encoder(ranks_path: str, pattern: str) -> Encoder:
    import regex

    pieces_of = regex.compile(pattern).findall
    transducer = Transducer(load_ranks(ranks_path))

    def words(some: list[str], blank: bool) -> Ids:
        lead = " " * blank
        return transducer.encode_all([(lead + word).encode() for word in some])

    def many(some: list[str]) -> Ids:
        own = [pieces_of(text) for text in some]
        ids, counts = transducer.encode_all([p.encode() for p in chain.from_iterable(own)])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(x) for x in own])]
        return ids, np.diff(ends, prepend=0)

    return Encoder(words, many, limit=_PARTS)


def _ids_of(encoder: Encoder, texts: pa.Array) -> list[np.ndarray]:
    ids, counts = encoder.batch(texts)
    ends = np.cumsum(counts).tolist()
    return [ids[x:y] for x, y in zip([0, *ends], ends)]


def _decoder(ranks_path: str) -> StreamDecoder:
    """Without held bytes between texts."""
    return StreamDecoder({rank: token for token, rank in load_ranks(ranks_path).items()})


def _decoded(stream: StreamDecoder, ids: np.ndarray, chunk: int) -> Iterator[bytes]:
    """The bytes of a text's ids, ``chunk`` ids at a time."""
    for k in range(0, len(ids), chunk):
        yield stream.take(ids[k : k + chunk])
    yield stream.rest()


def _chosen(docs: DataFrame, carry: list[str] | None) -> tuple[DataFrame, dict[str, str]]:
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    chosen += [F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(carry or [])]
    return docs.select(*chosen), {f"k{i}": name for i, name in enumerate(carry or [])}


def _schema(rows: DataFrame) -> str:
    return "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])


def encode(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ``ids`` (4-byte little-endian) of each whole text, and the columns named by ``carry``.

    ``ranks_path`` is a rank file that every executor has, ``pattern`` cuts a
    text into pieces that are encoded separately. Null texts are empty and have
    no ids; null ids, repeated rows and empty tables pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = take_up(key, lambda: _encoder(ranks_path, pattern))
        gc.disable()  # only states are in cycles, which a reset undoes
        for whole in batches:
            for batch in slices(whole, 1, _SLICE_BYTES):
                ids = _ids_of(encoder, batch.column(1))
                counts = pa.array(map(len, ids), pa.int64())
                columns = [batch.column(0), counts, pa.array([x.tobytes() for x in ids], pa.binary()), *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", *names])
                del ids, columns
                give_back()
        gc.enable()
        leave(key, encoder)

    key = ("bpe.encode", ranks_path, pattern)
    small_batches(docs.sparkSession)
    rows, renamed = _chosen(docs, carry)
    names = rows.columns[2:]
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + _schema(rows)).withColumnsRenamed(renamed)


def decode(encoded: DataFrame, ranks_path: str, chunk: int = 65_536, with_text: bool = True) -> DataFrame:
    """``encoded`` with ``ids_sha256`` and ``decoded_sha256`` (of the decoded bytes) instead of ``ids``, and ``text``
    unless only the digests are wanted.

    Null ids are no ids; other columns of any name but the new ones stay;
    repeated rows and empty tables pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _decoder(ranks_path)
        for whole in batches:
            for batch in slices(whole, place):
                texts, decoded, digests = [], [], []
                for raw in batch.column(place).to_pylist():
                    parts = list(_decoded(stream, np.frombuffer(raw or b"", dtype="<u4"), chunk))
                    decoded.append(hashlib.sha256(b"".join(parts)).hexdigest())
                    digests.append(hashlib.sha256(raw or b"").hexdigest())
                    if with_text:
                        texts.append("".join([p.decode("utf-8", "replace") for p in parts]))
                columns = [c for k, c in enumerate(batch.columns) if k != place]
                columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if with_text else [])], names=names)
        give_back()

    place = encoded.columns.index("ids")
    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    names = [f.name for f in kept] + ["ids_sha256", "decoded_sha256"] + ["text"] * with_text
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return encoded.mapInArrow(run, schema + ", ids_sha256 string, decoded_sha256 string" + ", text string" * with_text)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, carry: list[str] | None = None, chunk: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns named by ``carry``: ``encode`` and ``decode`` in one
    pass, so that ids never leave the worker that made them. Cases as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream = take_up(key, lambda: (_encoder(ranks_path, pattern), _decoder(ranks_path)))
        gc.disable()  # only states are in cycles, which a reset undoes
        for whole in batches:
            for batch in slices(whole, 1, _SLICE_BYTES):
                counts, digests, decoded = [], [], []
                for ids in _ids_of(encoder, batch.column(1)):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids).hexdigest())
                    digest = hashlib.sha256()
                    for part in _decoded(stream, ids, chunk):
                        digest.update(part)
                    decoded.append(digest.hexdigest())
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=names)
                del ids, columns
                give_back()
        gc.enable()
        leave(key, (encoder, stream))

    key = ("bpe.round_trip", ranks_path, pattern)
    small_batches(docs.sparkSession)
    rows, renamed = _chosen(docs, carry)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *rows.columns[2:]]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + _schema(rows)
    return rows.mapInArrow(run, schema).withColumnsRenamed(renamed)
