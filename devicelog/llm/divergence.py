"""How the sources of a language differ in their words: hash-consed segment trees over term ids.

The kept terms of a language get ids: a block by a hash of the term, and a place
in the block. Over each block, every source has a binary tree whose leaves are its
counts. Trees are built level by level for all sources at once, and equal
subtrees, wherever they stand, become one node. Two trees are then walked down
together for all pairs of sources at once: node pairs that occur several times
for a pair of sources are merged at every level, with the number of times as a
factor, so each is priced once. What no source of a block's task has is priced
once for all of its places.

A task holds a block for at most two tiles of sources and walks a bounded number
of pairs at a time. All figures are integers and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelog.llm.sizes import measured
from devicelog.session import written

SCALE, PRIOR = 1_000_000_000, 5
BLOCK_TERMS = 2048
TILE_SOURCES = 128
_PAIR_LEAVES = 1 << 20
_HELD = 300_000
_SLICE = 1 << 20
#: A-Z become small letters, all other ASCII characters that are no letters become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(data: bytes) -> Iterator[bytes]:
    """A text in parts of about a million bytes, cut between terms."""
    start = 0
    while len(data) - start > _SLICE:
        cut = data.find(b" ", start + _SLICE)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, ``count`` of occurrences and ``docs``, the documents with the term.

    Every group of documents also has one row with an empty term. Null texts,
    languages and sources are empty strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen: set[tuple[str, str]] = set()

        def flush() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (total, docs_with) in counts.items():
                size = len(total)
                for column, values in zip(columns, ([lang] * size, [source] * size, total, total.values(), map(docs_with.get, total))):
                    column.extend(values)
            counts.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "count", "docs"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held = 0
            for group, text in zip(zip(langs, sources), batch.column(2).cast(pa.binary())):
                total, docs_with = counts.setdefault(group, (Counter(), Counter()))
                if group not in seen:
                    seen.add(group)
                    total[b""] = docs_with[b""] = 0
                own: set[bytes] = set()
                for part in _slices(text.as_py().translate(_TERM_BYTES)):
                    terms = part.split()
                    total.update(terms)
                    own.update(terms)
                docs_with.update(own)
                held += len(own)
                if held > _HELD:
                    held = sum(len(t) for t, _ in counts.values())
                    if held > _HELD:
                        yield flush()
                        held = 0
            if sum(len(t) for t, _ in counts.values()) > _HELD:
                yield flush()
        if counts:
            yield flush()

    chosen = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = chosen.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    wide = [c.cast("decimal(20,0)") for c in (count + F.lit(PRIOR), total + F.lit(PRIOR) * terms)]
    return F.lit(1).cast("long") + F.call_function("div", wide[0] * F.lit(SCALE).cast("decimal(10,0)"), wide[1])


def share_of(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for an array of counts."""
    if int(counts.max(initial=0)) + PRIOR < (1 << 62) // SCALE:
        return 1 + SCALE * (counts + PRIOR) // (total + PRIOR * terms)
    return np.array([1 + SCALE * (int(c) + PRIOR) // (total + PRIOR * terms) for c in counts], dtype=np.int64)


class Trees:
    """Segment trees of several sources over the same places, with equal subtrees as one node.

    ``counts`` has a row for each source; its width is a power of two. Places that
    are not in use hold -1. ``roots`` has a node for each source and, level by
    level downwards, ``children`` the two nodes that a node of the level above is
    made of; nodes of the lowest level stand for the counts in ``leaves``.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.children: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            size = int(nodes.max()) + 1
            keys, made = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            self.children.append(np.stack([keys // size, keys % size], axis=1))
            nodes = made.reshape(len(counts), -1)
        self.children.reverse()
        self.roots = nodes[:, 0]

    def prices(self, left: np.ndarray, right: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """For each pair of sources: sum over the places of the differences of their shares.

        ``shares`` has a row for each source and a column for each leaf.
        """
        pair, a, b = np.arange(len(left)), self.roots[left], self.roots[right]
        times = np.ones(len(left), dtype=np.int64)
        for below in self.children:
            down_a, down_b = below[a], below[b]
            size = int(below.max()) + 1
            keys = ((pair[:, None] * size + down_a) * size + down_b).ravel()
            keys, first = np.unique(keys, return_inverse=True)
            times = np.bincount(first, np.repeat(times, 2), len(keys)).astype(np.int64)
            pair, a, b = keys // (size * size), keys // size % size, keys % size
        each = np.abs(shares[left[pair], a] - shares[right[pair], b]) * times
        out = np.zeros(len(left), dtype=np.int64)
        np.add.at(out, pair, each)
        return out


def _pairs_of(rows: int, own: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs i < j between two lists of indices, in parts of at most ``rows``."""
    width = max(1, rows // max(1, len(other)))
    for at in range(0, len(own), width):
        i, j = np.meshgrid(own[at : at + width], other, indexing="ij")
        chosen = i < j
        if chosen.any():
            yield i[chosen], j[chosen]


def _block_prices(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Prices of all pairs of sources in one block, and how many terms they cover.

    Every source has a row of count 0, so that those without a term of the block take part.
    """
    column = {name: table.column(name).to_numpy() for name in ("tile_a", "tile_b", "tile", "number", "place", "count", "total", "terms")}
    numbers, first, row = np.unique(column["number"], return_index=True, return_inverse=True)
    there = column["count"] > 0
    used, place = np.unique(column["place"][there], return_inverse=True)
    if not len(used):
        return
    width = 1 << int(len(used) - 1).bit_length()
    counts = np.zeros((len(numbers), width), dtype=np.int64)
    counts[:, len(used) :] = -1
    counts[row[there], place] = column["count"][there]
    trees = Trees(counts)
    terms, totals, tiles = int(column["terms"][0]), column["total"][first].tolist(), column["tile"][first]
    shares = np.stack([np.where(trees.leaves < 0, 0, share_of(np.maximum(trees.leaves, 0), n, terms)) for n in totals])
    places = np.arange(len(numbers))
    own, other = places[tiles == column["tile_a"][0]], places[tiles == column["tile_b"][0]]
    lang = table.column("lang")[0].as_py()
    for i, j in _pairs_of(max(1, _PAIR_LEAVES // width), own, other):
        found = trees.prices(i, j, shares)
        columns = [pa.array([lang] * len(i)), pa.array(numbers[i]), pa.array(numbers[j]), pa.array(found)]
        columns.append(pa.array(np.full(len(i), len(used), dtype=np.int64)))
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "i", "j", "price", "places"])


def _priced(kept: DataFrame, groups: DataFrame, block_terms: int, tile_sources: int) -> DataFrame:
    """lang, i, j, ``price`` of pairs of sources that share a block, and ``places``, how many terms it covers."""
    blocks = F.floor((F.col("terms") + F.lit(block_terms - 1)) / F.lit(block_terms))
    block = F.pmod(F.xxhash64("term"), blocks)
    rows = kept.join(groups.drop("lang_total"), ["lang", "source"]).withColumn("block", block)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    idle = groups.where("terms > 0").select(
        "lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("count"), "total", "terms", "sources", "number",
        numbers.alias("block"),
    )
    rows = rows.unionByName(idle).withColumn("tile", F.floor(F.col("number") / tile_sources))
    last = F.floor((F.col("sources") - 1) / F.lit(tile_sources))
    # A pair of tiles sees the rows of both; with one tile there is one copy.
    with_all = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda t: F.struct(F.least("tile", t).alias("tile_a"), F.greatest("tile", t).alias("tile_b")),
    )
    rows = rows.withColumn("tiles", F.explode(with_all)).select(
        "lang", "block", "tiles.tile_a", "tiles.tile_b", "tile", "number", F.xxhash64("term", F.lit(1)).alias("place"),
        "term", "count", "total", "terms",
    )

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # Two terms of a block with one hash would be one place: their texts tell them apart.
        ordered = table.select(["place", "term"]).group_by(["place", "term"]).aggregate([])
        if len(ordered) != len(ordered.column("place").unique()):
            _, own = np.unique(np.array(table.column("term").to_pylist(), dtype=object), return_inverse=True)
            table = table.set_column(table.schema.get_field_index("place"), "place", pa.array(own))
        yield from _block_prices(table)

    schema = "lang string, i long, j long, price long, places long"
    return (
        rows.groupBy("lang", "block", "tile_a", "tile_b")
        .applyInArrow(_whole(run, schema), schema)
        .groupBy("lang", "i", "j")
        .agg(F.sum("price").alias("price"), F.sum("places").alias("places"))
    )


def _whole(run, schema: str):
    """A function of a group that returns one table."""

    def of(table: pa.Table) -> pa.Table:
        batches = list(run(table))
        empty = pa.schema([("lang", pa.string()), *[(n, pa.int64()) for n in ("i", "j", "price", "places")]])
        return pa.Table.from_batches(batches, schema=batches[0].schema if batches else empty)

    return of


def audit(
    docs: DataFrame,
    least_docs: int = 30,
    top: int = 50,
    block_terms: int = BLOCK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """lang, source, part, item, value, rank of every group of documents with one lang and source.

    Terms are runs of letters and of characters beyond ASCII, with A-Z as a-z; a
    language keeps those in at least ``least_docs`` of its documents. A group's
    share of a term is 1 + floor(10^9 (count + 5) / (N + 5 V)). Part ``pair`` has a
    row for each other source of the language with the summed differences of their
    shares (all of them: as many rows as there are pairs); part ``term`` the
    ``top`` terms that the group has more of than the language, with the difference.
    Ranks go by falling value, then by item.

    Null texts, languages and sources are empty strings; groups without kept terms
    are compared too, with 0 if the language keeps no term; repeated rows count
    each time; an empty table gives an empty result; other columns are ignored.
    """
    found = written(count_terms(docs))
    term = Window.partitionBy("lang", "term")
    kept = (
        found.where("term <> ''")
        .withColumn("lang_docs", F.sum("docs").over(term))
        .withColumn("lang_count", F.sum("count").over(term))
        .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
        .where(F.col("lang_docs") >= least_docs)
    )
    kept = written(kept.select("lang", "source", "term", "count", "lang_count", "first"))
    totals = kept.groupBy("lang", "source").agg(
        F.sum("count").alias("total"),
        F.sum(F.when(F.col("first"), 1).otherwise(0)).alias("own_terms"),
    )
    groups = found.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0)
    lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang",
        "source",
        F.col("total"),
        F.sum("total").over(lang).alias("lang_total"),
        F.sum("own_terms").over(lang).alias("terms"),
        F.count("*").over(lang).alias("sources"),
        (F.row_number().over(lang.orderBy("source")) - 1).cast("long").alias("number"),
    )
    groups = measured(groups, "octet_length(lang) + octet_length(source) + 64")

    prices = _priced(kept.select("lang", "source", "term", "count"), groups, block_terms, tile_sources)
    a = groups.select("lang", "terms", F.col("number").alias("i"), F.col("source").alias("source_a"), F.col("total").alias("total_a"))
    b = groups.select("lang", F.col("number").alias("j"), F.col("source").alias("source_b"), F.col("total").alias("total_b"))
    none = F.lit(0).cast("long")
    # Terms that neither tile of a pair has in a block: all of them have the same difference.
    same = F.when(
        F.col("terms") > 0,
        F.abs(_share(none, F.col("total_a"), F.col("terms")) - _share(none, F.col("total_b"), F.col("terms")))
        * (F.col("terms") - F.coalesce("places", none)),
    ).otherwise(none)
    pairs = (
        a.join(b, "lang")
        .where("i < j")
        .join(prices, ["lang", "i", "j"], "left")
        .select("lang", "source_a", "source_b", (F.coalesce("price", none) + same).alias("value"))
    )
    both = F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")),
    )
    sides = pairs.withColumn("side", F.explode(both)).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sides = sides.withColumn("rank", F.row_number().over(order))

    own = _share(F.col("count"), F.col("total"), F.col("terms"))
    all_sources = _share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    terms = (
        kept.where("count > 0")
        .join(groups, ["lang", "source"])
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (own - all_sources).alias("value"))
        .where("value > 0")
    )
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return sides.unionByName(terms)
