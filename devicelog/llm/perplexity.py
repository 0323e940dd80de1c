"""Quality rules: counts of a text, and perplexity under an n-gram model of its language.

The model is a modified Kneser-Ney model over the bytes of the texts, of order
four, two per language: each half of the different texts is scored by the model of the
other half, since n-grams that a text brought in itself would make any junk look
likely, and copies of a text share its half. Spark counts the n-grams of all documents and derives
continuation counts, discounts, back-off weights and interpolated probabilities
with joins. Words would need one row for nearly each pair of words; bytes keep
the model to what the languages use, and it still grows with the texts.

For scoring, the model becomes sorted hash arrays: an invertible hash of
(language, order, n-gram) in order, with logarithms beside it. Up to
``ARRAY_ROWS`` rows they are sent to the executors; a larger model stays a table
and n-grams are joined to it, with the same scores.

A document is rejected if its perplexity lies outside its language's band:
``BAND`` times the distance from the median to the lower or the upper quartile of the
language's different texts that pass the base rules, on the scale of logarithms. The
band of a text of n bytes is wider by the root of 1 + ``SHORT`` / n, as its figure
scatters more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelog.llm.blocks import U64, mixed
from devicelog.llm.sizes import measured
from devicelog.llm.words import find_words, run_hashes, word_hashes
from devicelog.session import written

ORDER = 4
ARRAY_ROWS = 8_000_000
BAND = 8.0
#: Texts of so many bytes scatter by the root of two more than long ones.
SHORT = 100
#: Quartiles are taken to be at least so far (in logarithms) from the median: texts of one kind, or near copies, are no measure.
LEAST_SPREAD = 0.02
#: A language with fewer different sound texts has no band.
LEAST_TEXTS = 20
MIN_WORDS = 20
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
_BYTES_PER_TURN = 4 << 20


def _grams(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams as numbers, first byte highest, and which of them lie in one text."""
    size = len(data) - order + 1
    if size < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    grams = np.zeros(size, dtype=np.int64)
    for k in range(order):
        grams = (grams << 8) | data[k : k + size]
    inside = np.ones(len(data) + order, dtype=bool)
    for k in range(1, order):
        inside[np.maximum(bounds[1:] - k, 0)] = False
    return grams, inside[:size]


def _turns(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with some megabytes of text each."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= _BYTES_PER_TURN or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, held = i + 1, 0


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), bounds


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def _half(other: bool = False) -> Column:
    """The language and the half of the documents that a text belongs to, or the other half; copies share theirs."""
    half = F.pmod(F.xxhash64("text", F.lit(6)), F.lit(2))
    return F.concat("lang", F.lit("\t"), (1 - half if other else half).cast("string"))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang (with the half), gram, n: how often each ``ORDER`` bytes occur inside the texts of a language's half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(lang: str) -> None:
            keys, counts = (np.concatenate([part[k] for part in held[lang]]) for k in (0, 1))
            distinct, place = np.unique(keys, return_inverse=True)
            held[lang] = [(distinct, np.bincount(place, weights=counts).astype(np.int64))]

        def rows(lang: str) -> pa.RecordBatch:
            merged(lang)
            grams, counts = held.pop(lang)[0]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"]
            )

        for batch in batches:
            for part, texts in _turns(batch, 1):
                langs = part.column(0).to_pylist()
                for lang in set(langs):
                    grams, inside = _grams(*_joined([t for t, own in zip(texts, langs) if own == lang]), ORDER)
                    held.setdefault(lang, []).append(np.unique(grams[inside], return_counts=True))
                    if len(held[lang]) >= 8:
                        merged(lang)
                        if len(held[lang][0][0]) > 1_000_000:
                            yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    counts = _texts(docs).select(_half().alias("lang"), "text").mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """The model: lang, kind (order of an n-gram, or -order of a context), gram, value (a logarithm).

    ``value`` is the probability of an n-gram's last byte after the others, or the
    weight that a context leaves to the next lower order.
    """
    levels = {ORDER: written(counts)}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = written(levels[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")))
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        c = levels[k]
        of = lambda i: F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double")
        t = c.groupBy("lang").agg(*[of(i).alias(f"t{i}") for i in (1, 2, 3, 4)])
        y = F.coalesce(F.col("t1") / F.nullif(F.col("t1") + 2 * F.col("t2"), F.lit(0.0)), F.lit(0.5))
        # A discount without the counts it needs falls back to half of what it discounts at most.
        d = lambda i: F.greatest(
            F.lit(0.1), F.least(F.lit(i - 0.1), F.coalesce(i - (i + 1) * F.col("y") * F.col(f"t{i + 1}") / F.nullif(F.col(f"t{i}"), F.lit(0.0)), F.lit(0.5 * i)))
        )
        t = t.withColumn("y", y).select(F.col("lang").alias("dl"), d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))
        own = c.join(F.broadcast(written(t)), F.col("lang") == F.col("dl"))  # a row per language, of four numbers
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.select("lang", "gram", "n", discount.alias("d"), F.shiftright("gram", 8).alias("context"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"))
        contexts = written(contexts)
        full = own.join(contexts, ["lang", "context"])
        share = (F.col("n") - F.col("d")) / F.col("total")
        if lower is None:
            p = full.select("lang", "gram", (share + F.col("left") / 256).alias("p"))
        else:
            below = lower.select(F.col("lang").alias("bl"), F.col("gram").alias("bg"), F.col("p").alias("bp"))
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            p = full.join(below, (F.col("lang") == F.col("bl")) & (suffix == F.col("bg"))).select(
                "lang", "gram", (share + F.col("left") * F.col("bp")).alias("p")
            )
        lower = written(p)
        parts.append(lower.select("lang", F.lit(k).alias("kind"), "gram", F.log("p").alias("value")))
        parts.append(contexts.select("lang", F.lit(-k).alias("kind"), F.col("context").alias("gram"), F.log("left").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return written(out)


def _keys(langs: np.ndarray | int, kinds: np.ndarray | int, grams: np.ndarray) -> np.ndarray:
    return mixed(((langs << 48) | ((kinds + 8) << 40) | grams).astype(U64))


def hash_arrays(rows: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A model as its languages, hashes in order, and their values."""
    langs = sorted(set(rows.column("lang").unique().to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    own = rows.column("lang").combine_chunks().dictionary_encode()
    names = np.array([number[x] for x in own.dictionary.to_pylist()], dtype=np.int64)
    places = names[own.indices.to_numpy()] if len(names) else names
    keys = _keys(places, rows.column("kind").to_numpy().astype(np.int64), rows.column("gram").to_numpy())
    order = np.argsort(keys)
    return langs, keys[order], rows.column("value").to_numpy()[order].astype(np.float32)


class HashArrays:
    """Look-ups in the arrays of ``hash_arrays``."""

    def __init__(self, langs: list[str], keys: np.ndarray, values: np.ndarray):
        self.number = {lang: i for i, lang in enumerate(langs)}
        self.keys, self.values = keys, values

    def find(self, lang: int, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = _keys(lang, kind, grams)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def log_probabilities(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Of the last bytes of distinct n-grams; what is not there is looked for one order lower."""
        number = self.number.get(lang, -1)
        if number < 0 or not len(grams):
            return np.full(len(grams), -np.log(256.0))
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            own = grams[open_] & ((1 << 8 * k) - 1)
            value, there = self.find(number, k, own)
            out[open_[there]] += value[there]
            open_, own = open_[~there], own[~there]
            if not len(open_):
                return out
            left, seen = self.find(number, -k, own >> 8)
            out[open_] += np.where(seen, left, 0.0)
        out[open_] -= np.log(256.0)
        return out


def rule_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text."""
    lines = text.split("\n")
    again = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            again += line in seen and bool(line.strip(_BLANKS))
            seen.add(line)
    return len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), again


def repeat_words(data: np.ndarray, bounds: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and words inside windows of ``width`` words that its text has twice or more."""
    words = find_words(data, bounds)
    counts = np.diff(words.bounds)
    if len(words) < width:
        return counts, np.zeros(len(counts), dtype=np.int64)
    windows = run_hashes(word_hashes(data, words), width)
    document = np.searchsorted(words.bounds, np.arange(len(windows)), side="right") - 1
    whole = np.flatnonzero(np.arange(len(windows)) + width <= words.bounds[1:][document])
    keys = mixed(windows[whole] ^ (document[whole].astype(U64) * U64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys, kind="stable")
    alike = keys[order][1:] == keys[order][:-1]
    twice = np.concatenate([alike, [False]]) | np.concatenate([[False], alike])
    starts = whole[order[twice]]
    change = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return counts, inside[words.bounds[1:]] - inside[words.bounds[:-1]]


def measures(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, key (of the text), the base counts, ``n_scored`` (n-grams) and ``log_p``, their sum."""
    spark = docs.sparkSession
    small = model.count() <= ARRAY_ROWS
    arrays = spark.sparkContext.broadcast(hash_arrays(model.toArrow())) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HashArrays(*arrays.value) if arrays else None
        for batch in batches:
            for part, texts in _turns(batch, 2):
                data, bounds = _joined(texts)
                n_words, repeated = repeat_words(data, bounds)
                counts = [rule_counts(t) for t in part.column(2).to_pylist()]
                langs = part.column(1).to_pylist()
                n_scored, log_p = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
                for lang in set(langs) if model else ():
                    own = np.array([i for i, x in enumerate(langs) if x == lang])
                    data, bounds = _joined([texts[i] for i in own])
                    grams, inside = _grams(data, bounds, ORDER)
                    at = np.flatnonzero(inside)
                    distinct, place = np.unique(grams[at], return_inverse=True)
                    values = model.log_probabilities(lang, distinct)
                    document = np.searchsorted(bounds, at, side="right") - 1
                    log_p[own] = np.bincount(document, weights=values[place], minlength=len(own))
                    n_scored[own] = np.bincount(document, minlength=len(own))
                columns = [pa.array(n_words.astype(np.int64)), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))]
                columns += [pa.array(repeated.astype(np.int64)), pa.array(n_scored), pa.array(log_p)]
                names = ["doc_id", "lang", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_scored", "log_p"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *columns], names=names)

    texts = _texts(docs).withColumn("key", F.xxhash64("text")).withColumn("lang", _half(other=True))
    schema = (
        "doc_id long, lang string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_scored long, log_p double"
    )
    rows = texts.mapInArrow(run, schema)
    if not small:
        rows = _scored_by_join(texts, rows.drop("n_scored", "log_p"), model)
    return rows.withColumn("lang", F.expr("left(lang, length(lang) - 2)"))


def _scored_by_join(texts: DataFrame, rows: DataFrame, model: DataFrame) -> DataFrame:
    """The same scores without arrays: each text's distinct n-grams are joined to the model, order by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in _turns(batch, 2):
                for i, text in enumerate(own):
                    grams, inside = _grams(*_joined([text]), ORDER)
                    distinct, counts = np.unique(grams[inside], return_counts=True)
                    head = [pa.array([part.column(k)[i].as_py()] * len(distinct), t) for k, t in ((0, pa.int64()), (1, pa.string()), (3, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(distinct), pa.array(counts)], names=["doc_id", "lang", "key", "gram", "n"])

    rest = texts.dropDuplicates(["doc_id", "lang", "key"]).mapInArrow(run, "doc_id long, lang string, key long, gram long, n long")
    rest = rest.withColumn("sum", F.lit(0.0)).withColumn("done", F.lit(False))
    for k in range(ORDER, 0, -1):
        own = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        for kind, key in ((k, own), (-k, F.shiftright(own, 8))):
            side = model.filter(F.col("kind") == kind).select(F.col("lang").alias("ml"), F.col("gram").alias("mg"), "value")
            joined = rest.join(side, ~F.col("done") & (F.col("lang") == F.col("ml")) & (key == F.col("mg")), "left")
            done = F.col("done") | F.col("value").isNotNull() if kind > 0 else F.col("done")
            total = F.col("sum") + F.coalesce("value", F.lit(0.0))
            rest = joined.select("doc_id", "lang", "key", "gram", "n", total.alias("sum"), done.alias("done"))
    value = F.col("sum") - F.when(F.col("done"), 0.0).otherwise(float(np.log(256.0)))
    sums = rest.groupBy("doc_id", "lang", "key").agg(F.sum("n").alias("n_scored"), F.sum(F.col("n") * value).alias("log_p"))
    b = sums.select(F.col("doc_id").alias("bd"), F.col("lang").alias("bl"), F.col("key").alias("bk"), "n_scored", "log_p")
    on = F.col("doc_id").eqNullSafe(F.col("bd")) & (F.col("lang") == F.col("bl")) & (F.col("key") == F.col("bk"))
    out = rows.join(b, on, "left").drop("bd", "bl", "bk")
    return out.withColumns({"n_scored": F.coalesce("n_scored", F.lit(0).cast("long")), "log_p": F.coalesce("log_p", F.lit(0.0))})


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, perplexity, low, high, kept.

    Null texts have no words and fail; a null language, or a table without the
    column, is the language "und"; a text of fewer bytes than ``ORDER`` has no perplexity,
    a language of fewer than ``LEAST_TEXTS`` different sound texts no band,
    and only the base rules decide; repeated rows stay; an empty table gives an
    empty result; other columns make no difference.
    """
    model = kneser_ney(count_grams(docs))
    rows = measures(docs, model)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("x", -F.col("log_p") / F.nullif(F.col("n_scored"), F.lit(0)))
    rows = written(rows.withColumn("spread", F.sqrt(1 + SHORT / F.nullif(F.col("n_scored"), F.lit(0)))))
    # Each text once, however many copies it has.
    sound = written(rows.filter("NOT base_failed AND x IS NOT NULL").groupBy("lang", "key").agg(F.first("x").alias("x"), F.first("spread").alias("spread")))
    middles = sound.groupBy("lang").agg(F.percentile_approx("x", 0.5, 10_000).alias("middle"), F.count("*").alias("texts"))
    middles = middles.filter(F.col("texts") >= LEAST_TEXTS).select(F.col("lang").alias("of"), "middle")
    middles = measured(middles, "octet_length(of) + 16")
    apart = sound.join(middles, F.col("lang") == F.col("of")).withColumn("apart", (F.col("x") - F.col("middle")) / F.col("spread"))
    quartiles = apart.groupBy("of").agg(F.first("middle").alias("middle"), F.percentile_approx("apart", [0.25, 0.75], 10_000).alias("q"))
    far = lambda distance: BAND * F.greatest(distance, F.lit(LEAST_SPREAD))
    bands = quartiles.select(F.col("of").alias("band"), "middle", far(-F.col("q")[0]).alias("below"), far(F.col("q")[1]).alias("above"))
    bands = measured(bands, "octet_length(band) + 32")
    joined = rows.join(bands, F.col("lang") == F.col("band"), "left")
    joined = joined.withColumn("low", F.col("middle") - F.col("below") * F.col("spread"))
    joined = joined.withColumn("high", F.col("middle") + F.col("above") * F.col("spread"))
    inside = F.coalesce((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")), F.lit(True))
    return joined.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("x").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"),
        (~F.col("base_failed") & inside).alias("kept"),
    )
