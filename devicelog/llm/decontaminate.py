"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Each window of ``length`` consecutive words of a benchmark item (a shorter item
is one window) is looked up by its two rarest words in the corpus. The index has,
for each of those words and each document, the list of positions. The list of
the rarest word and that of the second rarest, both moved by the words' offsets
in the window, are intersected per document; what remains is compared with the
document's words. Windows that no document can hold never leave the index.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelog.llm.sizes import measured
from devicelog.session import written

#: Words before A-Z are lower-cased; letters outside ASCII stay as they are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case. Most words have no capital at all, which ``lower`` tells faster."""
    slow = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.lower(word) == word, word).otherwise(slow)


def raw_words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def words_of(text: str) -> Column:
    return F.transform(raw_words(text), lowered)


def item_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """phrase, words and the items (as text, sorted) of each distinct window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of("text").alias("w"))
    items = items.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(length)))).alias("words"))
    return each.groupBy(F.array_join("words", " ").alias("phrase")).agg(
        F.first("words").alias("words"), F.sort_array(F.collect_set("item")).alias("items")
    )


def _documents(docs: DataFrame) -> DataFrame:
    """A key of each text (rows that share doc_id and text have one), and the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def rarest_terms(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """phrase, words, items and ``t1``, ``o1``, ``t2``, ``o2``: each window's two rarest words and their offsets."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    terms = measured(terms, "octet_length(term) + 24")
    spoken = documents.select(F.explode(raw_words("text")).alias("word")).select(lowered(F.col("word")).alias("term"))
    counts = spoken.join(terms, "term").groupBy("term").count()
    counts = measured(counts, "octet_length(term) + 32")
    placed = windows.select("phrase", F.posexplode("words").alias("o", "term")).join(counts, "term")
    # A window one of whose words is nowhere in the corpus has fewer rows here than words.
    order = Window.partitionBy("phrase").orderBy("count", "o")
    ranked = placed.withColumn("r", F.row_number().over(order)).groupBy("phrase").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("r") == 1, F.struct("term", "o"))).alias("a"),
        F.max(F.when(F.col("r") == 2, F.struct("term", "o"))).alias("b"),
    )
    found = windows.join(ranked, "phrase").filter(F.col("n") == F.size("words"))
    second = F.coalesce("b", "a")
    return found.select(
        "phrase", "words", "items",
        F.col("a.term").alias("t1"), F.col("a.o").alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"),
    )


def build_index(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The stored index: term, doc_id, h and the sorted ``positions`` of the looked-up terms."""
    terms = chosen.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    terms = measured(terms, "octet_length(term) + 24")
    spoken = documents.select("doc_id", "h", F.posexplode(raw_words("text")).alias("position", "word"))
    postings = spoken.withColumn("term", lowered(F.col("word"))).join(terms, "term")
    # Equal rows of a document give equal postings, which count once.
    lists = postings.groupBy("term", "doc_id", "h").agg(F.sort_array(F.collect_set("position")).alias("positions"))
    return written(lists)


_LISTED = "octet_length(phrase) * 2 + octet_length(t1) + octet_length(t2) + 128"


def candidates(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """phrase, doc_id, h and ``starts``: where the two rarest words stand as far apart as in the window."""
    first, second = index.alias("p"), index.select(
        F.col("term").alias("t2"), F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("positions").alias("p2")
    )
    keys = measured(chosen.select("phrase", "t1", "o1", "t2", "o2"), _LISTED)
    a = first.join(keys, F.col("term") == F.col("t1"))
    both = a.join(second, (a.t2 == second.t2) & a.doc_id.eqNullSafe(second.d2) & (a.h == second.h2))
    starts = F.expr("filter(array_intersect(transform(positions, x -> x - o1), transform(p2, x -> x - o2)), x -> x >= 0)")
    return both.select("phrase", "doc_id", "h", starts.alias("starts")).filter(F.size("starts") > 0)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, length: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, phrase, items and position where a window's two rarest words stand at most ``slop`` words nearer or
    further apart than in the window; exact matches included."""
    documents = _documents(docs)
    chosen = written(rarest_terms(documents, written(item_windows(benchmark, length))))
    index = build_index(documents, chosen)
    second = index.select(
        F.col("term").alias("t2"), F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("positions").alias("p2")
    )
    a = index.join(measured(chosen.select("phrase", "items", "t1", "o1", "t2", "o2"), _LISTED), F.col("term") == F.col("t1"))
    both = a.join(second, (a.t2 == second.t2) & a.doc_id.eqNullSafe(second.d2) & (a.h == second.h2))
    near = F.expr(f"filter(positions, x -> exists(p2, y -> abs((y - x) - (o2 - o1)) <= {int(slop)}))")
    return both.select("doc_id", "phrase", "items", F.explode(near).alias("position")).distinct()


def exact_matches(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, h and ``found``, an array of (start, n, phrase): every place where a window stands in a text."""
    documents = _documents(docs)
    windows = written(item_windows(benchmark, length))
    chosen = written(rarest_terms(documents, windows))
    maybe = written(candidates(build_index(documents, chosen), chosen))
    per_document = (
        maybe.join(measured(windows.select("phrase", "words"), "octet_length(phrase) * 2 + 64"), "phrase")
        .select("doc_id", "h", F.explode("starts").alias("start"), "words", "phrase")
        .groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct("start", F.size("words").alias("n"), "words", "phrase")).alias("maybe"))
    )
    keys = measured(per_document.select(F.col("doc_id").alias("d"), F.col("h").alias("g")), "40")
    some = documents.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
    some = some.dropDuplicates(["doc_id", "h"]).withColumn("w", words_of("text"))
    a, b = some.alias("a"), per_document.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")))
    found = F.filter("b.maybe", lambda m: F.slice("a.w", m["start"] + 1, m["n"]) == m["words"])
    found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["n"].alias("n"), m["phrase"].alias("phrase")))
    return joined.select("a.doc_id", "a.h", found.alias("found")).filter(F.size("found") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as text), contaminated.

    n_hit counts words inside any occurrence of a window. Null texts have no
    words; items without a word have no window; an item_id that is null is the
    text "null"; repeated rows stay; empty tables and columns of other names
    make no difference.
    """
    windows_of = item_windows(benchmark, length).select("phrase", "items")
    found = written(exact_matches(docs, benchmark, length))
    n_hit = F.size(
        F.array_distinct(
            F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["n"] - 1)))
        )
    ).cast("long")
    hits = found.select("doc_id", "h", n_hit.alias("n_hit"))
    phrases = found.select("doc_id", "h", F.explode("found.phrase").alias("phrase")).distinct()
    named = phrases.join(measured(windows_of, "octet_length(phrase) + 64 + 24 * size(items)"), "phrase")
    items = named.select("doc_id", "h", F.explode("items").alias("item")).groupBy("doc_id", "h")
    items = items.agg(F.sort_array(F.collect_set("item")).alias("items"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = _documents(docs).select("doc_id", "h", n_words.alias("n_words"))
    on = lambda left, right: left.doc_id.eqNullSafe(right.doc_id) & (left.h == right.h)
    both = hits.join(items, on(hits, items)).select(hits.doc_id, hits.h, "n_hit", "items")
    joined = rows.join(both, on(rows, both), "left")
    return joined.select(
        rows.doc_id,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The documents without a window of the benchmark; columns and order of columns stay."""
    found = exact_matches(docs, benchmark, length).select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("hit_h"))
    return docs.join(measured(found, "40"), on, "left_anti")
