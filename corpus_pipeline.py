"""A corpus of documents, cleaned and tokenized in five stages.

Each stage gets what the one before kept. All but the last return the columns of
documents: toxic documents go, one document of each near-duplicate group stays,
repeated byte strings are cut out of the texts, contaminated documents go; the
last returns token counts and digests of ids and decoded texts.

In every stage null texts are empty texts, rows without a doc_id are kept unless
their text is toxic or contaminated, repeated rows are judged alike (near-duplicate
removal leaves one of equal rows), an empty table gives an empty table, and further
columns are kept whatever their names; only the last stage puts its own n_tokens,
ids_sha256 and decoded_sha256 in place of columns of these names.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from devicelog.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity  # noqa: E402
from devicelog.session import written  # noqa: E402


def _with_plain_names(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with all columns but doc_id and text renamed, so that none clashes with an operator's own."""
    names = [c if c in ("doc_id", "text") else f"document_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [c for c in names if c not in ("doc_id", "text")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, others = _with_plain_names(docs)
    # The text is scored, and carried under a name of its own.
    scored = toxicity.score(plain.withColumn("document_text", F.col("text")), model, carry=[*others, "document_text"])
    kept = scored.filter("predicted = 0").withColumnRenamed("document_text", "text")
    return kept.select(plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles that differ in at most three bits; the smallest doc_id stays."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes go from the texts; a character cut in two is replaced by U+FFFD."""
    plain, others = _with_plain_names(docs)
    kept = suffix_dedup.remove_repeats(plain, carry=others)
    kept = kept.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).select(plain.columns).toDF(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain, others = _with_plain_names(docs)
    names = dict(zip(plain.columns, docs.columns))
    others = [c for c in others if names[c].lower() not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    found = bpe.round_trip(plain, ranks, public_tokenizers.PATTERN, carry=others)
    return found.select("doc_id", *others, "n_tokens", "ids_sha256", "decoded_sha256").withColumnsRenamed({c: names[c] for c in others})


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokenize),
]

#: Hash functions, a fitted model and tokenization are beyond SQL; tests hold the stages one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
