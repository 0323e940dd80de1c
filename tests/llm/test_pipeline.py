"""The stages of the pipeline, one after the other, each against a brute-force version of it."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from test_dedup import fingerprint

import corpus_pipeline
from devicelog.llm import bpe, simhash

COLUMNS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, predicted STRING, kept INT, Score DOUBLE, ids_sha256 STRING, k0 INT, n_tokens STRING"
BENCH = [f"bench{i} " + " ".join(f"item{i}x{k}" for k in range(14)) for i in range(4)]


def planted():
    """Clean texts; toxic ones with one of a few words; near and exact copies; shared passages; benchmark text."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ra", "te", "no") for c in ("s", "n", "ld", "mp", "x")]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    rows, toxic = [], {}
    for i in range(240):
        body = text(rng.randint(30, 120))
        toxic[i] = int(i % 6 == 0)
        if toxic[i]:
            spot = body.split(" ")
            for _ in range(3):
                spot.insert(rng.randrange(len(spot)), rng.choice(["scoundrel", "vermin"]))
            body = " ".join(spot)
        rows.append((i, body))
    passage = text(40)
    rows += [(300 + k, text(20) + " " + passage + " " + text(20)) for k in range(6)]
    rows += [(400 + k, text(15) + " " + BENCH[k] + " " + text(15)) for k in range(4)]
    rows += [(500, rows[1][1]), (501, rows[1][1] + "\n"), (502, rows[2][1].upper()), (503, "é" * 40 + passage)]
    # Long texts with one word changed: their fingerprints differ in few bits.
    long = text(3000)
    rows += [(600, long), (601, long.replace(" ", " changed ", 1)), (602, text(3000))]
    rows += [(700, None), (701, ""), (None, text(50)), (702, rows[3][1]), (702, rows[3][1])]
    return rows, toxic


def frames(spark, folder, rows, toxic):
    full = [(i, t, "en", "s", None if t is None else len(t), "p", 1, 0.5, "x", 7, "t") for i, t in rows]
    docs = spark.createDataFrame(full, COLUMNS).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def one_of_each_group(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted({r for k, r in enumerate(rows) if r[0] is None or least[find(k)] == r[0]}, key=repr)


def without_repeats(rows, length=100):
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in order:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        out.append((i, bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "replace")))
    return sorted(out, key=repr)


def uncontaminated(rows):
    windows = set()
    for item in BENCH:
        words = item.split()
        windows |= {tuple(words[k : k + 10]) for k in range(len(words) - 9)}

    def hit(text):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        return any(tuple(words[k : k + 10]) in windows for k in range(len(words) - 9))

    return [r for r in rows if not hit(r[1])]


def test_every_stage_equals_brute_force(spark, folder):
    rows, toxic = planted()
    docs = frames(spark, folder, rows, toxic)
    stages = dict(corpus_pipeline.STAGES)
    held_out = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]

    kept = corpus_pipeline.written(stages["toxicity"](spark, docs, folder))
    assert kept.columns == docs.columns
    left = {i for i, _ in pairs(kept)}
    assert {i for i in held_out if toxic[i]}.isdisjoint(left) and {i for i in held_out if not toxic[i]} <= left
    assert {i for i, _ in rows if i is None or i >= 240} <= left

    first = corpus_pipeline.written(stages["simhash_near_dedup"](spark, kept, folder))
    assert first.columns == docs.columns and pairs(first) == one_of_each_group(pairs(kept))
    assert {500, 501, 502, 601, 701}.isdisjoint({i for i, _ in pairs(first)}) and 602 in {i for i, _ in pairs(first)}

    cut = corpus_pipeline.written(stages["suffix_array_dedup"](spark, first, folder))
    assert cut.columns == docs.columns and pairs(cut) == without_repeats(pairs(first))
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert pairs(cut) != pairs(first)

    clean = corpus_pipeline.written(stages["benchmark_decontamination"](spark, cut, folder))
    assert clean.columns == docs.columns and pairs(clean) == uncontaminated(pairs(cut))
    assert {400, 401, 402, 403}.isdisjoint({i for i, _ in pairs(clean)})

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, text in pairs(clean):
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        wanted.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    last = stages["byte_level_bpe"](spark, clean, folder)
    assert last.columns == ["doc_id", "lang", "source", "n_chars", "predicted", "kept", "Score", "k0", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in whole.collect()], key=repr) == sorted(wanted, key=repr)
    assert {(r.predicted, r.kept, r.Score, r.k0) for r in whole.collect()} == {("p", 1, 0.5, 7)}


def test_stages_of_an_empty_table(spark, folder):
    rows, toxic = planted()
    docs = frames(spark, folder, rows, toxic).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        assert found.count() == 0
        docs = found if "text" in found.columns else docs


def test_whole_texts_go_to_python_in_small_batches(spark, folder):
    """Batches of Spark's default size, 64 MB, were held by the JVM and by each worker."""
    given = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat(id, ' words '), 500) AS text")
    given.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    corpus_pipeline.drop_toxic(spark, docs, folder)
    found = docs.select("text").mapInArrow(lambda batches: (b.select(["text"]).slice(0, 1) for b in batches), "text string")
    assert found.count() >= 5
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)


def test_dropping_near_copies_does_not_shuffle_the_texts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        docs = spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text")
        found = spark.range(50).selectExpr("id AS doc_id", "id - id % 2 AS component_id")
        kept = simhash.without_later(docs, found)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 50, 2))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
