"""Suffix, substring and SimHash dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import xxhash

from devicelog.llm import blocks, simhash, sizes, substring_dedup, suffix_dedup
from devicelog.llm.components import components
from devicelog.session import written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def corpus(seed: int = 1):
    """Random words with shared passages, copies, a periodic text, ties, a null and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(18)
    out = []
    for i in range(60):
        body = text(rng.randint(1, 120))
        if i % 3 == 0:
            cut = rng.randint(0, 30)
            body = body + " " + passage[cut : len(passage) - rng.randint(0, 90)] + " " + text(5)
        if i % 4 == 0:
            body = line + "\n" + body + "\t\t" + line
        out.append((i, body))
    out += [(100, out[3][1]), (101, out[3][1]), (102, "ab " * 400), (103, "x" * 700), (104, ""), (105, None), (None, passage)]
    return out + [(106, "ab " * 90 + text(4))]


def removed_bytes(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup_equals_brute_force(documents, rows, hot):
    given = corpus()
    got = rows(suffix_dedup.remove_repeats(documents(given), hot=hot, carry=["lang", "found"]))
    expected = removed_bytes(given)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == expected
    assert sum(e[1] for e in expected.values()) > 1000
    assert {(r["lang"], r["found"]) for r in got} == {("en", 2.0)}


def test_suffix_dedup_deals_out_a_hot_line(documents, rows, monkeypatch):
    """A line of one trigger between unlike texts: its windows are spread over the buckets, with the same result."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    # Of many lines of 36 bytes, the one whose trigger wins over its neighbours.
    lines = [text(36) for _ in range(3000)]
    line = min(lines, key=lambda x: int(suffix_dedup._trigger_hashes(np.frombuffer((x + "." * 64).encode(), dtype=np.uint8))[0]))
    given = [(i, text(150) + line + text(150)) for i in range(60)] + [(70 + i, "z" * 80 + line + "y" * 80) for i in range(3)]
    buckets = []
    settle = suffix_dedup.B.settle
    monkeypatch.setattr(suffix_dedup.B, "bucket_count", lambda *a: 16)

    def settled(frame, decide):
        buckets[:] = (r.bucket for r in frame.select("bucket").distinct().collect())
        return settle(frame, decide)

    monkeypatch.setattr(suffix_dedup.B, "settle", settled)
    got = rows(suffix_dedup.remove_repeats(documents(given), hot=5))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed_bytes(given)
    assert len(buckets) == 16


def test_suffix_ranks_are_the_order_of_suffixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    at = np.arange(0, 2800, 3)
    ranks = suffix_dedup.suffix_ranks(text, at, 100)
    raw = text.tobytes()
    suffixes = [raw[a : a + 100] for a in at]
    place = {s: i for i, s in enumerate(sorted(set(suffixes)))}
    assert ranks.tolist() == [place[s] for s in suffixes]


def test_suffix_ranks_take_few_arrays_of_the_text():
    text = np.random.default_rng(4).integers(97, 99, 1_000_000).astype(np.uint8)
    at = np.arange(len(text) - 99)
    tracemalloc.start()
    suffix_dedup.suffix_ranks(text, at, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 * len(text)


def removed_words(rows, length=13):
    first, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if first.setdefault(tuple(words[k : k + length]), doc_id) != doc_id:
                gone[k : k + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_blocks_get_no_paths_sent(documents):
    """Their paths would be more bytes than the texts; blocks make them again."""
    text = " ".join(f"w{i}" for i in range(60))
    made = blocks.make_blocks(documents([(1, text), (2, f"x {text}"), (3, "y")]))
    found = [blocks.unpack(p)[0] for r in substring_dedup.repeated_paths(made).collect() for p in r.found or []]
    kinds = {f for f in found if isinstance(f, bytes)}
    assert b"least" in kinds and b"path" not in kinds


def test_substring_dedup_equals_brute_force(documents, rows):
    given = corpus(2)
    got = rows(substring_dedup.remove_repeated_words(documents(given), carry=["source"]))
    expected = removed_words(given)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == expected
    assert sum(e[1] for e in expected.values()) > 200


def test_equal_doc_ids_are_not_earlier_than_each_other(documents, rows):
    text = " ".join(f"w{i}" for i in range(30))
    got = rows(substring_dedup.remove_repeated_words(documents([(1, text), (1, text), (2, text)])))
    assert [r["n_removed"] for r in got] == [0, 0, 30]
    got = rows(suffix_dedup.remove_repeats(documents([(1, text), (1, text)])))
    assert sorted(r["n_removed"] for r in got) == [0, len(text)]


def test_dedup_of_empty_tables(documents):
    empty = documents([(1, "a")]).filter("doc_id < 0")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeated_words(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_equals_brute_force(documents, rows):
    rng = random.Random(5)
    base = [f"Word{rng.randint(0, 999)}" for _ in range(300)]
    given = [(0, None), (1, ""), (2, "one"), (3, "One two"), (4, "ONE\ttwo")]
    for i in range(5, 60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = "changed"
        given.append((i, " ".join(words)))
    given += [(70, given[9][1]), (None, given[9][1])]
    got = rows(simhash.near_duplicates(documents(given)))
    prints = {i: fingerprint(t) for i, t in given}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in prints.items()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(prints)
    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i in ids:
        if i is not None:
            least[root(i)] = min(least.get(root(i), i), i)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[root(i)] for i in ids}
    kept = [r["doc_id"] for r in rows(simhash.keep_first(documents(given + [given[5]])))]
    assert kept == [None, *sorted(set(least.values()))]


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(7)
    code = simhash.Golay()
    a = rng.integers(-(2**63), 2**63, 3000)
    b = a.view(np.uint64).copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 1 + i % 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    own = set(zip(*(x.tolist() for x in simhash.golay_keys(a, code))))
    met = {p for p, k in zip(*(x.tolist() for x in simhash.golay_keys(b.view(np.int64), code))) if (p, k) in own}
    assert len(met) == len(a)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (5, 5)], "u LONG, v LONG")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def five_word_sets(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_keys_of_fingerprints_are_never_broadcast(spark):
    """Their rows are about a hundred times those that Spark sizes them by, so a broadcast may not fit the driver."""
    prints = written(spark.createDataFrame([(i * 7919,) for i in range(50)] + [(1,), (3,)], "fp LONG"))
    found = simhash.links(prints)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert (1, 3) in {tuple(r) for r in found.collect()}


def test_tables_measured_as_large_are_shuffled(spark, monkeypatch):
    """Files of few bytes do not make Spark broadcast what was measured as large."""
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 80)
    rows = spark.range(30).withColumnRenamed("id", "k")
    small, large = sizes.measured(rows.filter("k < 10"), "8"), sizes.measured(rows.filter("k < 11"), "8")
    plans = {n: rows.join(t, "k")._jdf.queryExecution().executedPlan().toString() for n, t in ((10, small), (11, large))}
    assert "BroadcastHashJoin" in plans[10] and "SortMergeJoin" in plans[11]
    assert rows.join(large, "k").count() == 11


def test_large_answers_are_shuffled_to_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 1)
    many = spark.createDataFrame([(1, b"a"), (2, b"b")], "block_id LONG, data BINARY")
    answers = spark.createDataFrame([(1, b"xy"), (1, b"z")], "block_id LONG, payload BINARY")
    joined = blocks.with_found(many, answers)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert {r.block_id: sorted(map(bytes, r.found or [])) for r in joined.collect()} == {1: [b"xy", b"z"], 2: []}
