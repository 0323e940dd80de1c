"""Whitening, source divergence and token counts against brute force and the libraries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from devicelog.llm import divergence, token_counts, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, x STRING, n INT, weight DOUBLE, hash STRING"


def vectors(spark, given):
    return spark.createDataFrame([(i, v, 1, "x", 2, 0.5, "h") for i, v in given], VECTORS).repartition(3)


def brute_whitening(given, k=8):
    """Covariance and deviations over all rows, one by one, with Python's integers for what must be exact."""
    x = [(i, [int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v]) for i, v in given]
    n, sums = len(x), [sum(c) for c in zip(*(v for _, v in x))]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for _, v in x])
    covariance = centred.T @ centred / n
    values, parts = np.linalg.eigh(covariance)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for _, v in x]
    return n, deviations, centred @ parts / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("common", [1000, 3])
def test_whitening_equals_brute_force(spark, common):
    rng = np.random.default_rng(5)
    scale = np.linspace(3, 0.2, 12)
    given = [(i, (rng.normal(size=12) * scale).astype(np.float32).tolist()) for i in range(300)]
    given += [(1000 + i, given[7][1]) for i in range(150)] + [(1000, given[7][1]), (None, given[8][1])]
    bad = [(2000, None), (2001, [None] + [0.5] * 11), (2002, [float("nan")] + [0.5] * 11), (2003, [0.5] * 11 + [float("-inf")]),
           (2004, []), (2005, [1.0] * 11)]
    got = whitening.whiten(vectors(spark, given + bad), common=common).collect()
    n, deviations, coordinates, explained = brute_whitening(given)
    assert len(got) == 8 * len(given) and {r.n for r in got} == {n}
    order = sorted(range(len(given)), key=lambda k: (given[k][0] is not None, given[k][0] or 0, deviations[k]))
    for component in range(1, 9):
        own = sorted((r for r in got if r.component == component), key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.deviation))
        assert [r.vec_id for r in own] == [given[k][0] for k in order]
        assert [int(r.deviation) for r in own] == [deviations[k] for k in order]
        found, wanted = np.array([r.whitened for r in own]), coordinates[order, component - 1]
        sign = np.sign(found @ wanted)
        assert np.abs(found * sign - wanted).max() < 1e-8
        assert own[0].explained == pytest.approx(explained[component - 1], rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_weights_of_one_fit_distinct_vectors(spark):
    rng = np.random.default_rng(6)
    given = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(50)]
    got = whitening.whiten(vectors(spark, given + [(99, given[0][1])] * 40), weights="one").collect()
    n, deviations, _, explained = brute_whitening(given)
    assert {r.n for r in got} == {n} and len(got) == 4 * 90
    assert {int(r.deviation) for r in got if r.vec_id == 99} == {deviations[0]}
    assert sorted({r.explained for r in got}, reverse=True) == pytest.approx(list(explained), rel=1e-9)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, given), weights="two")


def test_whitening_without_variance_and_without_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in got] == [(None, 0.0, 0, None)] * 4
    one = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in one) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]


def test_wide_integers_stay_exact():
    x = np.array([[2**50, 3], [-(2**50), 4]], dtype=np.int64)
    exact = whitening._centred(x, 10**7, [5, 6])
    assert exact.tolist() == [[2**50 * 10**7 - 5, 3 * 10**7 - 6], [-(2**50) * 10**7 - 5, 4 * 10**7 - 6]]
    assert whitening._squares(exact) == [sum(int(v) ** 2 for v in row) for row in exact.tolist()]


def brute_audit(docs, least, top):
    counts, docs_with, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs_with[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs_with[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, all_of = shares(counts[lang, source]), shares(whole)
        pairs = []
        for s in sources:
            if s != source:
                other = shares(counts[lang, s])
                pairs.append((s, sum(abs(own[t] - other[t]) for t in kept)))
        terms = [(t, own[t] - all_of[t]) for t in kept if counts[lang, source][t] and own[t] > all_of[t]]
        for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def audit_docs(seed=3):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ab", "Cd", "é", "漢") for b in ("x", "Yz", "ñ", "qq", "o", "😀")]
    docs = []
    for k in range(400):
        lang = rng.choice(["en", "de", None])
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", "s4", None])
        # Some sources have a few of the terms only, so that blocks lack them.
        own = vocabulary[:3] if source in ("s3", "s4") else vocabulary
        text = "1".join(rng.choice(own) + rng.choice([" ", ".", "_"]) for _ in range(rng.randint(0, 9)))
        docs.append((rng.choice([text, text, text, None]), lang, source))
    docs += [("rare " * 50, "fr", "s1"), (None, "fr", "s2"), ("", "fr", "s3"), ("alone", "es", "s1")]
    docs += [(docs[0][0], docs[0][1], docs[0][2])] * 3
    return docs


@pytest.mark.parametrize(("block", "tile"), [(2048, 128), (3, 2), (1, 1)])
def test_audit_equals_brute_force(spark, block, tile):
    docs = audit_docs()
    schema = "text STRING, lang STRING, source STRING, term INT, count STRING, number DOUBLE, value INT"
    frame = spark.createDataFrame([(*d, 1, "c", 2.0, 3) for d in docs], schema).repartition(3)
    got = divergence.audit(frame, least_docs=8, top=5, block_terms=block, tile_sources=tile)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, 8, 5)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_trees_share_equal_subtrees_and_price_them_once():
    counts = np.array([[1, 0, 1, 0, 1, 0, 1, 0], [0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 1, 0, 0, 0, 0, 0]])
    trees = divergence.Trees(counts)
    assert [len(c) for c in trees.children] == [3, 2, 2]
    shares = np.array([[10, 17], [20, 29], [31, 45]])
    left, right = np.array([0, 0, 1]), np.array([1, 2, 2])
    wanted = [np.abs(shares[a][counts[a]] - shares[b][counts[b]]).sum() for a, b in zip(left, right)]
    assert trees.prices(left, right, shares).tolist() == wanted


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "_SLICE", 7)
    data = b"abc de fghijklmnop  q" * 20
    assert b"".join(divergence._slices(data)) == data
    assert sum((s.split() for s in divergence._slices(data)), []) == data.split()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def odd_texts(n, seed=8):
    rng = random.Random(seed)
    marks = list(" \n\t\x0b\x0c\r\x1c\x85  .,'_-½́漢İΣßﬁKTHE1२ǅÅͅ‍😀") + [chr(c) for c in range(0x80, 0x100)]
    marks += ["the", "ing", "'s", "'ll", "'RE", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_word_counts_equal_the_library(library):
    counter = token_counts.WordCounter(WORDS, limit=500)
    texts = odd_texts(6000) + ["", "the " * 3000, "x" * 20_000, "'s''s's", "the<|endoftext|>the", "İ"]
    got = [n for at in range(0, len(texts), 100) for n in counter.batch([t.encode() for t in texts[at : at + 100]])]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_proven_words_are_one_token_each(library):
    counter = token_counts.WordCounter(WORDS)
    assert len(counter.proven) > 30_000
    some = random.Random(1).sample(sorted(counter.proven), 2000)
    assert all(len(library.encode(w.decode(), add_special_tokens=False).ids) == 1 for w in some)
    # A vocabulary string that the merges do not reach, or that ends no word, is not among them.
    vocabulary = library.get_vocab()
    lost = [t for t in vocabulary if t.endswith("</w>") and t.isascii() and t[:-4].encode() not in counter.proven]
    assert all(library.encode(t[:-4], add_special_tokens=False).ids != [vocabulary[t]] for t in lost[:200])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_documents(documents, rows, name):
    texts = odd_texts(200)
    given = list(enumerate(texts)) + [(None, "null id"), (900, None), (901, "same"), (901, "same"), (902, "word " * 3000)]
    path = public_tokenizers.path(name)
    got = rows(token_counts.count_tokens(documents(given), path, carry=["lang", "found"]))
    assert len(got) == len(given)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        whole = Tokenizer.from_file(path)
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    texts_of = {i: t or "" for i, t in given}
    for r in got[:40] + got[-8:]:
        text = texts_of[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), count(text))
        assert r["over_limit"] == (r["n_tokens"] > 2048) and (r["lang"], r["found"]) == ("en", 2.0)
    assert token_counts.count_tokens(documents([(1, "a")]).filter("doc_id < 0"), path).count() == 0
