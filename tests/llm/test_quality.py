"""Toxicity, perplexity rules, page wrappers, decontamination, the pipeline and the registered queries."""

from __future__ import annotations

import collections
import difflib
import html
import os
import random
import re
import shutil
import sys
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from devicelog.llm import decontaminate, perplexity, queries, toxicity, wrappers

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import connect, difference  # noqa: E402


def toxic_rows(n=400):
    rng = random.Random(1)
    out = []
    for i in range(n):
        words = [f"w{rng.choice('abcdefgh') * 2}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "zz" + rng.choice("abc") + "x"])
            words[rng.randrange(len(words))] = "Scoundrel,"
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark, documents, rows):
    given = toxic_rows()
    docs = documents([(i, t) for i, t, _ in given] + [(1000, None), (1001, ""), (None, "scoundrel")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in given], "doc_id LONG, quality INT, toxic INT")
    got = rows(toxicity.score(docs, toxicity.fit(docs, labels), carry=["key"]))
    truth = {i: y for i, _, y in given}
    assert len(got) == len(given) + 3
    for r in got:
        if r["doc_id"] in truth:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == truth[r["doc_id"]]
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["key"] == "x"
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1000]["predicted"] == by_id[1001]["predicted"] == 0 and by_id[None]["predicted"] == 1


def test_toxicity_never_learns_from_held_out_rows(spark, documents):
    given = toxic_rows()
    docs = documents([(i, t) for i, t, _ in given])
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in given]
    make = lambda r: spark.createDataFrame(r, "doc_id LONG, toxic INT")
    a = toxicity.fit(docs, make([(i, y) for i, _, y in given]))
    b = toxicity.fit(docs, make(flipped))
    assert a.terms == b.terms and abs(a.bias - b.bias) < 1e-9


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id LONG, toxic INT")
    docs = documents([(1, "a b"), (2, None)])
    assert toxicity.score(docs, toxicity.fit(docs, none)).filter("predicted = 1").count() == 0
    assert toxicity.score(docs.filter("doc_id < 0"), toxicity.fit(docs.filter("doc_id < 0"), none)).count() == 0


def test_toxicity_of_a_long_tail_of_terms(spark, documents, rows):
    """Each toxic text has one of 50 terms, once and late, in four languages; one label in a hundred is wrong."""
    rng = random.Random(5)
    syllables = {"en": "th er ing on", "de": "sch ein ung zu", "es": "ción os la ra", "fr": "eau eux le ment"}
    terms = [f"vile{a}{b}" for a in "bcdfghjklm" for b in ("ox", "um", "ath", "eg", "ur")]
    given = []
    for i in range(6500):
        some = syllables[rng.choice(list(syllables))].split()
        words = ["".join(rng.choice(some) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 90))]
        toxic = i % 4 == 0
        if toxic:
            words[-rng.randint(1, 10)] = rng.choice(terms)[::-1] + "z"  # no common beginnings
        given.append((i, " ".join(words), int(toxic), int(toxic) ^ (rng.random() < 1 / 100)))
    docs = documents([(i, t) for i, t, _, _ in given])
    labels = spark.createDataFrame([(i, label) for i, _, _, label in given], "doc_id LONG, toxic INT")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in rows(toxicity.score(docs, model))}
    caught = [got[i]["predicted"] for i, _, toxic, _ in given if toxic and got[i]["held_out"]]
    wrong = [got[i]["predicted"] for i, _, toxic, _ in given if not toxic and got[i]["held_out"]]
    assert len(model.terms) >= 40 and sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.01 * len(wrong)


def test_toxicity_without_telling_terms_calls_nothing_toxic(spark, documents):
    rng = random.Random(9)
    given = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(20))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i, _ in given], "doc_id LONG, toxic INT")
    docs = documents(given)
    assert toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").count() == 0


def test_toxicity_labels_of_equal_texts_are_settled(spark, documents):
    rows = [(i, "one text") for i in range(10)] + [(i, "other text") for i in range(10, 20)] + [(i, "third") for i in range(20, 40)]
    labels = spark.createDataFrame([(i, int(i % 10 < 8)) for i in range(20)] + [(i, int(i % 10 < 3)) for i in range(20, 40)], "doc_id LONG, toxic INT")
    found = {r.text: r.toxic for r in toxicity._sample(documents(rows), labels).collect()}
    assert found["third"] == 0 and found["one text"] == 1


def test_label_model_equals_plain_expectation_maximisation(spark):
    rng = np.random.default_rng(3)
    truth, rates = rng.random(3000) < 0.2, np.array([[0.4, 0.02], [0.3, 0.01], [0.2, 0.05], [0.5, 0.3]])
    x = rng.random((3000, 4)) < np.where(truth[:, None], rates[:, 0], rates[:, 1])
    sets = collections.Counter(tuple(int(k) for k in np.flatnonzero(row)) for row in x)
    counts = spark.createDataFrame([(list(v), n) for v, n in sets.items()], "votes ARRAY<INT>, n LONG").repartition(3)
    start = [(str(k), 0.3, 0.03, 1.0) for k in range(4)]
    got = toxicity._label_model(counts, start, 0.2)
    t1, t0 = np.full(4, 0.3), np.full(4, 0.03)
    for _ in range(toxicity.ROUNDS):
        odds = np.log(0.2 / 0.8) + (x * np.log(t1 / t0) + ~x * np.log((1 - t1) / (1 - t0))).sum(axis=1)
        q = 1 / (1 + np.exp(-odds))
        t1, t0, before = (q @ x + 0.1) / (q.sum() + 1), ((1 - q) @ x + 0.001) / ((1 - q).sum() + 1), t1
        if abs(t1 - before).max() < 1e-4:
            break
    assert np.allclose([v[1] for v in got], t1) and np.allclose([v[2] for v in got], t0)
    # Weights: one over one more than the agreement beyond the classes.
    odds = np.log(0.2 / 0.8) + (x * np.log(t1 / t0) + ~x * np.log((1 - t1) / (1 - t0))).sum(axis=1)
    q = 1 / (1 + np.exp(-odds))
    for i, v in enumerate(got):
        extra = 0.0
        for j in set(range(4)) - {i}:
            parts = []
            for w, t in ((q, t1), (1 - q, t0)):
                both = (w @ (x[:, i] & x[:, j])) / w.sum() - t[i] * t[j]
                parts.append(w.sum() / 3000 * max(0.0, both / np.sqrt(t[i] * (1 - t[i]) * t[j] * (1 - t[j]))))
            extra += min(sum(parts), 1.0)
        assert abs(v[3] - 1 / (1 + extra)) < 0.02


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        again += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


@pytest.mark.parametrize("array_rows", [perplexity.ARRAY_ROWS, 0])
def test_quality_rules(spark, documents, rows, monkeypatch, array_rows):
    monkeypatch.setattr(perplexity, "ARRAY_ROWS", array_rows)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["the", "and", "house", "garden", "walks", "é#"]) for _ in range(rng.randint(22, 300)))
    junk = "".join(chr(rng.randrange(33, 127)) + " " * (rng.random() < 0.2) for _ in range(2000))
    given = [(i, text()) for i in range(60)] + [(70, junk), (71, None), (72, ""), (73, "a b"), (74, "x y z u v w q r\n" * 9), (74, "t")]
    got = rows(perplexity.judge(documents(given)))
    assert len(got) == len(given)
    expected = collections.Counter((i, base_counts(t or "")) for i, t in given)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter((r["doc_id"], tuple(r[n] for n in names)) for r in got) == expected
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept >= {r["doc_id"] for r in got if r["doc_id"] < 60 and not r["base_failed"]} and 70 not in kept


def test_model_probabilities_sum_to_one(documents):
    rng = random.Random(6)
    docs = documents([(i, "".join(rng.choice("ab c") for _ in range(200))) for i in range(40)])
    model = perplexity.kneser_ney(perplexity.count_grams(docs))
    arrays = perplexity.HashArrays(*perplexity.hash_arrays(model.toArrow()))
    for lang in ("en\t0", "en\t1"):
        for context in (b"ab ", b"a a", b"zab"):
            total = np.exp(arrays.log_probabilities(lang, (int.from_bytes(context, "big") << 8) + np.arange(256))).sum()
            assert abs(total - 1) < 1e-3
    # A language without a model: each byte is as likely as any other.
    assert np.allclose(arrays.log_probabilities("xx\t0", np.arange(3)), -np.log(256.0))


def sound_text(rng, lang, n):
    """Words of a language's syllables, frequent ones often."""
    syllables = {"en": "the an re ing on sta ver tion ed ble ou".split(), "es": "que la de os ción ra mi ño lle as".split()}[lang]
    words = [rng.choice(syllables) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def test_perplexity_bands_reject_junk_and_keep_sound_texts(spark, rows):
    rng = random.Random(12)
    sound = [(i, "en" if i % 3 else "es", sound_text(rng, "en" if i % 3 else "es", rng.randint(20, 250))) for i in range(600)]
    # A third of the rows of a language are one text.
    sound += [(1000 + i, "en", sound[1][2]) for i in range(200)]
    consonants = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9)))
    junk = [(2000 + i, "en", " ".join(consonants() for _ in range(rng.choice([25, 40, 200])))) for i in range(30)]
    junk += [(2100 + i, "es", "".join(chr(rng.randrange(33, 127)) + " " * (k % 5 == 0) for k in range(400))) for i in range(10)]
    junk += [(2200 + i, "en", sound_text(rng, "es", 60)) for i in range(5)]  # another language
    # Frequent words only, drawn anew: likelier than other texts, though hardly below the band.
    likely = [(2300 + i, "es", " ".join(rng.choice(["de", "que", "la"]) for _ in range(400))) for i in range(3)]
    few = [(3000 + i, "xx", sound_text(rng, "en", 30) + str(i)) for i in range(perplexity.LEAST_TEXTS - 1)]
    frame = spark.createDataFrame(sound + junk + likely + few, "doc_id LONG, lang STRING, text STRING").repartition(5)
    got = {r["doc_id"]: r for r in rows(perplexity.judge(frame))}
    judged = lambda some: [got[i]["kept"] for i, _, _ in some if not got[i]["base_failed"]]
    assert sum(judged(sound[:600])) >= 0.95 * len(judged(sound[:600])) and all(judged(sound[600:]))
    assert len(judged(junk)) > 40 and not any(judged(junk)), [(i, got[i]["perplexity"], got[i]["low"], got[i]["high"]) for i, _, _ in junk if got[i]["kept"]]
    es = sorted(got[i]["perplexity"] for i, lang, _ in sound[:600] if lang == "es")
    assert all(got[i]["perplexity"] < es[10] for i, _, _ in likely)
    assert all(judged(few)) and got[3000]["low"] is None


def test_quality_of_an_empty_table(documents):
    assert perplexity.judge(documents([(1, "a")]).filter("doc_id < 0")).count() == 0


PAGE = (
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul>{items}</ul></nav>"
    "<div class='ad'>buy</div>{notice}<{tag}><h2>T&eacute;st {n} &amp; m&am</h2><p>One <b>t</b>wo {n}<br>x<p>three {n}</{tag}>"
    "<div class='comments'><p>first!</p></div><form>f</form><footer>&copy; x</footer></body></html>"
)


def page(n, tag="article"):
    items = "<li><a>m</a></li>" * (n % 4 + 1)
    return PAGE.format(n=n, tag=tag, items=items, notice="<p class='cookie-notice'>ok</p>" * (n % 2))


def test_main_text(spark, rows):
    given = [(i, f"https://h{i % 2}.org/{i}", page(i, "article" if i % 2 else "section"), 1) for i in range(20)]
    given += [(50, None, None, 1), (51, "no url", "", 1), (52, "x://y/z", "plain < text &lt;", 1), (53, "http://h0.org", page(3)[:300], 1)]
    frame = spark.createDataFrame(given, "page_id LONG, url STRING, html STRING, rules INT")
    got = {r["page_id"]: r for r in rows(wrappers.main_text(frame), "page_id")}
    for i in range(20):
        assert got[i]["text"] == f"Tést {i} & m&am One two {i} x three {i}"
    assert (got[50]["text"], got[51]["text"], got[52]["text"]) == ("", "", "plain < text <")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrappers.main_text(frame.filter("page_id < 0")).count() == 0


ARTICLE = "<article><header><h1>Head {n}</h1></header><p class='notice-board'>board {n} words</p><p>body {n} text</p><div class='share'>x</div></article>"


@pytest.mark.parametrize("around", [
    "<body class='left-sidebar'>{}", "<html class='no-js nav-closed'><body>{}", "<body><div class='content-with-sidebar'>{}</div>",
    "<body><div id='menu-{{n}}' class='sidebar'>{}<nav><a>m</a></nav></div>",
])
def test_names_around_the_article_do_not_matter(around):
    pages = [around.format(ARTICLE).format(n=n) for n in range(6)]
    for few in (pages, pages[:1]):
        rules = wrappers.rules_of(wrappers.infer(few))
        for n, page in enumerate(pages):
            assert wrappers.extract(page, rules) == wrappers.extract(page, {}) == f"Head {n} board {n} words body {n} text"


def plain_page(n):
    """No article element, no telling class names; the number of menu items and paragraphs differs."""
    rng = random.Random(n)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    body = [words(rng.randint(20, 50)) for _ in range(rng.randint(1, 7))]
    menu = "".join(f"<li><a href='/{n}'>{words(2)}</a></li>" for _ in range(rng.randint(3, 9)))
    promo = "<div class='z'><b>Join our club</b></div>" if n % 2 else ""
    text = f"<h2>{words(4)}</h2>" + "".join(f"<p>{p}</p>" for p in body)
    page = f"<body><div><ul>{menu}</ul></div>{promo}<div class='x{n}'>{text}<h4>Printed in our house</h4></div><div><span>Made by {n % 3}</span></div></body>"
    return page, " ".join(re.sub("<[^>]*>", " ", text).split())


def test_wrapper_decides_where_no_tag_names_the_article(spark, rows):
    pages = [plain_page(n) for n in range(40)]
    rules = wrappers.rules_of(wrappers.infer([p for p, _ in pages]))
    assert all(wrappers.extract(p, rules) == text != wrappers.extract(p, {}) for p, text in pages)
    given = [(i, "http://one.org/" + str(i), p) for i, (p, _) in enumerate(pages)] * 2
    frame = spark.createDataFrame(given, "page_id LONG, url STRING, html STRING").repartition(20)
    got = rows(wrappers.main_text(frame), "page_id")
    assert len(got) == 80 and all(r["text"] == pages[r["page_id"]][1] for r in got)


def test_wrappers_match_what_they_were_aligned_with():
    nodes = [wrappers.folded(wrappers.page_nodes(plain_page(n)[0])) for n in range(30)]
    a, b = wrappers.infer([plain_page(n)[0] for n in range(15)]), wrappers.infer([plain_page(n)[0] for n in range(15, 30)])
    whole = wrappers.HostWrapper.loads(a.with_(b).dumps())
    assert whole.pages == 30 and len(whole.hashes) == wrappers.LEAST_PAGES
    flat = lambda ns: [(wrappers._body(n), n[0] == "repeat", o) for n, o in wrappers._flat(ns, 0)]
    need = flat(whole.nodes)
    for own in map(flat, nodes):  # every page is the wrapper with some optional groups left out
        rest = iter(need)
        for shape, repeated, _ in own:
            for other, may_repeat, optional in rest:
                if other == shape and (may_repeat or not repeated):
                    break
                assert optional is not None
            else:
                raise AssertionError(shape)


def test_long_runs_are_matched_like_short_ones():
    random.seed(7)
    for symbols in (2, 3, 9):
        for _ in range(200):
            a, b = ([str(random.randrange(symbols)) for _ in range(random.randrange(40))] for _ in range(2))
            assert wrappers._Runs(None, a, b, autojunk=False).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    middle = [f"<c{random.randrange(10**6)}>" for _ in range(3000)]
    a, b = ["<x>", *middle[:1500], "<y>", *middle[1500:], "<x>"], ["<z>", *middle[:700], "<x>", *middle[700:], "<z>"]
    found = list(wrappers._matches(a, b))
    assert sum(i1 - i0 for same, i0, i1, _, _ in found if same) == 3000
    assert all(a[i0:i1] == b[j0:j1] for same, i0, i1, j0, j1 in found if same)


def test_main_text_of_given_pages(spark):
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in frame.collect()}
    for r in wrappers.main_text(frame).collect():
        own = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", own))).split())


def test_main_text_keeps_quotes_and_captions(spark, rows):
    """Classed elements of the article that some pages lack, and figures, stay; what is equal on all pages goes."""

    def html_of(n):
        quote = f"<blockquote class='pull'>said {n}</blockquote>" if n % 2 else ""
        lead = f"<p class='lead'>lead {n}</p>" if n % 3 == 1 else ""
        figure = f"<figure><img src='x'><figcaption>caption {n}</figcaption></figure>"
        return (
            f"<html><body><div class='top'><p class='brand'>My site</p></div><div class='story'><h2>title {n}</h2>{lead}<p>one {n}</p>{quote}"
            f"{figure}<p>two {n}</p><div class='same'>always this</div></div></body></html>"
        )

    given = [(i, f"https://q.org/{i}", html_of(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in rows(wrappers.main_text(spark.createDataFrame(given, "page_id LONG, url STRING, html STRING")), "page_id")}
    for n in range(8):
        parts = [f"title {n}", f"lead {n}" * (n % 3 == 1), f"one {n}", f"said {n}" * (n % 2), f"caption {n}", f"two {n}"]
        assert got[n] == " ".join(p for p in parts if p)
    # An element that a single page has is not template, nor is anything on less than three different pages.
    rules = wrappers.rules_of(wrappers.infer([html_of(0), html_of(2), html_of(3)]))
    below = [p.rpartition("/")[2] for p in rules["template"]]
    assert "blockquote pull" not in below and "div same" in below
    assert not wrappers.rules_of(wrappers.infer([html_of(0), html_of(2), html_of(2)]))["template"]


def test_wrappers_have_groups_and_slots():
    wrapper = wrappers.infer([page(0), page(1), page(2)]).nodes
    shapes = " ".join(map(str, wrapper))
    assert "'repeat'" in shapes and "'optional'" in shapes and "'slot'" in shapes


def lower_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_decontamination_equals_brute_force(spark, documents, rows):
    rng = random.Random(8)
    vocabulary = [f"T{i}" if i % 3 else f"É{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(10, 30))) for i in range(12)] + [(20, "t1 t2"), (21, "T7"), (22, ""), (23, None), (None, "t4 t5"), (24, "never seen")]
    items.append((30, items[0][1]))
    given = [(i, text(rng.randint(1, 90))) for i in range(40)]
    given += [(i, f"{text(5)} {items[i % 12][1].upper()}! {text(4)}") for i in range(50, 80)] + [(90, None), (91, ""), (None, items[2][1]), (92, "x"), (92, "x")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id LONG, text STRING, h INT")
    got = rows(decontaminate.contamination(documents(given), bench))
    assert len(got) == len(given)
    windows = collections.defaultdict(set)
    for item, t in items:
        w = lower_words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add("null" if item is None else str(item))
    truth = {}
    for doc_id, t in given:
        w, hit, found = lower_words(t), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= own
        truth[doc_id] = (len(w), len(hit), sorted(found))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == truth
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    kept = rows(decontaminate.drop_contaminated(documents(given), bench))
    assert [r["doc_id"] for r in kept] == [r["doc_id"] for r in got if not r["contaminated"]]
    near = decontaminate.proximity_matches(documents([(1, "t1 x t2"), (2, "t1 " + "y " * 9 + "t2")]), bench.filter("item_id = 20"), slop=3)
    assert {r.doc_id for r in near.collect()} == {1}


def test_decontamination_of_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b")], "item_id LONG, text STRING")
    docs = documents([(1, "a b c")])
    assert decontaminate.contamination(docs.filter("doc_id < 0"), bench).count() == 0
    assert not decontaminate.contamination(docs, bench.filter("item_id < 0")).first().contaminated


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(queries.oracle_sql()[name]).df()) is None


def test_pipeline_keeps_clean_documents(spark, folder):
    for name in ("documents", "labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    kept = {r.doc_id for r in out.collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    total = docs.count()
    assert 0.7 * total < len(kept) < total
    assert sum(labels.get(i) == 1 for i in kept) < sum(labels.values())
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    first = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert first.columns == docs.columns
    assert not decontaminate.contamination(first, benchmark).filter("contaminated").count()
