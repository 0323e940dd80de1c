"""Chat windows, token records and BPE against the libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
import threading
import time
import zlib
from pathlib import Path

import numpy as np
import psutil
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from devicelog.llm import bpe, chat, pieces, records, sizes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SHORT = [
    "", "a  b", "a\n b", "a \n b", "it's,ok. Now\n\nx", "—, foo", "foo_bar.,baz ., a", "x.\n\n  y", " lead", "trail ",
    "\t\ttab", "é,è. ñ", "1,234.5", "don't've 'll.", "<|endoftext|> hi", "a<|endoftext|>b, <|endoftext|>. c<|endoftext", " <|endoftext|>\n\n x", "a\x1cb \x85c", "½.x", "漢字 かな", "😀 😀", "\n",
]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    marks = list(" \n\t.,a1é'_- s½́漢\x85bcdething") + ["the", "ing", " th", "😀"]
    return SHORT + ["".join(rng.choice(marks) for _ in range(rng.randint(1, 60))) for _ in range(n)] + ["a" * 9000, "xq" * 5000]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_do_not_change_the_pattern():
    find = regex.compile(public_tokenizers.PATTERN).findall
    for text in texts(3000):
        assert "".join(pieces.split(text)) == text
        assert [q for p in pieces.split(text) for q in find(p)] == find(text)


def test_transducer_equals_library(library):
    transducer = bpe.Transducer(bpe.load_ranks(RANKS), limit=500)
    find = regex.compile(public_tokenizers.PATTERN).findall
    for text in texts(500):
        got = b"".join(transducer.encode(p.encode()) for p in find(text))
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode_ordinary(text)


def merged(ranks, data):
    """The merges applied one by one, the lowest rank first and of equal ones the left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_pairs_of_tokens_are_what_the_merges_leave():
    rng = random.Random(3)
    for _ in range(40):  # with tokens that no merges make, and single bytes of any rank
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
        order = list(tokens)
        rng.shuffle(order)
        ranks = {token: rank for rank, token in enumerate(order)}
        transducer = bpe.Transducer(ranks)
        some = [t for t in order if set(t) <= set(b"abc")]
        for left in some:
            assert transducer._may_follow(-1, ranks[left]) == (merged(ranks, left) == [left])
            for right in some:
                assert transducer._may_follow(ranks[left], ranks[right]) == (merged(ranks, left + right) == [left, right]), (left, right)


def test_tables_of_states_are_freed_without_the_collector():
    transducer = bpe.Transducer(bpe.load_ranks(RANKS))
    transducer.encode(b"a" * 300 + b"zq" * 300)
    states = list(transducer._states.values())
    assert len(states) > 2
    transducer._reset()
    assert not any(states) and len(transducer._states) == 1


MARKED = ["a. b, c\x1f, d.\nE f.\n", "\x1f", "a \x1f.", "x), y. z.\n G", "it's, é. ñ,\nü. 1. b", "a.  b", "Ω. b,\tc. \n", "a%%%b. c's. d"]


@pytest.mark.parametrize("limit", [40, 500_000])
def test_ids_of_batches_equal_the_libraries(library, limit):
    given = texts(400, seed=5) + MARKED + [" ".join(MARKED)] + [None]
    for encoder, encode in (
        (bpe._encoder(RANKS, public_tokenizers.PATTERN), library.encode_ordinary),
        (records._encoder(JSON, 0)[0], lambda text, own=Tokenizer.from_file(JSON): own.encode(text, add_special_tokens=False).ids),
    ):
        encoder._limit = limit
        for _ in range(2):
            for at in range(0, len(given), 60):
                ids, counts = encoder.batch(pa.array(given[at : at + 60], pa.string()))
                ends = np.cumsum(counts).tolist()
                for text, x, y in zip(given[at : at + 60], [0, *ends], ends, strict=False):
                    assert ids[x:y].tolist() == encode(text or ""), text
        assert encoder.batch(pa.array([], pa.string()))[0].tolist() == []


def test_pieces_side_by_side_equal_one_by_one():
    ranks = bpe.load_ranks(RANKS)
    side, one = bpe.Transducer(ranks, limit=300), bpe.Transducer(ranks)
    rng = random.Random(8)
    for _ in range(6):
        some = [rng.randbytes(rng.randint(1, 5)) + rng.choice(["ingthe", " theationß", "😀", ""]).encode() * rng.randint(0, 12) for _ in range(200)]
        ids, counts = side.encode_all(some + [b""])
        assert np.split(ids, np.cumsum(counts))[-1].size == 0
        assert [x.tobytes() for x in np.split(ids, np.cumsum(counts))[: len(some)]] == [one.encode(p) for p in some]


def test_words_that_come_again_stay_when_the_cache_is_full():
    asked = []

    def encode(some, blank=False):
        asked.extend(some)
        return np.array([len(p) for p in some], dtype="<u4"), np.ones(len(some), dtype=np.int64)

    encoder = pieces.Encoder(encode, encode, limit=60)
    for k in range(20):
        rare = "".join(chr(97 + int(d)) for d in str(k))
        encoder.batch(pa.array(["x the common words " + " ".join(f"{rare}z" + "q" * i for i in range(20)) + " of it"]))
    assert all(asked.count(word) == 1 for word in ("the", "common", "words", "of", "it"))


def test_tables_go_from_task_to_task_and_then_away(monkeypatch):
    monkeypatch.setattr(sizes, "IDLE_SECONDS", 0.2)
    made = []
    for _ in range(3):
        tables = sizes.take_up("key", lambda: made.append([]) or made[-1])
        sizes.leave("key", tables)
    assert len(made) == 1
    time.sleep(1)
    assert not sizes._shelf().left


def test_bpe_of_documents_and_back(documents, rows, library):
    given = list(enumerate(texts())) + [(None, "null id"), (900, None), (901, "same"), (901, "same")]
    encoded = bpe.encode(documents(given), RANKS, public_tokenizers.PATTERN, carry=["lang", "found"])
    got = rows(bpe.decode(encoded, RANKS, chunk=7))
    assert len(got) == len(given)
    expected = {i: t or "" for i, t in given}
    for r in got:
        ids = library.encode_ordinary(expected[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["text"] == expected[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert (r["lang"], r["found"]) == ("en", 2.0)
    at_once = bpe.round_trip(documents(given), RANKS, public_tokenizers.PATTERN, carry=["lang", "found"], chunk=7)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lang", "found"]
    assert at_once.columns == names
    assert sorted(map(repr, at_once.collect())) == sorted(repr(r) for r in bpe.decode(encoded, RANKS, with_text=False).select(names).collect())
    assert bpe.round_trip(documents(given).filter("doc_id < 0"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_worker_of_many_words_stays_small(spark):
    word = "translate(hex(xxhash64(id, i)), '0123456789', 'ghijklmnop')"
    docs = spark.range(0, 800, 1, 1).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, 700), i -> {word})) AS text")
    most, ended = [0.0], threading.Event()

    def watch():
        while not ended.wait(0.1):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "python" in p.name():
                        held = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())
                        most[0] = max(most[0], sum(map(int, held)) / 1024)
                except (OSError, psutil.Error):
                    pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).agg(F.count("*"), F.sum("n_tokens")).first()
    finally:
        ended.set()
        watcher.join()
    assert found[0] == 800 and found[1] > 800 * 700
    assert 50 < most[0] < 190  # MB; two workers stand beside a full JVM


def test_stream_decoder_equals_decoding_at_once():
    rng = random.Random(2)
    some = [0x41, 0xC3, 0xA9, 0xE0, 0x80, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xF4, 0x90, 0xED, 0xA0]
    single = {i: bytes([i]) for i in range(256)}
    for _ in range(2000):
        raw = bytes(rng.choice(some) for _ in range(12))
        stream = bpe.StreamDecoder(single)
        assert "".join(stream.feed([b]) for b in raw) + stream.end() == raw.decode("utf-8", "replace")


def test_records_read_back(spark, documents, folder):
    given = list(enumerate(texts(100))) + [(None, "null id"), (900, None), (901, "same"), (901, "same")]
    records.write_records(documents(given), f"{folder}/r", JSON)
    index = records.write_index(spark, f"{folder}/r", f"{folder}/i").cache()
    tokenizer = Tokenizer.from_file(JSON)
    start = 0
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, text), row in zip(order, index.orderBy("start").collect(), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    mixed = records.shuffled(spark, f"{folder}/r", index, seed=3).collect()
    assert [r.doc_id for r in mixed] != [i for i, _ in order]
    assert sum(len(r.ids) // 4 for r in mixed) == start


def test_damaged_records_are_found():
    record = records.frame(5, b"\x01\x00\x02\x00", 2)
    assert [(i, ids.tolist()) for _, _, i, ids in records.parse(record * 2)] == [(5, [1, 2])] * 2
    for k in range(len(record) - 1):
        broken = bytearray(record)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            list(records.parse(bytes(broken)))
    with pytest.raises(ValueError):
        list(records.parse(record[:-3]))


def test_records_of_an_empty_table(documents):
    assert records.write_and_read(documents([(1, "a")]).filter("doc_id < 0"), JSON).count() == 0


CHAT = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "yo " * 20), (1, 3, "user", "a"),
    (1, 4, "assistant", "long " * 300), (1, 5, "user", "b"), (1, 6, "assistant", "end"), (2, 0, "user", "</s>[INST] ok [/INST]"),
    (2, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx \\n \\b \\i \\"), (3, None, None, None), (3, 2, "to\nol", ""),
    (None, 0, "assistant", "no id"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
]


def test_chat_windows_read_back(spark):
    hot = [(7, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 9)) for k in range(3000)]
    frame = spark.createDataFrame([(*r, 9) for r in CHAT + hot], "conv_id LONG, turn LONG, role STRING, text STRING, pos INT")
    windows = chat.format_windows(frame, budget=100, history=30).cache()
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    of = {}
    for conv, turn, role, text in CHAT + hot:
        of.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(of)
    for conv, turns in of.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    # Only an overlong turn passes the budget, alone but for what is repeated.
    assert windows.filter("over_budget AND n_turns > 1").count() == 0
    first = windows.filter("conv_id = 1 AND first_pos > 0").withColumn("t", chat.read_turns(F.col("formatted")))
    assert {r.t[0].text for r in first.collect()} == {"be brief"}
    assert windows.filter("n_repeated > 1").count() > 0


def plain_windows(costs, system, budget, history):
    """Windows of one conversation by their definition: the place of the first new turn, new turns, repeated ones, tokens."""
    kept = costs[0] if system and 2 * costs[0] <= budget else 0
    own = min(history, (budget - kept) // 4)
    stride = (budget - kept - own) // 2
    before = [sum(costs[:i]) for i in range(len(costs))]
    groups = {}
    for i, cost in enumerate(costs):
        groups.setdefault(((before[i] + cost - 1) // stride, cost <= stride), []).append(i)
    out = []
    for new in groups.values():
        first = new[0]
        again = [i for i in range(first) if costs[i] <= own and before[first] - before[i] <= own and not (system and i == 0)]
        head = [0] if kept and first > 0 else []
        out.append((first, len(new), len(head + again), sum(costs[i] for i in head + again + new)))
    return sorted(out)


@pytest.mark.parametrize("system_words", [0, 20, 200, 490, 800, 3000])
def test_chat_windows_hold_the_budget_beside_long_system_turns(spark, system_words):
    rng = random.Random(system_words)
    turns = [(k + 1, ("user", "assistant")[k % 2], "w " * rng.choice([1, 3, 10, 60, 100] + [900] * (k % 40 == 7))) for k in range(150)]
    turns = ([(0, "system", "s " * system_words)] if system_words else []) + turns
    frame = spark.createDataFrame([(1, *t) for t in turns], "conv_id LONG, turn LONG, role STRING, text STRING")
    got = chat.format_windows(frame).collect()
    costs = [len(t.split()) + chat.OVERHEAD for _, _, t in turns]
    windows = plain_windows(costs, system_words > 0, 1024, 256)
    assert sorted((r.first_pos, r.n_turns, r.n_repeated, r.n_tokens) for r in got) == windows
    assert all(not r.over_budget or r.n_turns == 1 and costs[r.first_pos] > 3 * 1024 // 16 for r in got)
    assert sum(r.n_tokens for r in got) < 8 * sum(costs) + max(costs) + 1024


def test_tokens_grow_with_the_characters_of_any_script(spark):
    given = [("漢字" * 1300, 2600), ("かな。", 3), ("สวัสดี", 6), ("a " * 7, 7), ("abcdefghijklm", 2), ("x漢y", 3), ("a, b!", 4), ("", 0), ("é" * 25, 3)]
    frame = spark.createDataFrame(given, "t STRING, n LONG")
    assert [r.c for r in frame.select(chat.token_count(F.col("t")).alias("c")).collect()] == [n for _, n in given]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(4)
    marks = ["\\", "n", "b", "i", "<", "|", "im_start", "|>", "<|im_start|>", "<s>", "</s>", "[INST]", "[", "/INST]", "\n"]
    given = ["".join(rng.choice(marks) for _ in range(8)) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in given], "t STRING")
    for t, e, back in frame.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"), True))).collect():
        assert back == t
        assert not any(c in e for c in chat.CONTROL)


def test_chat_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id LONG, turn LONG, role STRING, text STRING")
    assert chat.digests(chat.format_windows(empty)).count() == 0
