"""Token counts with a shortcut for words that are one token.

A tokenizer whose pre-tokenizer drops white space treats the runs between blanks
independently, so a text's count is the sum of its runs' counts. Before the
texts are read, every vocabulary string that ends a word is encoded alone; those
that come back as their own single id are proven. A run that is proven counts one.
Any other run is cut into its pre-tokens: proven ones count one each, only the
rest goes through the merges. Runs repeat, so their counts are kept in a bounded
table.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that every tokenizer here takes as such; bytes.split() cuts at the same bytes.
BLANKS = " \t\n\r\x0b\x0c"
_LONG = 256


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _drops_blanks(spec: dict) -> str | None:
    """The pattern of a tokenizer file's pre-tokens, if they never hold white space and nothing else depends on it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model, added = spec["model"], spec.get("added_tokens") or []
    normalizers = (spec.get("normalizer") or {}).get("normalizers") or []
    known = {"NFC", "Replace", "Lowercase"}
    fits = (
        [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert")
        and r"[^\s" in steps[0]["pattern"].get("Regex", "")
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex", True)
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix")
        and not model.get("dropout")
        and spec.get("post_processor") is None
        and all(n["type"] in known for n in normalizers)
        and all(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normalizers if n["type"] == "Replace")
        and not any(set(BLANKS) & set(t["content"]) or t.get("single_word") for t in added)
    )
    return steps[0]["pattern"]["Regex"] if fits else None


def proven_words(tokenizer, spec: dict) -> set[bytes]:
    """The strings of a vocabulary that are one token when they are encoded alone, each checked."""
    suffix, letters = spec["model"]["end_of_word_suffix"], byte_letters()
    strings, ids = [], []
    for token, i in spec["model"]["vocab"].items():
        if token.endswith(suffix) and all(c in letters for c in token[: -len(suffix)]):
            raw = bytes(letters[c] for c in token[: -len(suffix)])
            try:
                strings.append(raw.decode())
            except UnicodeDecodeError:
                continue
            ids.append(i)
    found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return {s.encode() for s, i, e in zip(strings, ids, found) if e.ids == [i] and not set(s) & set(BLANKS)}


class WordCounter:
    """Token counts of texts in UTF-8 by a tokenizer file that drops white space.

    ``limit`` bounds the table of runs; emptying it changes no count.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = _drops_blanks(spec)
        if pattern is None:
            raise ValueError("this tokenizer does not treat the runs between blanks independently")
        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        self.proven = proven_words(self._library, spec)
        self._lower = any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"])
        self._pre_tokens = regex.compile(pattern).findall
        special = "|".join(regex.escape(t["content"]) for t in spec.get("added_tokens") or [])
        self._special = regex.compile(special, regex.I).search if special else lambda text: None
        # Characters up to U+00FF are as every Unicode version has them: composed, with plain small letters.
        self._odd = regex.compile(r"[^\x00-\xff]").search
        size = self._library.get_vocab_size()
        self._ends = np.zeros(size, dtype=bool)
        for token, i in spec["model"]["vocab"].items():
            self._ends[i] = token.endswith(spec["model"]["end_of_word_suffix"])
        self._library.model._resize_cache(0)  # the tables here have what comes again
        self._runs: dict[bytes, int] = {}
        self._parts: dict[str, int] = {}
        self._limit = limit

    def batch(self, texts: list[bytes]) -> list[int]:
        runs = [text.split() for text in texts]
        for table in (self._runs, self._parts):
            if len(table) > self._limit:
                table.clear()
        if not self._parts:
            self._parts.update(dict.fromkeys([w.decode() for w in self.proven], 1))
        long = self._learn(set().union(*runs).difference(self._runs))
        counts = [sum(map(self._runs.__getitem__, own)) for own in runs]
        for run in long:
            del self._runs[run]
        return counts

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Count new runs; returns long ones, which are not kept beyond a batch."""
        known, parts, lower = self._runs, self._parts, self._lower
        proven = new & self.proven
        known.update(dict.fromkeys(proven, 1))
        new -= proven
        whole, cut = [], []
        for run in new:
            if run.isalpha():
                cut.append((run, [(run.lower() if lower else run).decode()]))
                continue
            text = run.decode()
            if self._odd(text) or self._special(text):
                whole.append((run, text))
                continue
            cut.append((run, self._pre_tokens(text.lower() if lower else text)))
        rest = list({p for _, own in cut for p in own if p not in parts})
        parts.update(zip(rest, self._merge(rest)))
        found = parts.__getitem__
        known.update([(run, sum(map(found, own))) for run, own in cut])
        encodings = self._library.encode_batch_fast([text for _, text in whole], add_special_tokens=False)
        known.update([(run, len(e.ids)) for (run, _), e in zip(whole, encodings)])
        for part in rest:
            if len(part) > _LONG:
                del parts[part]
        return [run for run in new if len(run) > _LONG]

    def _merge(self, parts: list[str]) -> list[int]:
        """Tokens of pre-tokens, merged a thousand to a text and told apart by the tokens that end a word."""
        out: list[int] = []
        for at in range(0, len(parts), 1000):
            group = parts[at : at + 1000]
            ids = np.array(self._library.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self._ends[ids])
            if len(ends) == len(group) and ends[-1] == len(ids) - 1:
                out += np.diff(ends, prepend=-1).tolist()
            else:
                out += [len(e.ids) for e in self._library.encode_batch_fast(group, add_special_tokens=False)]
        return out


def _counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """Counts of whole texts by whatever tokenizer a file holds."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode([t.decode() for t in texts], num_threads=1)]
    try:
        return WordCounter(path).batch
    except ValueError:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_padding()
        whole.no_truncation()
        return lambda texts: [
            len(e.ids) for e in whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        ]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each whole text.

    ``path`` is a tokenizer file that every executor has: ``.json`` of the tokenizers
    library or ``.model`` of sentencepiece. No token is added, nothing is cut or
    filled up; strings of special tokens in a text are handled as the library does
    by default. A file that does not drop white space has no shortcut, its texts go
    through the library whole. ``carry`` names columns to keep.

    Null texts are empty and have no tokens; null ids and repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        gc.disable()  # the tables hold no cycles
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                sizes = pa.array(map(len, texts), pa.int64())
                tokens = count(texts)
                over = pa.array([n > limit for n in tokens], pa.bool_())
                columns = [batch.column(0), sizes, pa.array(tokens, pa.int64()), over, *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", *names[2:]])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), text]
    chosen += [F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(carry or [])]
    rows = docs.select(*chosen)
    names = rows.columns
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + "".join(
        f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:]
    )
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": name for i, name in enumerate(carry or [])})
