"""Toxicity by weak supervision.

1. A bounded sample of labelled rows proposes terms: whole words and beginnings
   of words that toxic rows have far more often than others.
2. Each term is a voter, and so are patterns over them (several terms, a term that
   comes again, many terms for the length, a term at the start). Every document
   votes; documents are counted by what they voted.
3. A generative label model is fitted to those counts, by expectation
   maximisation that begins with the rates of the labelled sample and stays anchored
   to them: how often each voter speaks up in toxic and in clean documents. Voters that agree beyond what
   their class explains share their weight, by the correlations inside the classes.
4. A linear classifier over all terms learns the model's posterior labels on
   the sample; labels only place its threshold, which no text without a term passes.

What the sample decides is bounded by ``FIT_ROWS``; votes are counted over all
documents, in Spark. Rows of equal texts with different labels count as what most
of them say, toxic in a tie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelog.llm.sizes import give_back
from devicelog.session import small_batches, written

#: Labelled rows of each class that terms and classifier are fitted on, about.
FIT_ROWS = 6_000
ROUNDS = 12
#: A term is at least so many times as frequent in toxic rows as in clean ones.
LEAST_RATIO = 50
#: Rates of terms in the labelled sample weigh so many times as much as the votes: terms that never occur together
#: would tell the label model nothing about each other.
ANCHOR = 4.0
PATTERNS = ("several", "again", "dense", "early")


def held_out(doc_id: Column) -> Column:
    """Rows kept from all learning: every fifth by the checksum of doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Name, P(speaks up | toxic), P(speaks up | clean), weight.
Voter = tuple[str, float, float, float]


@dataclass
class ToxicityModel:
    """Terms (``=`` before one: whole words only) with weights, and the fitted voters."""

    terms: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    #: P(speaks up | toxic), P(speaks up | clean) of terms and patterns, and the weight left after correlations.
    voters: list[Voter] = field(default_factory=list)


def _matcher(terms: list[str]):
    """A function from a text to the places (start) of each term in it."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[int, bool]]] = {}
    for i, term in enumerate(terms):
        kinds.setdefault(term.removeprefix("="), []).append((i, term.startswith("=")))
    for word, kind in kinds.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()

    def find(text: str) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        size = len(text)
        for end, (length, kind) in automaton.iter(text):
            start = end - length + 1
            if start and text[start - 1].isalpha():
                continue
            for i, whole in kind:
                if not whole or end + 1 == size or not text[end + 1].isalpha():
                    found.setdefault(i, []).append(start)
        return found

    return find if terms else lambda text: {}


def _votes(found: dict[int, list[int]], size: int, n_terms: int) -> list[int]:
    """The voters that speak up, in order: terms, then patterns behind the last term."""
    if not found:
        return []
    hits = sum(map(len, found.values()))
    patterns = (len(found) > 1, any(len(x) > 1 for x in found.values()), hits * 400 > size, any(x[0] < 200 for x in found.values()))
    return sorted(found) + [n_terms + k for k, spoken in enumerate(patterns) if spoken]


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Text and label of about ``FIT_ROWS`` rows of each class, none of them held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    counts = {row[0]: row[1] for row in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    share = lambda c: min(1.0, FIT_ROWS / counts[c])
    chance = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    chosen = written(known.filter(chance < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0))))
    # Two classes of at most about FIT_ROWS rows of two numbers.
    rows = _texts(docs).join(F.broadcast(chosen), "doc_id")
    return written(rows.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))


def _propose(sample: DataFrame) -> tuple[list[tuple[str, int, int]], dict[int, int]]:
    """Terms with the toxic and the clean rows that have them, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\W\d_]+")
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = set()
                for w in set(word.findall(text.lower())):
                    terms.add("=" + w)
                    terms.update([w[:k] for k in range(3, min(len(w), 9))])
                counts[label].update(terms)
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([counts[c][t] for t in names], pa.int64()) for c in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])
            counts = names = columns = terms = None
        give_back()

    sizes = {row[0]: row[1] for row in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return [], sizes
    counts = sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # By chance a term of so many rows would hardly ever lie in toxic ones alone.
    least = max(3, int(np.ceil(np.log(1e-7) / np.log(n1 / (n0 + n1)))) if n1 + n0 > 500 else 3)
    rows = counts.filter((F.col("toxic") >= least) & (F.col("toxic") / n1 >= LEAST_RATIO * F.col("clean") / n0)).collect()
    return _pruned([(r.term, r.toxic, r.clean) for r in rows]), sizes


def _pruned(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of terms that contain each other, the longest that lose no toxic row against the shortest."""
    kept: dict[str, tuple[str, int, int]] = {}
    for row in sorted(rows, key=lambda r: (len(r[0].removeprefix("=")), r[0].startswith("="))):
        word = row[0].removeprefix("=")
        shorter = next((word[:k] for k in range(len(word), 2, -1) if word[:k] in kept), None)
        if shorter is None:
            kept[word] = row
        elif row[1] == kept[shorter][1] and row[2] <= kept[shorter][2]:
            del kept[shorter]
            kept[word] = row
        elif kept[shorter][2] > 0.02 * kept[shorter][1] and row[2] * kept[shorter][1] < kept[shorter][2] * row[1]:
            kept[word] = row
    return sorted(kept.values(), key=lambda r: (-r[1], r[0]))


def _weights(voters: list[Voter], prior: float) -> tuple[float, np.ndarray]:
    """The logarithm of the odds of a toxic document in which nobody speaks up, and what each voter adds to it."""
    t1, t0, weight = (np.array([v[k] for v in voters]) for k in (1, 2, 3))
    silent = weight * np.log((1 - t1) / (1 - t0))
    return float(np.log(prior / (1 - prior)) + silent.sum()), weight * np.log(t1 / t0) - silent


def posteriors(votes: list[list[int]], voters: list[Voter], prior: float) -> np.ndarray:
    """P(toxic) given who speaks up."""
    base, adds = _weights(voters, prior)
    return 1 / (1 + np.exp(-np.clip(np.array([base + adds[v].sum() if v else base for v in votes]), -700, 700)))


def _summed(counts: DataFrame, voters: list[Voter], prior: float) -> dict[int, tuple[float, float]]:
    """Of each voter the toxic and the clean documents in which it speaks up; of all documents under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(voters) + 1))
        for batch in batches:
            votes, n = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
            q = posteriors(votes, voters, prior)
            flat = np.array([i for v in votes for i in v], dtype=np.int64)
            row = np.repeat(np.arange(len(votes)), [len(v) for v in votes])
            for k, share in enumerate((n * q, n * (1 - q))):
                sums[k, :-1] += np.bincount(flat, weights=share[row], minlength=len(voters))
                sums[k, -1] += share.sum()
        ids = [*range(len(voters)), -1]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sums[0]), pa.array(sums[1])], names=["i", "a", "b"])

    rows = counts.select("votes", "n").mapInArrow(run, "i int, a double, b double").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return {r.i: (r.a, r.b) for r in rows.collect()}


def _label_model(counts: DataFrame, voters: list[Voter], prior: float, anchored: int = 0, anchor: float = ANCHOR) -> list[Voter]:
    """Fit the voters to the counts of votes (columns votes, n), from where they stand.

    The first ``anchored`` voters are held to where they stand as by ``anchor`` times all documents.
    """
    start = voters
    clip = lambda x: float(min(max(x, 1e-6), 0.999))
    for _ in range(ROUNDS):
        sums = _summed(counts, voters, prior)
        n1, n0 = sums.get(-1, (0.0, 0.0))
        if not n1:
            return voters
        before = voters
        k = [anchor if i < anchored else 0.0 for i in range(len(voters))]
        voters = [
            (
                v[0],
                clip((sums[i][0] + 0.1 + k[i] * n1 * v[1]) / (n1 + 1 + k[i] * n1)),
                clip((sums[i][1] + 0.001 + k[i] * n0 * v[2]) / (n0 + 1 + k[i] * n0)),
                1.0,
            )
            for i, v in enumerate(start)
        ]
        if max(abs(a[1] - b[1]) for a, b in zip(voters, before)) < 1e-4:
            break
    return _share_weight(counts, voters, prior, n1, n0)


def _share_weight(counts: DataFrame, voters: list[Voter], prior: float, n1: float, n0: float) -> list[Voter]:
    """Voters that agree beyond their class divide their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[float]] = {}

        def rows() -> pa.RecordBatch:
            columns = [pa.array([p[k] for p in held], pa.int32()) for k in (0, 1)] + [pa.array([x[k] for x in held.values()], pa.float64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["i", "j", "a", "b"])

        for batch in batches:
            votes = batch.column(0).to_pylist()
            for v, n, q in zip(votes, batch.column(1).to_pylist(), posteriors(votes, voters, prior).tolist()):
                for pair in combinations(v, 2):
                    own = held.setdefault(pair, [0.0, 0.0])
                    own[0] += n * q
                    own[1] += n * (1 - q)
                    if len(held) > 500_000:
                        yield rows()
                        held.clear()
        yield rows()

    pairs = counts.select("votes", "n").mapInArrow(run, "i int, j int, a double, b double")
    pairs = pairs.groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.array([v[1:3] for v in voters])
        for batch in batches:
            i, j, a, b = (column.to_numpy() for column in batch.columns)
            both = np.zeros(len(i))
            for k, (together, total) in enumerate(((a, n1), (b, n0))):
                x, y = t[i, k], t[j, k]
                spread = np.sqrt(x * (1 - x) * y * (1 - y))
                both += total / (n1 + n0) * np.maximum(0.0, (together / max(total, 1e-9) - x * y) / spread)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.minimum(both, 1.0))], names=["i", "j", "c"])

    found = pairs.mapInArrow(agreement, "i int, j int, c double").withColumn("v", F.explode(F.array("i", "j")))
    extra = {r.v: r.c for r in found.groupBy("v").agg(F.sum("c").alias("c")).collect()}
    return [(name, t1, t0, float(1 / (1 + extra.get(i, 0.0)))) for i, (name, t1, t0, _) in enumerate(voters)]


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit a model; without labels of both classes it calls every document clean."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels)
    if sample is None:
        return ToxicityModel()
    proposed, sizes = _propose(sample)
    if not proposed:
        return ToxicityModel()
    terms = [t for t, _, _ in proposed]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(terms)
        for batch in batches:
            counts = Counter(tuple(_votes(find(t.lower()), len(t), len(terms))) for t in batch.column(0).to_pylist())
            columns = [pa.array(list(counts.keys()), pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["votes", "n"])
        give_back()

    counts = _texts(docs).select("text").mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    counts = written(counts)
    known = labels.filter("toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = float(min(max(known or 0.1, 0.01), 0.5))
    rate = lambda n, of: float(min(max((n + 0.05) / (of + 1), 1e-6), 0.999))
    # Patterns have no rates yet; the first round gives them theirs.
    voters = [(t, rate(toxic, sizes[1]), rate(clean, sizes[0]), 1.0) for t, toxic, clean in proposed] + [(p, 0.01, 0.01, 1.0) for p in PATTERNS]
    voters = _label_model(counts, voters, prior, anchored=len(terms))
    weights, bias = _classifier(sample, terms, voters, prior)
    return ToxicityModel(terms, weights, bias, voters)


def _classifier(sample: DataFrame, terms: list[str], voters: list[Voter], prior: float) -> tuple[np.ndarray, float]:
    """A logistic regression over the sample's terms, on the label model's posterior; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(terms)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [find(t.lower()) for t in texts]
            q = posteriors([_votes(f, len(t), len(terms)) for f, t in zip(found, texts)], voters, prior)
            columns = [pa.array([sorted(f) for f in found], pa.list_(pa.int32())), pa.array(q), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["found", "q", "toxic"])
        give_back()

    rows = sample.select("text", "toxic").mapInArrow(run, "found array<int>, q double, toxic int").collect()
    column = np.array([i for row in rows for i in row.found], dtype=np.int64)
    line = np.repeat(np.arange(len(rows)), [len(row.found) for row in rows])
    scored = lambda w: np.bincount(line, weights=w[column], minlength=len(rows))
    gathered = lambda e: np.bincount(column, weights=e[line], minlength=len(terms))
    q, y = np.array([r.q for r in rows]), np.array([r.toxic for r in rows])
    # The sample has more toxic rows than the documents; weigh them back.
    balance = np.where(y == 1, prior / max((y == 1).mean(), 1e-9), (1 - prior) / max((y == 0).mean(), 1e-9))
    w, b = np.zeros(len(terms)), float(np.log(prior / (1 - prior)))
    for _ in range(400):
        p = 1 / (1 + np.exp(-(scored(w) + b)))
        error = balance * (p - q)
        # Each weight has its own step: rare terms would hardly move otherwise.
        w -= 2.0 * (gathered(error) + 0.02 * w) / (gathered(balance) * 0.25 + 1.0)
        b -= 2.0 * error.sum() / (balance.sum() * 0.25 + 1.0)
    scores = scored(w) + b
    order = np.argsort(-scores, kind="stable")
    hit, miss = np.cumsum(balance[order] * (y[order] == 1)), np.cumsum(balance[order] * (y[order] == 0))
    f1 = 2 * hit / (hit + miss + (balance * (y == 1)).sum())
    ends = np.concatenate([np.diff(scores[order]) != 0, [True]])
    best = int(np.argmax(np.where(ends, f1, -1)))
    lower = scores[order][best + 1] if best + 1 < len(scores) else scores[order][best] - 2
    # A text without a term has the score b, and is never toxic.
    return w, b - max(float(scores[order][best] + lower) / 2, b + 0.01)


def score(docs: DataFrame, model: ToxicityModel, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score in 0..1, predicted (1 from a half on), and the columns named by ``carry``.

    Only the text decides. Null and empty texts have the score of a text without
    a term; null ids, repeated rows, empty tables and other columns pass.
    """
    small_batches(docs.sparkSession)
    terms, weights, bias = model.terms, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(terms)
        for batch in batches:
            logits = [bias + sum(weights[i] for i in find(t.lower())) for t in batch.column(1).to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits, dtype=float), -700, 700)))
            columns = [batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    carry = carry or []
    rows = _texts(docs, *[F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(carry)])
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept] + ["score"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", score double"
    out = rows.mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id")))
    out = out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.withColumnsRenamed({f"k{i}": name for i, name in enumerate(carry)})
