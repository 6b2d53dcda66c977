"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import labelled_sample, score_column

#: Labelled rows from which everything is learned, at most.
SAMPLE_ROWS = 30_000
#: Words and word beginnings that occur most in toxic rows of the sample, at most; those of them that tell; those that vote.
CANDIDATES, FEATURES, VOTERS = 50_000, 2_000, 64
#: Lengths of the word beginnings that count as features, for inflected words.
STEMS = (4, 5, 6)
CACHED_WORDS = 300_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: The chance that a given label is wrong, where the label model starts.
DOUBT = 0.05


def terms(word: str) -> list[str]:
    """The word without signs at its ends, and its beginnings."""
    core = EDGES.sub("", word).lower()
    return [core, *("^" + core[:n] for n in STEMS if len(core) >= n)] if core else []


class Lookup(dict):
    """From a word as written to the numbers of its features; bounded."""

    def __init__(self, features: list[str]) -> None:
        self.numbers = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.numbers[t] for t in terms(word) if t in self.numbers)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        return {i for found in map(self.__getitem__, set(text.split())) if found for i in found}


def toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic rows of a partition hold each term."""
    counts: dict[str, int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for t in {t for w in set((text or "").split()) for t in terms(w)}:
                counts[t] = counts.get(t, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])


def hits(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[pa.RecordBatch]:
    """For each row its label, the candidates it holds, and how loud it is."""
    lookup = Lookup(features)
    for batch in batches:
        texts = [x or "" for x in batch.column(0).to_pylist()]
        found = [sorted(lookup.of(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array([patterns(t) for t in texts], pa.list_(pa.int32()))], ["label", "found", "patterns"])


#: Patterns that may go with toxic text; each votes where it is found.
PATTERNS = [r"!!", r"\?!|!\?", r"\b[A-Z]{4,}\b", r"\b(you|your|tu|vous|usted)\b", r"[*#$%&@]{3}", r"\b(hate|kill|shut up)\b", r"(.)\1{3}"]


def patterns(text: str) -> list[int]:
    return [i for i, p in enumerate(PATTERNS) if re.search(p, text)]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Posterior of label 1 from votes (rows x voters: 1, 0 abstains, -1) by EM.

    Each voter has its own chance of every vote under either label. Voters that still agree
    when the label is known are correlated; each one's evidence is divided by one plus its sum
    of such correlations. The given labels are one more voter, right with chance 1 - DOUBT at first.
    """
    doubt, prior = DOUBT, (labels.sum() + 1) / (len(labels) + 2)
    share = np.ones(votes.shape[1])
    posterior = np.where(labels == 1, 1 - doubt, doubt)
    values = [votes == v for v in (-1, 0, 1)]
    for _ in range(rounds):
        chance = []
        for weight in (posterior, 1 - posterior):
            seen = np.stack([weight @ v for v in values]) + np.array([0.1, 1, 0.1])[:, None]
            chance.append(seen / seen.sum(axis=0))
        mean = sum(w[:, None] * (c[2] - c[0])[None, :] for w, c in zip((posterior, 1 - posterior), chance, strict=True))
        rest = votes - mean
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        together = (rest.T @ rest) / len(votes) / np.outer(spread, spread)
        np.fill_diagonal(together, 0)
        share = 1 / (1 + np.where(together > 0.1, together, 0).sum(axis=0))
        evidence = sum(v @ (share * np.log(a / b)) for v, a, b in zip(values, *chance, strict=True))
        odds = np.log(prior / (1 - prior)) + evidence + np.where(labels == 1, 1, -1) * np.log((1 - doubt) / doubt)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        doubt = np.clip(np.abs(posterior - labels).mean(), 0.005, 0.3)
    return posterior


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, features: int, target: np.ndarray, penalty: float = 2.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features with soft targets, by accelerated gradient steps."""
    w, bias = np.zeros(features), float(np.log((target.sum() + 1) / (n - target.sum() + 1)))
    # X'X is at most the diagonal of each feature's rows weighted by how many features they hold
    scale = 1 / (np.bincount(columns, np.bincount(rows, minlength=n)[rows], features) / 4 + penalty)
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, ahead[columns], n), -30, 30)))
        last, w = w, ahead - scale * (np.bincount(columns, (p - target)[rows], features) + penalty * ahead)
        if ((w - last) * (ahead - w)).sum() > 0:  # overshot: begin anew
            t = 1.0
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = w + (before - 1) / t * (w - last)
        bias -= np.clip((p - target).sum() / max((p * (1 - p)).sum(), 1), -1, 1)
    return w, bias


class ToxicityModel:
    """Features with weights; ``scorer()`` gives the function of one text."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self):
        lookup, weights, bias = Lookup(self.features), self.weights.tolist(), self.bias

        def score(text: str) -> float:
            z = bias + sum(weights[i] for i in lookup.of(text))
            return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

        return score


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled rows: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic).

    Terms that toxic rows hold far more often than others make the lexicon; the
    most telling vote, each for itself, as do the patterns, counts of terms found, and the lack of any.
    With no toxic rows, or none at all, every text scores near the share of toxic ones.
    """
    sample = labelled_sample(docs, labels, "toxic", rows)
    toxic = sample.filter("label = 1").select("text")
    counted = toxic.mapInArrow(toxic_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    candidates = [r["term"] for r in counted.filter("n >= 3").orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()]
    # a 0/1 count for each candidate in all rows, then the few telling ones of each row
    telling = choose(sample, candidates)
    found = sample.mapInArrow(partial(hits, features=telling), "label int, found array<int>, patterns array<int>").collect()
    if not found:
        return ToxicityModel([], np.zeros(0), -3.0)
    y = np.array([r["label"] for r in found], float)
    of = np.repeat(np.arange(len(found)), [len(r["found"]) for r in found])
    terms_of = np.array([i for r in found for i in r["found"]], np.int64)
    number = np.bincount(of, minlength=len(found))
    votes = np.zeros((len(found), VOTERS + len(PATTERNS) + 3))
    lexicon = terms_of < VOTERS
    votes[of[lexicon], terms_of[lexicon]] = 1
    for i, r in enumerate(found):
        votes[i, [VOTERS + p for p in r["patterns"]]] = 1
    votes[:, -3:] = np.stack([np.where(number >= 2, 1, 0), np.where(number >= 4, 1, 0), np.where(number == 0, -1, 0)], axis=1)
    target = label_model(votes, y)
    weights, bias = fit_linear(of, terms_of, len(found), len(telling), target)
    return ToxicityModel(telling, weights, bias)


def choose(sample: DataFrame, candidates: list[str]) -> list[str]:
    """The candidates that tell most, best first: by the excess of toxic rows in standard deviations."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(candidates), np.zeros((2, len(candidates)), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label, list(lookup.of(text or ""))] += 1
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[0, used], pa.int64()), pa.array(counts[1, used], pa.int64())], ["i", "no", "yes"])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    yes, no = totals.get(1, 0), totals.get(0, 0)
    if not yes or not candidates:
        return []
    share = yes / (yes + no)
    both = sample.mapInArrow(count, "i int, no long, yes long").groupBy("i").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    excess = (F.col("yes") - share * (F.col("yes") + F.col("no"))) / F.sqrt(share * (F.col("yes") + F.col("no")))
    # over half of the rows that hold it are toxic
    best = both.withColumn("excess", excess).filter((F.col("excess") > 4) & (F.col("yes") > F.col("no"))).orderBy(F.desc("excess"), "i").limit(FEATURES).collect()
    return [candidates[r["i"]] for r in best]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= 0.5); whole texts, null as empty. The columns score and predicted are replaced."""
    return docs.withColumn("score", score_column(model.scorer)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
