"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from the words it holds, and
the document is toxic unless all its sentences are clean: P = 1 - prod(1 - p) (noisy-or). Word
weights and the bias are learned from document labels alone, through the noisy-or, on a bounded
sample of labelled rows; words are lower-case runs of letters, digits and underscores. As each
sentence has its own probability, the sentences to blame are known.

Null and empty texts, and texts without words, have no sentence and score 0. Without toxic or
without clean labelled rows there is nothing to learn, and every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm import common

#: Bounds of the training sample.
SAMPLE_ROWS = 10_000
SAMPLE_CHARS = 30_000_000
#: Words of fewer sampled texts get no weight.
MIN_TEXTS = 4
#: Words get a weight if the labels differ with them beyond chance (about 5 deviations).
MIN_EVIDENCE = 25.0
STEPS = 250
PENALTY = 1e-4
THRESHOLD = 0.3

#: Beginnings of longer words that are features beside the word itself, in characters.
BEGINNINGS = range(4, 10)
#: Words whose weights a task remembers.
CACHE = 500_000

TOKEN = re.compile(r"\w+|[.!?\n]")
_CUT = 1e9
_CUTS = dict.fromkeys(".!?\n", _CUT)


def word_features(word: str) -> list[str]:
    """The word, and its beginnings (marked with a hyphen)."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


class _Weights(dict):
    """The summed weights of each word's features; cuts between sentences stand for themselves."""

    def __init__(self, weights: dict[str, float]):
        super().__init__(_CUTS)
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
            self.update(_CUTS)
        self[word] = got = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return got


@dataclass
class Model:
    """Weights of features and the bias of a sentence; no bias: nothing learned."""

    weights: dict[str, float]
    bias: float | None

    def sentences(self, text: str | None) -> np.ndarray:
        """Log-odds of each sentence that has a word."""
        if self.bias is None or not text:
            return np.empty(0)
        tokens = TOKEN.findall(text.lower())
        values = np.array(list(map(self.lookup.__getitem__, tokens)))
        cut = values == _CUT
        at = np.cumsum(cut)[~cut]
        if not len(at):
            return np.empty(0)
        sums, words = np.bincount(at, values[~cut]), np.bincount(at)
        return sums[words > 0] + self.bias

    def __post_init__(self):
        self.lookup = _Weights(self.weights)


def noisy_or(log_odds: np.ndarray) -> float:
    """1 - prod(1 - p) from the sentences' log-odds."""
    return float(-np.expm1(-np.logaddexp(0, log_odds).sum()))


def evidence(toxic_with: int, texts_with: int, toxic: float, texts: int) -> float:
    """Twice the log-likelihood ratio of a word's texts having a toxic share of their own."""
    def part(k: float, n: float, p: float) -> float:
        return (k * np.log(p) if k else 0) + ((n - k) * np.log(1 - p) if n - k else 0)

    rest, without = toxic - toxic_with, texts - texts_with
    base = toxic / texts
    own = part(toxic_with, texts_with, toxic_with / texts_with)
    other = part(rest, without, rest / without) if without else 0
    return 2 * (own + other - part(toxic, texts, base))


def fit(sample: list[tuple[str, int]]) -> Model:
    """Learn from ``(text, toxic)`` pairs: Adam steps on the whole sample's log-likelihood."""
    labels = np.array([y for _, y in sample], dtype=float)
    if not len(labels) or labels.min() == labels.max():
        return Model({}, None)
    seen, toxic = Counter(), Counter()
    for text, y in sample:
        in_text = {f for w in set(re.findall(r"\w+", text.lower())) for f in word_features(w)}
        seen.update(in_text)
        if y:
            toxic.update(in_text)
    vocabulary = {w: i for i, w in enumerate(sorted(
        w for w, k in seen.items() if k >= MIN_TEXTS
        and evidence(toxic[w], k, labels.sum(), len(labels)) >= MIN_EVIDENCE))}
    seen.clear()
    toxic.clear()
    known: dict[str, list[int]] = {}

    def ids(w: str) -> list[int]:
        if w not in known:
            if len(known) >= CACHE:
                known.clear()
            known[w] = [vocabulary[f] for f in word_features(w) if f in vocabulary]
        return known[w]

    word, sentence, doc, n = [], [], [], 0
    for d, (text, _) in enumerate(sample):
        for s in filter(None, (re.findall(r"\w+", s) for s in re.split(r"[.!?\n]", text.lower()))):
            got = [i for w in s for i in ids(w)]
            word += got
            sentence += [n] * len(got)
            doc.append(d)
            n += 1
    word, sentence, doc = (np.array(x, dtype=np.int64) for x in (word, sentence, doc))
    w, bias = np.zeros(len(vocabulary)), -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, w[word], n) + bias
        total = np.bincount(doc, np.logaddexp(0, z), len(labels))
        # d loss / d total: 1 for clean bags, -(1 - P) / P for toxic ones.
        slope = np.where(labels > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(labels)
        at = slope[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(word, at[sentence], len(w)) + PENALTY * w, at.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model({x: float(w[i]) for x, i in vocabulary.items()}, float(bias))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
          chars: int = SAMPLE_CHARS) -> Model:
    return fit(common.labelled_sample(docs, labels, ["toxic"], rows, chars))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, the worst sentence's place (from 0, among those
    with words; null without any) and how many sentences alone reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [model.sentences(t) for t in b.column("text").to_pylist()]
            cut = np.log(threshold / (1 - threshold))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([noisy_or(z) for z in odds], pa.float64()),
                 pa.array([int(z.argmax()) if len(z) else None for z in odds], pa.int32()),
                 pa.array([int((z >= cut).sum()) for z in odds], pa.int32())],
                ["doc_id", "score", "worst_sentence", "n_offending"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast(
        "binary")), 4) == 2
    return slim.mapInArrow(
        run, "doc_id long, score double, worst_sentence int, n_offending int").select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "worst_sentence", "n_offending")


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The sentences that reach the threshold alone: ``doc_id, place, sentence, score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in common.rows_of([b], "doc_id", "text"):
                parts = [s for s in re.split(r"[.!?\n]", text or "") if re.search(r"\w", s.lower())]
                p = 1 / (1 + np.exp(-model.sentences(text)))
                out += [(doc_id, i, parts[i].strip(), float(p[i]))
                        for i in np.nonzero(p >= threshold)[0].tolist()]
            ids, places, sentences, scores = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(places, pa.int32()),
                 pa.array(sentences, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "place", "sentence", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, place int, sentence string, score double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [noisy_or(model.sentences(t)) < threshold for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
