"""Quality by ordinal regression: a cumulative-link (proportional odds) model of graded ratings.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds
t_0 < t_1 < ... . Features are hashed: each word and each word's shape (letters as a or A, digits
as 9, runs shortened, signs kept), with the square root of its share of the text as value, and
how varied the words are, in tenths, with value 1. The
model learns from a bounded sample of labelled rows; ids, languages, sources and labels are never
features of a text.

Null and empty texts have no features and get the grades of w.x = 0. Without labelled rows the
thresholds are 0 and every row is kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm import common

BITS = 16
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 20_000_000
STEPS = 200
PENALTY = 1e-4
#: Rows are kept whose probability of a grade of at least ``KEEP_GRADE`` reaches ``KEEP``.
KEEP_GRADE = 1
KEEP = 0.5
GRADES = 3
#: Words whose features a task remembers.
CACHE = 500_000


def grade(quality: int, toxic: int) -> int:
    """Rating of a labelled row: 0 poor, 1 well written but toxic, 2 well written and clean."""
    return 0 if not quality else 1 if toxic else 2


def shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else
               "Aa" if m[0][0].isupper() else "a", word)
    return re.sub(r"(\W)\1+", r"\1\1", re.sub(r"\d+", "9", s))


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (1 << BITS) - 1


class _Features(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = got = bucket("w" + word.lower()), bucket("s" + shape(word))
        return got


def features(text: str | None, cache: _Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values; the squares of words' and of shapes' values each add up to 1."""
    words = Counter((text or "").split())
    total = sum(words.values())
    counts: Counter = Counter()
    for w, n in words.items():
        a, b = cache[w]
        counts[a] += n
        counts[b] += n
    if total:
        counts[bucket(f"d{10 * len(words) // total}")] += total
        counts[bucket(f"m{10 * max(words.values()) // total}")] += total
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    return at, np.sqrt(np.fromiter(counts.values(), float, len(counts)) / max(total, 1))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None, cache: _Features) -> np.ndarray:
        """P(grade > k) for each threshold."""
        at, x = features(text, cache)
        return 1 / (1 + np.exp(self.thresholds - self.weights[at] @ x))


def fit(sample: list[tuple[str, int, int]], grades: int = GRADES) -> Model:
    """Learn from ``(text, quality, toxic)``: Adam steps on the whole sample's log-likelihood.

    Thresholds are a first value and positive gaps, so they stay in order.
    """
    w, gaps = np.zeros(1 << BITS), np.zeros(grades - 1)
    if not sample:
        return Model(w, np.zeros(grades - 1))
    y = np.array([grade(q, t) for _, q, t in sample])
    cache, at, x, row = _Features(), [], [], []
    for i, (text, _, _) in enumerate(sample):
        a, v = features(text, cache)
        at.append(a)
        x.append(v)
        row.append(np.full(len(a), i))
    at, x, row = map(np.concatenate, (at, x, row))
    n = len(y)
    gaps[0] = -1.0
    m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))

    def thresholds() -> np.ndarray:
        return np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])

    for step in range(1, STEPS + 1):
        t = thresholds()
        s = np.bincount(row, w[at] * x, n)
        tail = 1 / (1 + np.exp(t[None, :] - s[:, None]))
        padded = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(padded[np.arange(n), y] - padded[np.arange(n), y + 1], 1e-9)
        d = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
        up, down = d[np.arange(n), y], d[np.arange(n), y + 1]
        ds = -(up - down) / p / n
        dt = np.zeros(grades + 1)
        np.add.at(dt, y, up / p / n)
        np.add.at(dt, y + 1, -down / p / n)
        dt = dt[1:-1]
        g_gaps = np.concatenate([[dt.sum()], [dt[k:].sum() * np.exp(gaps[k])
                                              for k in range(1, grades - 1)]])
        g = np.concatenate([np.bincount(at, ds[row] * x, len(w)) + PENALTY * w, g_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, gaps = w - move[:len(w)], gaps - move[len(w):]
    return Model(w, thresholds())


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
          chars: int = SAMPLE_CHARS) -> Model:
    return fit(common.labelled_sample(docs, labels, ["quality", "toxic"], rows, chars))


def graded(docs: DataFrame, model: Model, keep_grade: int = KEEP_GRADE,
           keep: float = KEEP) -> DataFrame:
    """``doc_id, expected_grade, tail`` (probability of ``keep_grade`` or better) and ``kept``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Features()
        for b in batches:
            tails = np.array([model.tails(t, cache) for t in b.column("text").to_pylist()])
            tails = tails.reshape(b.num_rows, len(model.thresholds))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(tails.sum(axis=1)),
                 pa.array(np.ascontiguousarray(tails[:, keep_grade - 1]))],
                ["doc_id", "expected_grade", "tail"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, expected_grade double, tail double").withColumn(
        "kept", F.col("tail") >= keep)
