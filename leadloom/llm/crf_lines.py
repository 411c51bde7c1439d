"""Quality rules with line sequence labelling: Viterbi decoding of a linear-chain CRF.

Each line with a word is content or boilerplate. A conditional random field scores a labelling by
line features and by the labels of neighbouring lines; it learns its few weights from a bounded
sample of texts. Their lines have no labels of their own, only the text has: line labels are
hidden. At first lines take their text's label and are learnt one by one; then, in a few rounds,
the chain's own expected labels take their place, tilted just so far that a good text keeps at
least ``GOOD_CONTENT`` of its lines as content and a poor one at most ``POOR_CONTENT``. So a good
text may hold boilerplate and a poor one content, and moves between labels are learnt from
expected moves. Gradients are those of the exact conditional likelihood. Viterbi decoding gives the
best labelling of a whole text. A text stays if it passes the base rules and at least half of its
words stand in content lines.

Null and empty texts have no words and fail the base rules. A line of no-break or other Unicode
spaces has words by the rule above all (only ASCII white space parts words) and is labelled like
any other; it just ends in no sign. Repeated rows are judged one by one. Without labelled rows, or with one
kind of label only, the field's weights are 0 apart from a small lean to content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm import common

MIN_WORDS = 20
#: Largest share of words in repeated windows, in percent.
MAX_REPEATED = 30
WINDOW = 8
MIN_CONTENT = 0.5
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 8_000_000
#: Lines of a training window; windows cover the whole text. Decoding knows no windows.
TRAIN_LINES = 64
#: Gradient steps on the texts' labels, rounds with hidden labels, and steps of a round.
STEPS = 60
ROUNDS = 3
ROUND_STEPS = 30
#: Least share of content lines in a good text, and largest in a poor one, while learning.
GOOD_CONTENT = 0.75
POOR_CONTENT = 0.25
PENALTY = 1e-3
N_FEATURES = 12
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that stand twice or more in the text.

    Windows are compared exactly: runs of 1, 2, 4, ... words are numbered by what they are.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        pair = ids[:len(ids) - step] * (ids.max() + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        size += step
    again = np.nonzero(np.bincount(ids)[ids] > 1)[0]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def visible_lines(text: str) -> list[tuple[str, list[bytes]]]:
    """The lines that have a word, with their words."""
    out = []
    for line in text.split("\n"):
        words = line.encode().split()
        if words:
            out.append((line, words))
    return out


def base_counts(text: str, lines: list[tuple[str, list[bytes]]]) -> tuple[int, ...]:
    words = [w for _, ws in lines for w in ws]
    spaces = sum(map(text.count, common.SPACES))
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)),
            len(lines) - len({line for line, _ in lines}), repeated_words(words))


def line_features(lines: list[tuple[str, list[bytes]]]) -> np.ndarray:
    """One row of features from 0 to 1 for each line."""
    out = np.zeros((len(lines), N_FEATURES))
    seen: set[str] = set()
    for i, (line, words) in enumerate(lines):
        n, chars = len(words), len(line)
        signs = sum(map(line.count, SYMBOLS))
        last = line.strip()[-1:]  # nothing where the line's words are no-break or other wide spaces
        upper = line.isupper()
        different = len(set(words))
        out[i] = (1, min(n, 32) / 32, n < 4, signs / chars, signs * 2 > n, upper,
                  line.count("!") * 2 > n, 1 - different / n, different * 2 < n,
                  line in seen, last != "" and last in ".!?:;", line.count("|") * 3 > n)
        seen.add(line)
    return out


class Field:
    """Weights of a two-label chain: label 1 is content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move
        if emit is None:
            self.emit[0, 1] = 1.0

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The best labelling (Viterbi); content wins a tie."""
        scores = (x @ self.emit).tolist()
        (a, b), (c, d) = self.move.tolist()
        if not scores:
            return np.empty(0, np.int64)
        s0, s1 = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            from0, from1 = s1 + c >= s0 + a, s1 + d >= s0 + b
            back.append((from0, from1))
            s0, s1 = (s1 + c if from0 else s0 + a) + e0, (s1 + d if from1 else s0 + b) + e1
        out = [int(s1 >= s0)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return np.array(out[::-1])


def chain_sums(e: np.ndarray, move: np.ndarray, mask: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the log sum over all labellings, expected labels and expected moves.

    ``e`` has the scores of both labels of each line, ``mask`` 1 for lines and 0 behind the last.
    """
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    longest = e.shape[1]
    forward[:, 0] = e[:, 0]
    for t in range(1, longest):
        new = np.logaddexp(*(forward[:, t - 1, k, None] + move[k] for k in (0, 1))) + e[:, t]
        forward[:, t] = np.where(mask[:, t, None] > 0, new, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = np.logaddexp(*(move[:, k] + (e[:, t + 1, k] + backward[:, t + 1, k])[:, None]
                             for k in (0, 1)))
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    labels = np.exp(forward + backward - z[:, None, None]) * mask[:, :, None]
    both = mask[:, 1:] * mask[:, :-1]
    # Behind the last line there is nothing to be expected; the scores there may be of any size.
    log_moves = np.where(both[:, :, None, None] > 0, forward[:, :-1, :, None] + move
                         + (e + backward)[:, 1:, None, :] - z[:, None, None, None], -np.inf)
    return z, labels, np.exp(log_moves)


def loss(emit: np.ndarray, move: np.ndarray, x: np.ndarray, mask: np.ndarray,
         labels: np.ndarray, moves: np.ndarray, weight: np.ndarray
         ) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log-likelihood of (expected) labels and moves, and its two gradients."""
    e = x @ emit
    z, own_labels, own_moves = chain_sums(e, move, mask)
    given = (e * labels).sum(axis=(1, 2)) + (move * moves).sum(axis=(1, 2, 3))
    value = weight @ (z - given) + PENALTY / 2 * ((emit ** 2).sum() + (move ** 2).sum())
    g_emit = np.einsum("ntf,ntk,n->fk", x, own_labels - labels, weight, optimize=True)
    g_move = np.einsum("ntjk,n->jk", own_moves - moves, weight)
    return float(value), g_emit + PENALTY * emit, g_move + PENALTY * move


def _climb(field: Field, steps: int, moves_too: bool, *data: np.ndarray) -> Field:
    emit, move = field.emit, field.move
    m, v = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
    for step in range(1, steps + 1):
        _, g_emit, g_move = loss(emit, move, *data)
        g = np.concatenate([g_emit.ravel(), g_move.ravel() * moves_too])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        emit, move = emit - d[:-4].reshape(emit.shape), move - d[-4:].reshape(2, 2)
    return Field(emit, move)


def hidden_labels(field: Field, x: np.ndarray, mask: np.ndarray, text: np.ndarray,
                  good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels and moves of windows, as near to the field's as their texts' labels allow.

    ``text`` is the number of a window's text, ``good`` the label of each text. All lines of a text
    that breaks its bound get the same addition to the score of content, found by halving.
    """
    e = x @ field.emit
    n = np.bincount(text, weights=mask.sum(axis=1))
    sign = np.where(good == 1, 1.0, -1.0)
    bound = np.where(good == 1, GOOD_CONTENT, POOR_CONTENT)

    def expected(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tilted = e.copy()
        tilted[:, :, 1] += (sign * tilt)[text][:, None]
        _, labels, moves = chain_sums(tilted, field.move, mask)
        share = np.bincount(text, weights=labels[:, :, 1].sum(axis=1)) / n
        return sign * (share - bound) >= 0, labels, moves

    low = np.zeros(len(n))
    high = np.where(expected(low)[0], 0.0, 40.0)
    for _ in range(10 if high.any() else 0):
        middle = (low + high) / 2
        enough = expected(middle)[0]
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return expected(high)[1:]


def fit(sample: list[tuple[str, int]]) -> Field:
    """The field of a sample of ``(text, quality)``; line labels are hidden."""
    texts = [(line_features(visible_lines(t)), q) for t, q in sample]
    texts = [(x, q) for x, q in texts if len(x)]
    good = np.array([q for _, q in texts])
    if len(set(good.tolist())) < 2:
        return Field()
    # Windows one after another cover a text; only links from one to the next are not learnt.
    windows = [(f[a:a + TRAIN_LINES], i) for i, (f, _) in enumerate(texts)
               for a in range(0, len(f), TRAIN_LINES)]
    longest, n = max(len(x) for x, _ in windows), len(windows)
    x = np.zeros((n, longest, N_FEATURES))
    mask = np.zeros((n, longest))
    text = np.array([i for _, i in windows])
    for i, (f, _) in enumerate(windows):
        x[i, :len(f)], mask[i, :len(f)] = f, 1
    # Both kinds of text weigh the same, and a long text no more than a short one.
    lines = np.array([len(f) for f, _ in texts], float)
    share = np.where(good == 1, 0.5 / (good == 1).sum(), 0.5 / (good == 0).sum())
    weight = (share / lines)[text]
    labels = np.eye(2)[good[text]][:, None, :] * mask[:, :, None]
    field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    # Without moves the labels of a text's other lines say nothing, so each line is learnt alone.
    no_moves = np.zeros((n, longest - 1, 2, 2))
    field = _climb(field, STEPS, False, x, mask, labels, no_moves, weight)
    for _ in range(ROUNDS):
        labels, moves = hidden_labels(field, x, mask, text, good)
        field = _climb(field, ROUND_STEPS, True, x, mask, labels, moves, weight)
    return field


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
          chars: int = SAMPLE_CHARS) -> Field:
    return fit(common.labelled_sample(docs, labels, ["quality"], rows, chars))


def judge(text: str | None, field: Field, min_content: float = MIN_CONTENT) -> tuple:
    """The five base counts, base_failed, the share of words in content lines, and kept."""
    lines = visible_lines(text or "")
    counts = base_counts(text or "", lines)
    n_words, repeats = counts[0], counts[4]
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEATED * n_words
    share = 0.0
    if lines:
        content = field.labels(line_features(lines))
        share = float(sum(len(w) for (_, w), k in zip(lines, content) if k)) / n_words
    return *counts, failed, share, not failed and share >= min_content


def judged(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``content_share`` and ``kept`` of each row."""
    names = ["doc_id", *BASE, "base_failed", "content_share", "kept"]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t, field, min_content) for t in b.column("text").to_pylist()]
            columns = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE)
                           + ", base_failed boolean, content_share double, kept boolean")


def kept_rows(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows, with all their columns, that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [judge(t, field, min_content)[-1] for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
