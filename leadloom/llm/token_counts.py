"""Token counts by merging byte pairs with a heap and a linked list; no ids are made.

The symbols of a word form a doubly linked list. A heap holds adjacent pairs by merge rank, then
place; the lowest is popped, stale entries are passed over, and the pairs beside the new symbol
are pushed. The count is the number of first symbols minus the number of merges. Each task
remembers the counts of parts and words it has seen (bounded, see ``PartCache``).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm import common
from leadloom.llm.pretokens import PartCache, pieces

LIMIT = 1024


@cache
def byte_letters() -> list[str]:
    """The visible character that stands for each byte in the vocabulary's files.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from
    U+0100 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge_table(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[int]]:
    """(left, right) -> (rank, merged symbol), and the first symbol of each byte."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
    return merges, [vocab[c] for c in byte_letters()]


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def count_merges(symbols: list[int], merges: dict) -> int:
    """How many pairs merge, lowest rank first and leftmost among equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        got = merges.get((symbols[i], symbols[i + 1]))
        if got:
            heap.append((got[0], i, got[1], symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, merged, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, -1
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            got = merges.get((merged, symbols[k]))
            if got:
                heapq.heappush(heap, (got[0], i, got[1], merged, symbols[k]))
        h = before[i]
        if h >= 0:
            got = merges.get((symbols[h], merged))
            if got:
                heapq.heappush(heap, (got[0], h, got[1], symbols[h], merged))
    return done


class Counter:
    """Token counts of texts for one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.first = merge_table(path)
        self.specials, self.pattern = special_tokens(path), pattern
        self.words: dict[str, int] = {}
        self.parts = PartCache(self._part, -1)

    def _word(self, word: str) -> int:
        symbols = [self.first[b] for b in word.encode()]
        n = len(symbols)
        return n - count_merges(symbols, self.merges) if n > 1 else n

    def _part(self, part: str) -> int:
        found, total = pieces(part, self.pattern), 0
        for w in _cut_by_library(part) if found is None else found:
            n = self.words.get(w)
            if n is None:
                if len(self.words) >= self.parts.limit:
                    self.words.clear()
                n = self.words[w] = self._word(w)
            total += n
        return total

    def count(self, text: str) -> int:
        return sum(sum(self.parts.values_of(t)) if k % 2 == 0 else 1
                   for k, t in enumerate(split_specials(text, self.specials)))


def split_specials(text: str, specials: list[str]) -> list[str]:
    """Ordinary text and special strings by turns; the longest special string wins a tie."""
    if not any(s in text for s in specials):
        return [text]
    import re

    alternatives = "|".join(map(re.escape, sorted(specials, key=len, reverse=True)))
    return re.split(f"({alternatives})", text)


def _cut_by_library(part: str) -> list[str]:
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return [part[a:b] for _, (a, b) in cut.pre_tokenize_str(part)]


@cache
def counter(path: str, pattern: str) -> Counter:
    """One per Python worker and vocabulary."""
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row.

    Null and empty texts count 0; special strings inside texts count one token each.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            counts = [own.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
