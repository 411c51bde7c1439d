"""Ranked lexical search that scores every different bag of words once.

Texts are cut into terms, and of each text only the terms that some item of the query set asks for
stay, with their frequencies: its bag. Texts with the same bag and the same length factor ``m``
are a class, found by hashing and comparing whole bags. A class is scored once against all items;
a task keeps the best ``k`` classes of each item. Of the classes that win, the members come in by
ascending ``doc_id``.

The best ``k`` classes of an item, ties to the smaller least member, hold its best ``k`` texts: a
member of a later class has a member of each of ``k`` other classes before it.

Items are dealt into blocks of ``ITEMS`` items and ``ITEM_CHARS`` characters; each block is a pass
over all texts and its winners are written before the next one starts, so neither the driver nor a
task holds more than a block's terms, however many items ask.

Null and empty texts and items have no terms: such texts are never found, such items give no rows;
with an empty table there are none. Repeated rows are members each; items with one id are one item
of all their terms. Texts or items without an id take no part in the result, though the texts
count in the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from leadloom.llm import common

K = 50
ITEMS = 2_000
ITEM_CHARS = 8_000_000
#: A text's length weighs this share of 100 in ``m``.
LENGTH_SHARE = 50
_EXACT = 1 << 53
#: Terms times items that are added up at once.
_AT_ONCE = 1 << 22

# Bytes of ASCII that are neither letters nor digits part terms; all others belong to them.
_TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    """The terms of a text with repeats; only A-Z are made small."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _bags(number: dict[bytes, int]):
    """Texts to ``doc_id, n, bag``: pairs of term number and frequency, by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, bags = [], []
            for text in b.column("text").to_pylist():
                found = terms(text)
                held = Counter(map(number.get, found))
                held.pop(None, None)
                sizes.append(len(found))
                bags.append(np.array(sorted(held.items()), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                ["doc_id", "n", "bag"])

    return run


def _document_counts(n_terms: int):
    """Bags to ``term, df`` of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for b in batches:
            whole = b"".join(b.column("bag").to_pylist())
            counts += np.bincount(np.frombuffer(whole, "<i4")[::2], minlength=n_terms)
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some])], ["term", "df"])

    return run


class _Asked:
    """The items of a block: for each term the items that ask for it, and its weight."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        pairs = sorted((t, i) for i, ts in enumerate(items) for t in ts)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.weights = weights
        self.starts = np.searchsorted([t for t, _ in pairs], np.arange(len(weights) + 1))
        self.n = len(items)

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """Whole-number scores, one row for each bag and one column for each item."""
        pairs = np.frombuffer(b"".join(bags), "<i4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), [len(x) // 8 for x in bags])
        t, tf = pairs[:, 0], pairs[:, 1]
        gain = self.weights[t] * (1_000_000_000 * tf // (1_000 * tf + 20 * m[row]))
        many = self.starts[t + 1] - self.starts[t]
        # Every term counts for its items; so many at a time that the lists stay small.
        exact = float(np.abs(gain).max(initial=0)) * max(len(self.weights), 1) < _EXACT
        out = np.zeros(len(bags) * self.n, float if exact else np.int64)
        ends = np.cumsum(many)
        cuts = np.searchsorted(ends, np.arange(_AT_ONCE, many.sum(), _AT_ONCE))
        for part in np.split(np.arange(len(t)), cuts):
            first, n = self.starts[t[part]], many[part]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(row[part], n) * self.n + self.items[at]
            if exact and len(cell):
                base = row[part[0]] * self.n
                got = np.bincount(cell - base, np.repeat(gain[part], n))
                out[base:base + len(got)] += got
            else:
                np.add.at(out, cell, np.repeat(gain[part], n))
        return out.astype(np.int64).reshape(len(bags), self.n)


def _best_classes(asked: _Asked, k: int):
    """Classes to the best ``k`` of a task for each item: ``item, class, score, least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, name, score, least = (np.empty(0, np.int64) for _ in range(4))
        floor = np.ones(asked.n, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                b = whole.slice(start, 1_024)
                got = asked.scores(b.column("bag").to_pylist(),
                                   b.column("m").to_numpy(zero_copy_only=False))
                row, col = np.nonzero(got >= floor)
                if not len(row):
                    continue
                names, firsts = (b.column(c).to_numpy(zero_copy_only=False)
                                 for c in ("class", "least"))
                item = np.concatenate([item, col])
                name = np.concatenate([name, names[row]])
                score = np.concatenate([score, got[row, col]])
                least = np.concatenate([least, firsts[row]])
                order = np.lexsort((least, -score, item))
                place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
                order, place = order[place < k], place[place < k]
                item, name, score, least = (x[order] for x in (item, name, score, least))
                last = place == k - 1
                floor[item[last]] = score[last]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (item, name, score, least)], ["item", "class", "score", "least"])

    return run


def _blocks(items: DataFrame, n_items: int, chars: int) -> Iterator[dict[int, set[bytes]]]:
    """Items by id with their terms, in blocks; rows of an id stand together in the order."""
    held: dict[int, set[bytes]] = {}
    size = 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "item_id IS NOT NULL").orderBy("item_id")
    for r in rows.toLocalIterator():
        more = len(r["text"] or "")
        if r["item_id"] not in held and held and (len(held) >= n_items or size + more > chars):
            yield held
            held, size = {}, 0
        held.setdefault(r["item_id"], set()).update(terms(r["text"]))
        size += more
    if held:
        yield held


def _search_block(docs: DataFrame, block: dict[int, set[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    ids = sorted(block)
    number = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
    bags = common.staged(docs.mapInArrow(_bags(number), "doc_id long, n long, bag binary"), "bags")
    size = bags.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).head()
    n, total = size["n"], size["l"] or 0
    counts = np.zeros(len(number), np.int64)
    for r in bags.mapInArrow(_document_counts(len(number)), "term int, df long").groupBy(
            "term").agg(F.sum("df").alias("df")).toLocalIterator():
        counts[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1)))
                        for df in counts], np.int64)
    asked = _Asked([sorted(number[t] for t in block[i]) for i in ids], weights)

    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {n}L) div {max(total, 1)}L")
    usable = bags.filter("doc_id IS NOT NULL AND octet_length(bag) > 0").select(
        "doc_id", "bag", m.cast("long").alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    classes = common.staged(usable.groupBy("hash", "bag", "m").agg(
        F.min("doc_id").alias("least")).withColumn("class", F.monotonically_increasing_id()),
        "classes")
    found = classes.select("class", "m", "bag", "least").mapInArrow(
        _best_classes(asked, k), "item long, class long, score long, least long")
    place = F.row_number().over(
        W.partitionBy("item").orderBy(F.desc("score"), "least", "class"))
    winners = common.staged(found.withColumn("place", place).filter(F.col("place") <= k).select(
        "item", "class", "score"), "winners")

    keys = classes.join(winners.select("class").distinct(), "class", "left_semi").select(
        "class", F.col("hash").alias("h"), F.col("bag").alias("b"), F.col("m").alias("f"))
    members = usable.join(keys, (F.col("hash") == F.col("h")) & (F.col("bag") == F.col("b"))
                          & (F.col("m") == F.col("f"))).select("class", "doc_id")
    first = F.row_number().over(W.partitionBy("class").orderBy("doc_id"))
    members = members.withColumn("at", first).filter(F.col("at") <= k).select("class", "doc_id")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = winners.join(members, "class").withColumn("rank", rank).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = ITEMS,
           block_chars: int = ITEM_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` texts of ``docs`` (doc_id, text) with a
    score above 0 for each row of ``items`` (item_id, text); ties go to the smaller ``doc_id``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(items, block_items, block_chars):
        found = common.staged(_search_block(docs, block, k), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], "item_id long, rank int, doc_id long, score long")
    return out


SQL = f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
sizes AS (SELECT count_if(len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM cut),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
held AS (SELECT doc_id, term, count(*) AS tf, any_value(size) AS size FROM
        (SELECT doc_id, len(ts) AS size, unnest(ts) AS term FROM cut) GROUP BY doc_id, term),
weighed AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM
        (SELECT term, count(*) AS df FROM held GROUP BY term), sizes),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) //
        (1000 * tf + 20 * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * size * n) // l))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weighed USING (term), sizes GROUP BY item_id, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
        ::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= {K}"""
