"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; of each segment mean and deviation are kept. For two
vectors, the sum over segments of length x (difference of means squared + difference of deviations
squared) is at most their squared distance, so the sum of length x (product of means + product of
deviations) is at least their inner product. A candidate is dropped as soon as a resolution, from
coarse to fine, shows that it cannot reach a query's k-th best score so far; what is left is
scored exactly, in whole numbers.

Vectors are packed in blocks and written once. Candidate blocks are dealt into groups that fit in
a task's memory; each group meets every query block, streamed past it. Only the k best of each
query and group go on to be merged. All work is on the stated queries against all rows.

Null vectors, vectors with null or non-finite components, and rows without an id take no part.
Vectors with a scaled component of 2^28 or more stand in blocks of their own, which are multiplied
in whole numbers of any size; a score that does not fit a long is an error.
Vectors meet only vectors of their own length. Rows of the query's own id are no candidates;
repeated rows of other ids are candidates each. Of several rows of a query id the least vector asks.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.llm import common

K = 20
SCALE = 64
LEVELS = (1, 4, 16)
BLOCK_ROWS = 1024
#: Bytes of candidates that one task holds.
GROUP_BYTES = 64 << 20
_LARGEST = 1 << 28
_PACKED = "dim int, n long, wide boolean, ids binary, vectors binary"


def _pack(scale: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = defaultdict(list)

        def done(kind: tuple[int, bool]) -> pa.RecordBatch:
            rows = held.pop(kind)
            dim, wide = kind
            ids = np.array([i for i, _ in rows], "<i8")
            packed = json.dumps([[int(c) for c in v] for _, v in rows]).encode() if wide else \
                np.array([v for _, v in rows], "<i4").reshape(len(rows), dim).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([wide]),
                 pa.array([ids.tobytes()]), pa.array([packed])],
                ["dim", "n", "wide", "ids", "vectors"])

        for vec_id, x in common.rows_of(batches, "vec_id", "embedding"):
            if vec_id is None or x is None or None in x:
                continue
            x = np.array(x, dtype=float)
            if not np.isfinite(x).all():
                continue
            kind = len(x), bool((np.abs(x) >= _LARGEST / scale).any())
            scaled = [math.floor(Fraction(c) * scale) for c in x] if kind[1] else np.floor(x * scale)
            held[kind].append((vec_id, scaled))
            if len(held[kind]) >= block_rows:
                yield done(kind)
        for kind in list(held):
            yield done(kind)

    return run


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).astype(int)
    means, spreads = [], []
    for a, b in zip(edges, edges[1:]):
        part = x[:, a:b].astype(float)
        root = np.sqrt(b - a)
        means.append(part.mean(axis=1) * root if b > a else np.zeros(len(x)))
        spreads.append(part.std(axis=1) * root if b > a else np.zeros(len(x)))
    return np.stack(means + spreads, axis=1)


class _Vectors:
    """A block with its statistics at all resolutions."""

    def __init__(self, ids: bytes, vectors: bytes, n: int, dim: int, wide: bool = False):
        self.ids = np.frombuffer(ids, "<i8")
        self.wide = wide
        if wide:
            self.x = np.array(json.loads(vectors), object).reshape(n, dim)
            return
        self.x = np.frombuffer(vectors, "<i4").reshape(n, dim)
        self.largest = int(np.abs(self.x).max(initial=0))
        self.exact = self.x.astype(float)
        self.levels = [statistics(self.x, s) for s in LEVELS]
        self.norm = np.sqrt((self.exact ** 2).sum(axis=1)).max(initial=0)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: _Vectors, k: int):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.at, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)

    def _meet_wide(self, c: _Vectors) -> None:
        """Every pair of a block with numbers of any size."""
        other = self.q.ids[:, None] != c.ids
        scores = np.where(other, self.q.x.astype(object) @ c.x.astype(object).T, 0)
        if scores.size and max(abs(scores.max()), abs(scores.min())) >= 1 << 63:
            raise OverflowError("a score does not fit a long")
        i, j = np.nonzero(other)
        self._keep(i, c.ids[j], scores[i, j].astype(np.int64))

    def meet(self, c: _Vectors) -> None:
        if self.q.wide or c.wide:
            return self._meet_wide(c)
        slack = 1e-9 * (self.q.norm * c.norm + 1)
        rows = np.arange(len(self.q.ids))
        alive = self.q.ids[:, None] != c.ids
        for mine, theirs in zip(self.q.levels, c.levels):
            alive &= mine[rows] @ theirs.T + slack >= self.least[rows, None]
            some = alive.any(axis=1)
            rows, alive = rows[some], alive[some]
            if not len(rows):
                return
        small = self.q.largest * c.largest * max(c.x.shape[1], 1) < 1 << 53
        if alive.mean() > 0.05:
            scores = self.q.exact[rows] @ c.exact.T if small else \
                self.q.x[rows].astype(np.int64) @ c.x.astype(np.int64).T
            alive &= scores >= self.least[rows, None]
            if alive.shape[1] > self.k:
                floor = np.where(alive, scores, np.iinfo(np.int64).min)
                alive &= scores >= np.partition(floor, -self.k, axis=1)[:, -self.k, None]
            i, j = np.nonzero(alive)
            scores = scores[i, j]
        else:
            i, j = np.nonzero(alive)
            kind = float if small else np.int64
            scores = np.einsum("ij,ij->i", self.q.x[rows[i]].astype(kind), c.x[j].astype(kind))
        self._keep(rows[i], c.ids[j], scores.astype(np.int64))

    def _keep(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.concatenate([self.at, at])
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.at, self.ids, self.scores = at[keep], ids[keep], scores[keep]
        last = place[keep] == self.k - 1
        self.least[self.at[last]] = self.scores[last]


def _search(k: int):
    """Rows of a group come together: its candidates first, then all query blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for g, asks, dim, n, wide, ids, vectors in common.rows_of(
                batches, "group", "asks", "dim", "n", "wide", "ids", "vectors"):
            if g != group:
                group, held = g, defaultdict(list)
            block = _Vectors(ids, vectors, n, dim, wide)
            if not asks:
                held[dim].append(block)
                continue
            best = Best(block, k)
            for c in held[dim]:
                best.meet(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[best.at]), pa.array(best.ids), pa.array(best.scores)],
                ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, asks: Column, k: int = K, scale: int = SCALE,
           group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of each query.

    ``vectors`` has ``vec_id`` and ``embedding``; ``asks`` says which rows are queries. A query
    with fewer candidates gives them all; one without any gives no row.
    """
    spark = vectors.sparkSession
    slim = vectors.withColumn("__asks", asks).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", "__asks")
    candidates = common.staged(slim.drop("__asks").mapInArrow(
        _pack(scale, block_rows), _PACKED), "candidates")
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    questions = slim.filter(F.col("__asks") & usable).groupBy("vec_id").agg(
        F.min("embedding").alias("embedding"))
    questions = common.staged(questions.mapInArrow(_pack(scale, block_rows), _PACKED), "queries")

    size = candidates.agg(F.count("*").alias("n"), F.coalesce(
        F.sum(F.octet_length("vectors")), F.lit(0)).alias("bytes")).head()
    spread = min(size["n"], 2 * spark.sparkContext.defaultParallelism)
    groups = max(1, spread, -(-size["bytes"] // group_bytes))
    mine = candidates.select(
        F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("group"), F.lit(False).alias("asks"), "*")
    all_of_them = questions.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
        F.lit(True).alias("asks"), "*")
    met = mine.unionByName(all_of_them).repartition(groups, "group").sortWithinPartitions(
        "group", "asks").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding,
        lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(
        list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
    ::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}"""
