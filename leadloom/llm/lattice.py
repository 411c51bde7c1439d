"""Near-duplicate vectors by E8 lattice hashing.

Unit vectors are projected at random onto blocks of eight numbers, and each block is decoded to
its nearest point of the E8 lattice (integer points with even sum, or those shifted by one half).
The points of a table's blocks together are a cell. A vector stands in the cells nearest to it:
its own, and neighbouring cells reached by steps along the 240 shortest lattice vectors. Vectors
that share a cell in any table are compared by cosine in double precision, so no pair is linked
wrongly; a pair at exactly the threshold shares a cell with the probability stated in ``SHAPES``.

Copies of a vector are one vector with a weight. A linked pair may meet in several cells; it
counts in the least of them only. Cells hand on, for each vector, how many links it has there and
the least vector it reaches, so no pair ever leaves its cell. Cells with more than ``BLOCK``
vectors are cut into parts, and each pair of parts is a group of its own.

Null vectors, zero vectors, empty ones and those with null or non-finite numbers link with
nothing, and vectors only link with vectors of their length. Rows without an id link like others;
a component is named by its least id, and by null if it has none (then no row of it is kept).
Rows of one id are vectors each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm import common
from leadloom.llm.simhash import components

COSINE = 0.9
SEED = 11
#: Vectors of a cell's part that are compared at once.
BLOCK = 2048
#: Blocks of a table, scale of the projection, tables, cells per vector and table, and the share
#: of unrelated pairs that meet in a table. Measured on 64 numbers: each shape finds at least
#: 0.98 of the pairs with a cosine of exactly 0.9, and more of closer ones. Finer shapes cost
#: more cells per vector and let fewer unrelated vectors meet.
SHAPES = ((2, 0.35, 4, 4, 6e-3), (2, 0.45, 6, 4, 5e-4), (3, 0.35, 8, 4, 1.3e-4),
          (3, 0.45, 19, 4, 2.5e-6))
#: Unrelated vectors that a vector may meet in a table before the next finer shape is taken.
MET = 3_000


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = itertools.product((0.5, -0.5), repeat=8)
    return np.array(out + [np.array(h) for h in halves if sum(x < 0 for x in h) % 2 == 0])


_STEPS = _shortest()


def _even_sum(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    point = np.rint(x)
    off = x - point
    odd = np.nonzero(point.sum(axis=1) % 2)[0]
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] < 0, -1, 1)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight numbers."""
    whole, half = _even_sum(x), _even_sum(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest number first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Random projections and lattice cells for vectors of one length."""

    def __init__(self, dim: int, shape: tuple, seed: int = SEED):
        self.blocks, scale, self.tables, self.probes = shape[:4]
        rng = np.random.default_rng([seed, dim])
        wide = 8 * self.blocks
        self.turns, self.shifts = [], []
        for _ in range(self.tables):
            parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0]
                     for _ in range(-(-wide // dim))] if dim < wide else \
                [np.linalg.qr(rng.normal(size=(dim, wide)))[0]]
            self.turns.append(np.hstack(parts)[:, :wide] * np.sqrt(dim) * scale)
            self.shifts.append(rng.uniform(0, 2, wide))
        self.mix = rng.integers(1, 1 << 62, size=(self.tables, wide), dtype=np.int64) | 1
        self.salt = rng.integers(0, 1 << 62, size=self.tables, dtype=np.int64)

    def cells(self, units: np.ndarray) -> np.ndarray:
        """Cells of each unit vector: one row of ``tables * probes`` numbers, own cells first."""
        return np.hstack([self._of_table(t, units) for t in range(self.tables)])

    def _of_table(self, t: int, units: np.ndarray) -> np.ndarray:
        y = units @ self.turns[t] + self.shifts[t]
        n, p = len(y), self.probes
        rows = np.arange(n)[:, None]
        cost, key = np.zeros((n, 1)), np.full((n, 1), self.salt[t])
        for b in range(self.blocks):
            z = y[:, 8 * b:8 * b + 8]
            home = nearest_point(z)
            gain = (z - home) @ _STEPS.T
            step = np.argsort(-gain, axis=1, kind="stable")[:, :p - 1]
            more = np.hstack([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, step, 1)])
            points = np.concatenate([home[:, None], home[:, None] + _STEPS[step]], axis=1)
            # Twice a point is whole; a sum of odd multiples, wrapped around, is its number.
            mixed = ((2 * points).astype(np.int64) * self.mix[t, 8 * b:8 * b + 8]).sum(axis=2)
            both = (cost[:, :, None] + more[:, None, :]).reshape(n, -1)
            best = np.argsort(both, axis=1, kind="stable")[:, :p]
            cost = np.take_along_axis(both, best, 1)
            key = key[rows, best // more.shape[1]] * 31 + mixed[rows, best % more.shape[1]]
        key ^= key >> 29
        return key * np.int64(0x27D4EB2F165667C5)


def shape_for(n: int) -> tuple:
    """The coarsest shape in which ``n`` unrelated vectors leave cells small enough."""
    return next((s for s in SHAPES if n * s[-1] <= MET), SHAPES[-1])


def _values(column: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    sizes = np.array([len(v) for v in vectors], int)
    return {int(d): np.nonzero(sizes == d)[0] for d in np.unique(sizes)}


def _place(shape: tuple, seed: int, bare: bool):
    """Distinct vectors to one row per cell: ``cell`` alone, or with the vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for b in batches:
            vectors = _values(b.column("embedding"))
            for dim, at in _by_length(vectors).items():
                if dim not in tables:
                    tables[dim] = Tables(dim, shape, seed)
                for some in np.array_split(at, -(-len(at) // 1024)):
                    x = np.stack([vectors[i] for i in some])
                    cells = tables[dim].cells(unit(x.astype(float)))
                    each = cells.shape[1]
                    columns = [pa.array(cells.ravel()), pa.array(np.full(cells.size, dim), pa.int32())]
                    if not bare:
                        again = np.repeat(some, each)
                        packed = pa.array([v.tobytes() for v in x], pa.binary())
                        columns += [b.column("v").take(pa.array(again)),
                                    b.column("copies").take(pa.array(again)),
                                    packed.take(pa.array(np.repeat(np.arange(len(some)), each)))]
                    yield pa.RecordBatch.from_arrays(
                        columns, ["cell", "dim", "v", "copies", "x"][:len(columns)])

    return run


def _cosines(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows of unit vectors that link."""
    got = a @ b.T
    i, j = np.nonzero(got >= cosine - 1e-12)
    # The order of a matrix product's sums varies with its size; near the threshold it is fixed.
    close = np.nonzero(got[i, j] <= cosine + 1e-12)[0]
    keep = np.ones(len(i), bool)
    keep[close] = (a[i[close]] * b[j[close]]).sum(axis=1) >= cosine
    return i[keep], j[keep]


class _Group:
    """The vectors of a cell, or of two parts of a large one, that are compared with each other."""

    def __init__(self, rows: dict[str, np.ndarray], kind: type):
        order = np.unique(rows["v"], return_index=True)[1]
        self.v, self.copies, self.slot = (rows[c][order] for c in ("v", "copies", "slot"))
        self.units = unit(np.stack([np.frombuffer(x, kind) for x in rows["x"][order]]).astype(float))

    def pairs(self, i: int, j: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.nonzero(self.slot == i)[0], np.nonzero(self.slot == j)[0]
        found = []
        for at in range(0, len(left), 512):
            some = left[at:at + 512]
            a, b = _cosines(self.units[some], self.units[right], cosine)
            a, b = some[a], right[b]
            found.append((a[a < b], b[a < b]) if i == j else (a, b))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (left, left)

    def owned(self, a: np.ndarray, b: np.ndarray, cell: int, tables: Tables) -> np.ndarray:
        """Which pairs share no lesser cell than this."""
        members, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        cells = tables.cells(self.units[members])
        names, held = np.unique(cells, return_inverse=True)
        held = held.reshape(cells.shape)
        lesser = np.bincount(held.ravel(), minlength=len(names)) > 1
        lesser &= names < cell
        number = np.cumsum(lesser) - 1
        a, b = where[:len(a)], where[len(a):]
        stands = np.zeros((len(members), int(lesser.sum())), np.float32)
        row, col = np.nonzero(lesser[held])
        stands[row, number[held[row, col]]] = 1
        free = np.ones(len(a), bool)
        for at in range(0, len(members), 512):
            mine = (a >= at) & (a < at + 512)
            if mine.any():
                shared = stands[at:at + 512] @ stands.T
                free[mine] = shared[a[mine] - at, b[mine]] == 0
        return free


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position that each of ``n`` positions reaches over the pairs."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def _compare(shape: tuple, seed: int, cosine: float, kind: type):
    """Rows sorted by ``cell, dim, i, j`` to ``v``, its links here and the least ``v`` reached."""
    names = ("cell", "dim", "i", "j", "v", "copies", "slot", "x")

    def linked(rows: dict[str, np.ndarray], tables: dict[int, Tables]):
        g = _Group(rows, kind)
        cell, dim, i, j = (int(rows[c][0]) for c in ("cell", "dim", "i", "j"))
        a, b = g.pairs(i, j, cosine)
        if not len(a):
            return None
        if dim not in tables:
            tables[dim] = Tables(dim, shape, seed)
        mine = g.owned(a, b, cell, tables[dim])
        links = np.zeros(len(g.v), np.int64)
        np.add.at(links, a[mine], g.copies[b[mine]])
        np.add.at(links, b[mine], g.copies[a[mine]])
        near = _least_reached(len(g.v), a, b)
        some = np.nonzero((links > 0) | (near != np.arange(len(g.v))))[0]
        return g.v[some], links[some], g.v[near[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}

        def groups(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            key = np.stack([held[c].astype(np.int64) for c in ("cell", "dim", "i", "j")])
            cuts = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
            edges = np.concatenate([[0], cuts, [key.shape[1]]])
            found = [linked({n: c[s:e] for n, c in held.items()}, tables)
                     for s, e in zip(edges, edges[1:]) if e - s > 1]
            found = [f for f in found if f is not None]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found)], ["v", "links", "near"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            held = c if held is None else {n: np.concatenate([held[n], c[n]]) for n in names}
            other = np.zeros(len(held["cell"]), bool)
            for n in ("cell", "dim", "i", "j"):
                other |= held[n] != held[n][-1]
            last = np.nonzero(other)[0]
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from groups({n: x[:cut] for n, x in held.items()})
                held = {n: x[cut:] for n, x in held.items()}
        if held is not None:
            yield from groups(held)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shape: tuple | None = None,
                    seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows linked directly. ``shape`` is chosen by the number of
    different vectors if not given; it is meant for cosines of 0.9 or more.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    distinct = common.staged(
        rows.filter(usable).groupBy("embedding").agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("v", F.monotonically_increasing_id()), "distinct-vectors")
    shape = shape or shape_for(distinct.count())
    kind = "<f4" if dict(distinct.dtypes)["embedding"] == "array<float>" else "<f8"
    if kind == "<f8":
        distinct = distinct.withColumn("embedding", F.col("embedding").cast("array<double>"))

    # Only the names of the cells are counted; the vectors travel once, to the groups.
    large = distinct.select("embedding").mapInArrow(
        _place(shape, seed, True), "cell long, dim int").groupBy("cell", "dim").count()
    large = common.staged(large.filter(F.col("count") > block).select(
        "cell", "dim", F.ceil(F.col("count") / block).cast("int").alias("slots")), "large-cells")
    slots = F.coalesce("slots", F.lit(1))
    dealt = distinct.select("v", "copies", "embedding").mapInArrow(
        _place(shape, seed, False), "cell long, dim int, v long, copies long, x binary").join(
        large, ["cell", "dim"], "left").withColumns({
            "slot": F.pmod(F.xxhash64("v"), slots).cast("int"), "slots": slots})
    # A row of slot s goes to the pairs (i, s) with i <= s and (s, j) with j > s.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select(
        "cell", "dim", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"),
        "v", "copies", "slot", "x")
    met = common.staged(
        dealt.repartition("cell", "dim", "i", "j").sortWithinPartitions("cell", "dim", "i", "j")
        .mapInArrow(_compare(shape, seed, cosine, kind), "v long, links long, near long"), "links")

    links = met.groupBy(F.col("v").alias("n")).agg(F.sum("links").alias("links"))
    roots = components(met.filter("v != near").select(
        F.col("v").alias("a"), F.col("near").alias("b")))
    named = distinct.join(links, F.col("v") == F.col("n"), "left").join(
        roots, F.col("v") == F.col("node"), "left").select(
        "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "v").alias("root"))
    named = common.staged(named.filter("n_links > 0"), "linked-vectors")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(ids, "root").select(
        F.col("embedding").alias("__x"), "n_links", "component_id")
    alone = F.col("n_links").isNull()
    own = F.col("vec_id").isNotNull()
    joined = rows.filter(usable).join(found, F.col("embedding") == F.col("__x"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(alone, own).otherwise(F.col("vec_id") == F.col("component_id")),
                   F.lit(False)).alias("kept"))
    # Apart, so that unusable rows never meet in the task of one null key.
    return joined.unionByName(rows.filter(~usable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        own.alias("kept")))
