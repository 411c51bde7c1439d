"""Lattice near-duplicates, whitening and ranked search against brute force."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import common, lattice, ranked, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, v string, x int, n_links string"


def frame(spark, rows):
    """Rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x],
                                   "v", 0, "n") for i, x in rows], VECTORS)


# -- lattice ---------------------------------------------------------------------------

def test_decoded_points_are_the_nearest_of_the_lattice():
    rng = np.random.default_rng(0)
    x = rng.normal(scale=3, size=(300, 8))
    got = lattice.nearest_point(x)
    twice = 2 * got
    assert (twice == np.rint(twice)).all()
    assert ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all()
    assert (got.sum(axis=1) % 2 == 0).all()
    steps = lattice._STEPS
    assert steps.shape == (240, 8) and np.allclose((steps ** 2).sum(axis=1), 2)
    # All lattice points within reach of a point's cell: shortest and next shortest vectors.
    near = np.unique(np.concatenate([steps, (steps[:, None] + steps).reshape(-1, 8)]), axis=0)
    other = ((x[:, None] - got[:, None] - near) ** 2).sum(axis=2).min(axis=1)
    assert (((x - got) ** 2).sum(axis=1) <= other + 1e-9).all()


@pytest.mark.parametrize("shape", lattice.SHAPES[:3])
def test_pairs_at_the_threshold_share_a_cell(shape):
    rng = np.random.default_rng(1)
    a = lattice.unit(rng.normal(size=(1500, 64)))
    b = rng.normal(size=(1500, 64))
    b = lattice.unit(b - (a * b).sum(axis=1)[:, None] * a)
    b = 0.9 * a + math.sqrt(1 - 0.81) * b
    tables = lattice.Tables(64, shape)
    met = [bool(set(p) & set(q)) for p, q in zip(tables.cells(a).tolist(), tables.cells(b).tolist())]
    assert np.mean(met) >= 0.95


def brute_links(rows, cosine=0.9):
    good = [(k, np.array(x, float)) for k, (_, x) in enumerate(rows)
            if x is not None and None not in x and len(x) and np.isfinite(np.array(x, float)).all()
            and np.any(np.array(x, float) != 0)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, (i, a) in enumerate(good):
        for j, b in good[:p]:
            if len(a) == len(b):
                a1, b1 = a / abs(a).max(), b / abs(b).max()
                if a1 @ b1 / math.sqrt(a1 @ a1) / math.sqrt(b1 @ b1) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if find(j) == find(k)]
        comp = min((m for m in members if m is not None), default=None)
        out[i, links[k], comp, i is not None and i == comp] += 1
    return out


def as_counts(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def planted(seed, dim=64, groups=12, size=9, noise=0.02):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(150)]
    for _ in range(groups):
        centre = rng.normal(size=dim)
        rows += [(centre + noise * math.sqrt(dim) * rng.normal(size=dim)) * rng.uniform(0.1, 9)
                 for _ in range(size)]
    rng.shuffle(rows)
    return [(i, x.tolist()) for i, x in enumerate(rows)]


@pytest.mark.parametrize("block", [lattice.BLOCK, 4])
def test_links_equal_brute_force(spark, block):
    rows = planted(3) + [(1000 + i, [1.0] * 64) for i in range(7)]
    assert as_counts(lattice.near_duplicates(frame(spark, rows), block=block)) == brute_links(rows)


def test_a_chain_of_links_is_one_component(spark):
    turn = [(i, [math.cos(i * 0.4), math.sin(i * 0.4), 0, 0, 0, 0, 0, 0, 0]) for i in range(6)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(frame(spark, turn)).collect()}
    assert got == {i: (1 if i in (0, 5) else 2, 0) for i in range(6)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0, 0]), (4, [1, None]), (5, [nan, 1]), (6, [inf, 1]),
            (7, [1, 2]), (8, [2, 4]), (8, [2, 4]), (None, [1, 2]), (9, [1, 2, 0]), (10, [-1, -2]),
            (11, [1e300, 2e300]), (12, [1e-300, 2e-300]), (None, None), (None, [3, -1]), (13, [5]), (14, [-0.0, 0])]
    got = as_counts(lattice.near_duplicates(frame(spark, rows)))
    assert got == brute_links(rows)
    assert lattice.near_duplicates(frame(spark, [])).count() == 0


def test_given_table_has_all_links(spark):
    vectors = common.table(spark, "/root/testdata/check_s", "embeddings")
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(vectors).collect()}
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = np.concatenate([(x[a:a + 1024] @ x.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(x), 1024)])
    found = np.array([got[r.vec_id] for r in rows])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and len(got) == len(rows)


# -- whitening -------------------------------------------------------------------------

def test_cholesky_and_jacobi_equal_the_eigenvalues():
    rng = np.random.default_rng(4)
    for dim, rank in ((1, 1), (5, 5), (8, 3), (33, 33)):
        a = rng.normal(size=(dim, rank)) * np.logspace(0, -3, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v)
        values, vectors = whitening.one_sided_jacobi(factor)
        want = np.linalg.eigvalsh(v)[::-1][:rank]
        assert np.allclose(values, want, rtol=1e-9, atol=1e-15)
        assert np.allclose(vectors.T @ vectors, np.eye(rank)) and np.allclose(v @ vectors, vectors * values)


def check_whitened(rows, got, k=4):
    x = [(i, [math.floor(256 * Fraction(c)) for c in v]) for i, v in rows]
    fitted = sorted({tuple(v) for _, v in x})
    n, dim = len(fitted), len(fitted[0])
    sums = [sum(v[d] for v in fitted) for d in range(dim)]
    f = np.array(fitted, float)
    v = np.cov(f.T, bias=True).reshape(dim, dim)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = np.linalg.matrix_rank(v)
    assert len(got) == len(rows) * min(k, dim)
    signs, seen = {}, Counter()
    by_id = {i: v for i, v in x}
    for r in got:
        own = by_id[r.vec_id]
        seen[r.vec_id, r.component] += 1
        assert r.n == n
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(own, sums))
        c = r.component - 1
        if c >= rank:
            assert r.whitened is None and (r.explained == 0 or rank == 0)
            continue
        assert math.isclose(r.explained, values[c] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
        want = (np.array(own) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c])
        if abs(want) > 1e-6:
            assert signs.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert math.isclose(abs(want), abs(r.whitened), rel_tol=1e-7, abs_tol=1e-7)
    return seen


def test_given_vectors_are_whitened(spark):
    vectors = common.table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    check_whitened(rows, whitening.whitened(vectors).collect())


def test_repeated_rows_count_once_in_the_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [9, 5, 2, 1, 1, 1]).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    assert len(check_whitened(rows, whitening.whitened(frame(spark, rows)).collect())) == 70 * 4


def test_few_and_odd_vectors(spark):
    rows = [(1, [0.5, 0.25, 0]), (2, [1, 0, 0]), (3, [-0.0, 0.001, 7])]
    check_whitened(rows, whitening.whitened(frame(spark, rows)).collect())  # two components vary
    alone = whitening.whitened(frame(spark, [(1, [1, 2]), (2, [1, 2])])).collect()
    assert [(r.whitened, r.deviation, r.n, r.identity_error, r.explained) for r in alone] == [
        (None, 0, 1, 0.0, None)] * 4
    odd = [(1, None), (2, []), (3, [1, None]), (4, [float("inf"), 1]), (5, [float("nan"), 1])]
    assert whitening.whitened(frame(spark, odd)).count() == 0
    assert whitening.whitened(frame(spark, [])).count() == 0
    mixed = rows + odd + [(None, [1, 2, 3]), (6, [4, 5]), (7, [4, 6])]
    got = whitening.whitened(frame(spark, mixed)).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in got} == {1: 3, 2: 3, 3: 3, None: 3, 6: 2, 7: 2}


def test_large_numbers_are_summed_exactly(spark):
    big = 2.0 ** 16
    rows = [(i, [big + i, -big * i, 1.0]) for i in range(9)]
    got = {r.vec_id: r.deviation for r in whitening.whitened(frame(spark, rows)).collect()}
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert got == {i: sum((9 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}


# -- ranked search ---------------------------------------------------------------------

def brute_search(docs, items, k):
    cut = [(i, [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(
        r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for i, t in docs]
    n, total = sum(bool(ts) for _, ts in cut), sum(len(ts) for _, ts in cut)
    df = Counter(t for _, ts in cut for t in set(ts))
    out = []
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(brute_terms(t))
    for item, wanted in asked.items():
        found = []
        for i, ts in cut:
            if i is None or not ts:
                continue
            m, tf = 50 + 50 * len(ts) * n // total, Counter(ts)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, at, i, -s) for at, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def brute_terms(text):
    return {re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(
        r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")}


DOCS = [(1, "Alpha beta, gamma"), (2, "alpha BETA gamma"), (3, None), (4, ""), (5, "ÄÖ äö ÀB àb x1"),
        (6, "beta " * 300), (7, "no\x00nul\x7fhere alpha"), (7, "gamma"), (None, "alpha alpha"),
        (8, "., ;"), (9, "zeta"), (10, "é \U0001f600 1"), (11, "gamma beta alpha"), (12, "gamma beta alpha other")]
ITEMS = [(1, "Alpha?"), (2, "gamma-beta"), (3, None), (4, ""), (5, "äÖ ÀB \U0001f600"), (6, "unknown"),
         (7, "NUL beta"), (None, "alpha"), (8, "zeta"), (8, "alpha"), (9, "beta beta")]


@pytest.mark.parametrize("k, items", [(50, 2000), (2, 1), (1, 3)])
def test_search_equals_brute_force(spark, k, items):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, score string, m int")
    asked = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, rank int")
    got = ranked.search(docs, asked, k=k, block_items=items).collect()
    assert sorted(map(tuple, got)) == brute_search(DOCS, ITEMS, k)


def test_many_copies_enter_by_id(spark):
    rows = [(1000 - i, "one two three") for i in range(300)] + [(i, f"one w{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one"), (2, "three"), (3, "W7")], "item_id long, text string")
    got = sorted(map(tuple, ranked.search(docs.repartition(7), asked).collect()))
    assert got == brute_search(rows, [(1, "one"), (2, "three"), (3, "W7")], 50)


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(docs.limit(0), asked).count() == 0
    assert ranked.search(docs, asked.limit(0)).count() == 0
    assert ranked.search(docs, asked.filter(F.col("item_id").isin(3, 4))).count() == 0
