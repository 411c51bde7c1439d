"""Top-k search and SimHash classes against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import simhash, top_k


def brute_top(rows, k, every):
    ok = [(i, [int(np.floor(64 * float(c))) for c in x]) for i, x in rows
          if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    out = []
    for q, x in {i: x for i, x in sorted(ok, key=lambda r: r[1], reverse=True) if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]
    return sorted(out)


def search(spark, rows, k, every, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = top_k.search(df.repartition(3), F.col("vec_id") % every == 0, k, block_rows=16, **kw)
    return sorted(map(tuple, got.collect()))


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dim))
    return [(i, (centers[i % 4] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(300, 24, 1)
    assert search(spark, rows, 7, 10, group_bytes=4000) == brute_top(rows, 7, 10)


def test_odd_rows(spark):
    rows = vectors(30, 5, 2) + [
        (30, None), (31, [1.0, None]), (40, [float("nan")] * 5), (50, [float("inf")] * 5), (None, [1.0] * 5),
        (60, []), (61, []), (70, [0.0] * 5), (71, [0.0] * 5), (3, [0.5] * 5), (3, [0.5] * 5), (80, [1e7] * 5),
        (90, [2.0, 3.0]), (91, [1.0, 1.0])]
    assert search(spark, rows, 4, 10) == brute_top(rows, 4, 10)


def test_components_of_any_size(spark):
    rows = [(20, [1.0, 2.0]), (21, [5e6, 0.0]), (22, [1.0, 1.0]), (40, [-7e6, 3e9]), (23, [-4.3e6, 0.5]),
            (60, [2.0 ** 27, 0.0]), (24, [0.0, 2.0 ** 18])]
    rows = [(i, np.array(x, np.float32).tolist()) for i, x in rows]
    got = search(spark, rows, 9, 20)
    assert got == brute_top(rows, 9, 20) and (20, 3, 21, 20_480_000_000) in got
    with pytest.raises(Exception, match="does not fit a long"):
        search(spark, rows + [(61, [1e30, 0.0])], 9, 20)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [0.25, 0.25]) for i in range(50)]
    got = search(spark, rows, 3, 25)
    assert [r[2] for r in got] == [1, 2, 3, 0, 1, 2]


def test_large_components_stay_exact(spark):
    rows = [(i, [4e6 - i, 3e6 + i, -4e6]) for i in range(60)]
    assert search(spark, rows, 5, 20) == brute_top(rows, 5, 20)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-40, 40, (50, 19)), rng.integers(-40, 40, (60, 19))
    last = np.full((50, 60), np.inf)
    for s in (1, 2, 4, 8, 16, 32):
        bound = top_k.statistics(x, s) @ top_k.statistics(y, s).T
        assert (bound + 1e-9 >= x @ y.T).all()
        if s in (1, 19):
            last = np.minimum(last, bound)
    assert (last < np.inf).any()


def test_no_vectors(spark):
    assert search(spark, [(0, None)], 3, 2) == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(items, bits=3):
    """Least reachable id for each (id, fingerprint)."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        if (items[i][1] ^ items[j][1]).bit_count() <= bits:
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(items):
        if doc is not None:
            r = find(i)
            least[r] = min(doc, least.get(r, doc))
    return [least.get(find(i)) for i in range(len(items))]


TEXTS = [None, "", "  \n", "one", "One", "two words", "a b c", "A\tB\nc", "a b c d", "É b c", "é b c",
         "x y z w", "long " * 9000, "long " * 9001]


def test_fingerprints_equal_the_definition():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_classes_of_texts(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(120)) for _ in range(8)]
    near = [" ".join(w if rng.random() > 0.01 else "new" for w in b.split()) for b in base for _ in range(12)]
    texts = TEXTS + base + near + ["copy of one text here"] * 60
    items = [(i * 3 % 401, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "only without id")]
    df = spark.createDataFrame([(*x, "q", 1) for x in items], "doc_id long, text string, fp string, root int")
    got = simhash.digests(simhash.classes(df.repartition(4)))
    fps = [(i, brute_fingerprint(t)) for i, t in items]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_classes(fps))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))

    kept = simhash.representatives(df).collect()
    assert len(kept) == len({w[2] for w in want})
    assert {r.doc_id for r in kept} == {w[2] for w in want}
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root"}


@pytest.mark.parametrize("block", [4, 2048])
def test_links_join_all_that_are_near(spark, block):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 40])):
            fps.add(f)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                f ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block)
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    classes = [roots.get(f, f) for f in signed]
    want = brute_classes(list(enumerate(fps)))
    assert len(set(zip(classes, want))) == len(set(want)) == len(set(classes))


def test_anchors_of_near_halves_meet():
    x = np.random.default_rng(1).integers(0, 1 << 32, 4000, dtype=np.uint64).astype(np.uint32)
    near, _ = simhash.anchors(x)
    assert (np.bitwise_count(near ^ x) <= 1).all()
    for bit in range(32):
        other, far = simhash.anchors(x ^ np.uint32(1 << bit))
        assert ((far == near.astype(np.int64)[:, None]).any(axis=1) | (other == near)).all()


def test_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and {got[i] for i in range(101, 150)} == {100}


def test_representative_of_repeated_rows_and_rows_without_id(spark):
    rows = [(1, "same text of words"), (1, "same text of words"), (None, "same text of words"),
            (None, "another thing entirely"), (None, "another thing entirely")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, (r.doc_id for r in simhash.representatives(df).collect()))) == ["1", "None"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(none).count() == 0 and simhash.representatives(none).count() == 0


def test_an_id_with_rows_in_two_classes_stands_for_both(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(60)) for w in ("left", "right", "other"))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.representatives(docs).collect())
    assert got == sorted([(1, a), (1, b), (4, c)])
