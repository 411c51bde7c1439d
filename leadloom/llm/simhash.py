"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two fingerprints within 3 bits differ in at most one bit of one of
their 32-bit halves. Anchors of a half are the words of a covering code: the Hamming code of
length 31 with a free last bit, whose covering radius is 1. With radius 1 and threshold 1, each
fingerprint is copied to every anchor within 2 bits of a half (17 at most). For two halves within
one bit, the anchor nearest to the one is within two of the other, so both meet there. Each anchor
compares its nearest fingerprints ("homes") with all others.

Equal fingerprints are one before anything is compared. An anchor with many fingerprints is cut
into blocks and its pairs of blocks are compared in separate tasks. Of all links found together,
a spanning forest goes on, so a group of near copies makes few rows; classes are then joined by
star contraction over written tables. No link between different fingerprints is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from leadloom.llm import common

BITS = 3
SHINGLE = 3
SEED = 42
#: An anchor with more fingerprints is compared block by block.
BLOCK = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if set in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends[:n - 1].tolist()]
    last = (ends[shingle - 1:] - 1).tolist() if len(words) >= shingle else [len(joined)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(first, last)], dtype="<u8")
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of each row; null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()],
                           dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, fp long")


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of 32-bit halves: the nearest one, and all others within two bits (0: none).

    The syndrome of the lower 31 bits is the XOR of the places (1 to 31) of set bits. It names the
    bit to flip for the nearest code word; pairs of places whose XOR is the syndrome give the code
    words at two bits.
    """
    low, top = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    places = np.arange(1, 32, dtype=np.uint32)
    syndrome = np.zeros(len(half), np.uint32)
    for p in places:
        syndrome ^= np.where(low >> np.uint32(p - 1) & 1, p, 0).astype(np.uint32)
    flip = np.concatenate([[0], 1 << np.arange(31)]).astype(np.uint32)
    near = low ^ flip[syndrome]
    other = syndrome[:, None] ^ places
    pairs = (other > places) & (syndrome[:, None] > 0)
    two = low[:, None] ^ flip[places] ^ flip[np.minimum(other, 31)]
    far = np.concatenate([two | top[:, None], (near | (top ^ np.uint32(0x80000000)))[:, None]], 1)
    ok = np.concatenate([pairs, np.ones((len(half), 1), bool)], 1)
    return near | top, np.where(ok, far.astype(np.int64), -1)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        for side in (0, 1):
            half = (fp.view(np.uint64) >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(
                np.uint32)
            near, far = anchors(half)
            row, col = np.nonzero(far >= 0)
            key = np.concatenate([near.astype(np.int64), far[row, col]]) | (side << 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.concatenate([fp, fp[row]])),
                 pa.array(np.arange(len(key)) < len(fp))], ["anchor", "fp", "home"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(members: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member that each member reaches over the pairs of positions."""
    root = np.arange(len(members))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    return members[[find(i) for i in range(len(members))]]


def _links_of_group(fp: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray,
                    bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among one group: homes are compared with all, ``left`` with ``right``."""
    order = np.argsort(fp)
    fp, home, left, right = fp[order], home[order], left[order], right[order]
    bare, a, b = fp.view(np.uint64), np.nonzero(left)[0], np.nonzero(right)[0]

    def pairs():
        for x, y in ((a[home[a]], b), (b[home[b]], a)):
            for at in range(0, len(x), 256):
                part = x[at:at + 256]
                i, j = np.nonzero(_popcount(bare[part][:, None] ^ bare[y]) <= bits)
                i, j = part[i], y[j]
                yield i[i != j], j[i != j]

    least = _forest(fp, pairs())
    linked = least != fp
    return fp[linked], least[linked]


def _compare(bits: int):
    """Rows come sorted by group; whole groups are compared, singles cost nothing."""
    names = ("anchor", "i", "j", "fp", "home", "slot")

    def groups(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = np.stack([c["anchor"], c["i"], c["j"]])
        cuts = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [key.shape[1]]])
        homes = np.concatenate([[0], np.cumsum(c["home"])])
        useful = (ends - starts > 1) & (homes[ends] > homes[starts])
        two = useful & (ends - starts == 2)
        x, y = c["fp"][starts[two]], c["fp"][starts[two] + 1]
        near = _popcount(x.view(np.uint64) ^ y.view(np.uint64)) <= bits
        found = [(np.maximum(x, y)[near], np.minimum(x, y)[near])]
        for s, e in zip(starts[useful & ~two], ends[useful & ~two]):
            slot, i, j = c["slot"][s:e], c["i"][s], c["j"][s]
            found.append(_links_of_group(c["fp"][s:e], c["home"][s:e], slot == i, slot == j, bits))
        a, b = zip(*found)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            if not b.num_rows:
                continue
            c = c if held is None else {n: np.concatenate([held[n], c[n]]) for n in names}
            last = np.nonzero((c["anchor"] != c["anchor"][-1]) | (c["i"] != c["i"][-1])
                              | (c["j"] != c["j"][-1]))[0]
            cut = last[-1] + 1 if len(last) else 0
            held = {n: v[cut:] for n, v in c.items()}
            if cut:
                yield _link_batch(*groups({n: v[:cut] for n, v in c.items()}))
        if held is not None:
            yield _link_batch(*groups(held))

    return run


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Pairs ``a``, ``b`` of different fingerprints that join all that are within ``bits``.

    ``distinct`` has each ``fp`` once. Two halves carry at most three different bits.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves of covering radius 1 find links of up to 3 bits")
    at = common.staged(
        distinct.mapInArrow(_to_anchors, "anchor long, fp long, home boolean"), "anchors")
    large = at.groupBy("anchor").count().filter(F.col("count") > block).select(
        "anchor", F.ceil(F.col("count") / block).cast("int").alias("slots"))
    large = common.staged(large, "large-anchors")
    slots = F.coalesce("slots", F.lit(1))
    dealt = at.join(large, "anchor", "left").withColumns({
        "slot": F.pmod(F.xxhash64("fp"), slots).cast("int"), "slots": slots})
    # A row of slot s goes to the pairs (i, s) with i <= s and (s, j) with j > s.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    dealt = dealt.select(
        "anchor", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"),
        "fp", "home", "slot")
    return dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j") \
        .mapInArrow(_compare(bits), "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and the smallest ``root`` it reaches, for every node of ``pairs`` (a, b).

    Large-star and small-star steps by turns, each over a table written to the shared folder,
    until no link changes. A star step is a minimum per node (summed up before the shuffle) and
    a join, which Spark splits if a node is hot.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both if large else edges
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        moved = seen.join(least, "a")
        if large:
            moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return moved.filter("a != b").distinct()

    def put(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = common.staged(df, "links")
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        return out, tuple(mark)

    edges, mark = put(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct())
    while mark[0]:
        edges, new = put(stars(stars(edges, True), False))
        if new == mark:
            break
        mark = new
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def classes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id, root`` of each row: the class by its smallest ``doc_id`` and
    by its smallest fingerprint.

    Texts without words have fingerprint 0 and link like any other. Repeated rows stay, and rows
    without an id belong to classes too; a class of such rows alone has a null id.
    """
    marked = common.staged(fingerprints(docs), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = common.staged(distinct, "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.staged(rooted.join(ids, "root"), "classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each class, with all its columns: that with the smallest ``doc_id``.

    Among repeated rows of that id in the class, and in a class without ids, one row stays. An id
    whose rows are in several classes may stand for each of them.
    """
    found = classes(docs, bits)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first_of = kept.filter("doc_id IS NOT NULL").groupBy("root").agg(
        F.min("doc_id").alias("__id"), F.min("fp").alias("__fp")).select("__id", "__fp")
    mixed = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__mixed")).agg(
        F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a != b").select("__mixed")
    ids, out = first_of.select("__id").distinct(), None
    if not mixed.isEmpty():
        # Only these ids need the fingerprint to tell which of their rows stands for a class.
        of_mixed = docs.join(mixed, F.col("doc_id").cast("long") == F.col("__mixed"), "left_semi")
        marked = _marked(of_mixed)
        rows = marked.join(first_of.withColumnRenamed("__fp", "__first"), (
            F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__fp") == F.col("__first")))
        out = _first_rows(rows, "__id", "__fp").select(*docs.columns)
        ids = ids.join(mixed, F.col("__id") == F.col("__mixed"), "left_anti")
    rows = docs.join(ids, F.col("doc_id").cast("long") == F.col("__id"))
    with_id = _first_rows(rows, "__id").select(*docs.columns)
    out = with_id if out is None else with_id.unionByName(out)
    bare = docs.filter(F.col("doc_id").isNull())
    if bare.isEmpty():
        return out
    fps = kept.filter("doc_id IS NULL AND fp = root").select(F.col("fp").alias("__fp")).distinct()
    return out.unionByName(
        _marked(bare).join(fps, "__fp").dropDuplicates(["__fp"]).select(*docs.columns))


def _first_rows(rows: DataFrame, *keys: str) -> DataFrame:
    first = W.partitionBy(*keys).orderBy(F.xxhash64("text"))
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1")


def _marked(docs: DataFrame) -> DataFrame:
    """The rows with their fingerprint as ``__fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(got.view(np.int64))], [*b.schema.names, "__fp"])

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add("__fp", "long"))
