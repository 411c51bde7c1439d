"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Encoding takes three steps. (1) Each task cuts its texts into pre-tokens with their positions
and writes blocks: the positions as one sequence of word numbers, and the block's distinct words,
dealt into buckets by hash. (2) Words meet by bucket, so that every distinct word of the whole
table lies in one task and is encoded once there; its ids go back to each block that has it.
(3) Blocks put the ids together by position; the table of blocks is bucketed, so this join moves
ids but no texts. A word comes at most once per block to its bucket,
so a very frequent word is no larger than a rare one. Blocks and words travel packed and
compressed, which keeps the shuffle below the size of the texts.

Null texts are empty; empty texts have no ids. Any row gives one row, repeated ids included.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from leadloom import session
from leadloom.llm import common
from leadloom.llm.pretokens import PartCache, pieces

#: A block ends with the text that brings it to so many characters.
BLOCK_CHARS = 3_000_000
#: Rows of an Arrow batch, unless the session sets its own number.
BATCH_ROWS = 500
#: Words are dealt into at least so many buckets.
BUCKETS = 64

_PACKED = "block string, bucket int, n long, payload binary"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Compressed arrays, wide integers byte plane by byte plane."""
    import zstandard

    raw = b"".join(len(a).to_bytes(8, "little")
                   + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
                   for a in arrays)
    return zstandard.compress(raw, 3)


def _expand(payload: bytes, *dtypes: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(payload), 0, []
    for t in dtypes:
        n, width = int.from_bytes(raw[at:at + 8], "little"), np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += 8 + n * width
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class _Block:
    """Distinct parts and words of some texts, and where they stand."""

    def __init__(self, pattern: str):
        self.pattern, self.chars = pattern, 0
        self.words: dict[str, int] = defaultdict(lambda: len(self.words))
        self.parts: list[list[int]] = []
        self.of_part = PartCache(self._part, -1, 1 << 62)
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []

    def _part(self, part: str) -> int:
        found = pieces(part, self.pattern)
        self.parts.append([self.words[w] for w in ([part] if found is None else found)])
        return len(self.parts) - 1

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        self.texts.append(np.array(self.of_part.values_of(text or ""), dtype=np.int64))
        self.chars += len(text or "")

    def rows(self, name: str, buckets: int) -> Iterator[tuple]:
        sizes = np.array([len(p) for p in self.parts], dtype=np.int64)
        flat = np.array([w for p in self.parts for w in p], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        parts = np.concatenate([*self.texts, np.empty(0, np.int64)])
        lengths = np.array([sizes[t].sum() for t in self.texts], dtype=np.uint32)
        sequence = flat[gather(starts[parts], sizes[parts])]
        # Within a bucket the frequent words come first, so most numbers are small.
        often = np.bincount(sequence, minlength=len(self.words)).tolist()
        words = sorted((zlib.crc32(b := w.encode()) % buckets, -often[i], b, i)
                       for w, i in self.words.items())
        of = np.array([w[0] for w in words], dtype=np.uint16)
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        order = np.array([w[3] for w in words], dtype=np.int64)
        bucket_of, rank_of = np.empty(len(of), np.uint16), np.empty(len(of), np.uint32)
        bucket_of[order], rank_of[order] = of, rank
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype=np.int64)
        yield name, -1, len(ids), _squeeze(
            ids, known, lengths, bucket_of[sequence], rank_of[sequence])
        for b in np.unique(of):
            own = [w[2] for w in words[np.searchsorted(of, b):np.searchsorted(of, b, "right")]]
            yield (name, int(b), len(own), _squeeze(
                np.array([len(w) for w in own], dtype=np.uint32),
                np.frombuffer(b"".join(own), np.uint8)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "bucket", "n", "payload"])


def _cut(pattern: str, buckets: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), 0, _Block(pattern)
        for doc_id, text in common.rows_of(batches, "doc_id", "text"):
            block.add(doc_id, text)
            if block.chars >= block_chars:
                yield _batch(list(block.rows(f"{part}-{number}", buckets)))
                number, block = number + 1, _Block(pattern)
        if block.ids:
            yield _batch(list(block.rows(f"{part}-{number}", buckets)))

    return run


@cache
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Encoded(dict):
    """Ids of each word, found when first asked for."""

    def __init__(self, path: str, pattern: str):
        self.encode = encoding(path, pattern).encode_ordinary

    def __missing__(self, word: bytes) -> list[int]:
        self[word] = got = self.encode(word.decode())
        return got


def _encode_words(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, encoded = None, None
        for name, bucket, n, payload in common.rows_of(batches, "block", "bucket", "n", "payload"):
            if bucket != last:
                last, encoded = bucket, _Encoded(path, pattern)
            lengths, raw = _expand(payload, "<u4", "u1")
            ends, text = np.cumsum(lengths).tolist(), raw.tobytes()
            got = [encoded[text[a:b]] for a, b in zip([0, *ends], ends)]
            yield _batch([(name, bucket, n, _squeeze(
                np.array([len(g) for g in got], dtype=np.uint32),
                np.array([i for g in got for i in g], dtype=np.uint32)))])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row has a block: its texts, and the ids of its words by bucket."""
    for texts, words in common.rows_of(batches, "payload", "words"):
        doc_ids, known, lengths, bucket, rank = _expand(texts, "<i8", "u1", "<u4", "<u2", "<u4")
        numbers, sizes, ids = [], [], []
        for w in sorted(words or [], key=lambda w: w["bucket"]):
            size, flat = _expand(w["payload"], "<u4", "<u4")
            numbers.append(w["bucket"])
            sizes.append(size.astype(np.int64))
            ids.append(flat)
        first = np.zeros(max(numbers, default=0) + 1, np.int64)
        first[numbers] = np.cumsum([0, *map(len, sizes)])[:len(numbers)]
        size = np.concatenate([*sizes, np.empty(0, np.int64)])
        flat = np.concatenate([*ids, np.empty(0, np.uint32)])
        starts = np.cumsum(size) - size
        ends = np.cumsum(lengths.astype(np.int64))
        out, held = [], 0
        for i, (a, b) in enumerate(zip(ends - lengths, ends)):
            at = first[bucket[a:b]] + rank[a:b]
            got = flat[gather(starts[at], size[at])].astype("<u4").tobytes()
            out.append((int(doc_ids[i]) if known[i] else None, got))
            held += len(got)
            if held > 1 << 23:
                yield _encoded_batch(out)
                out, held = [], 0
        if out:
            yield _encoded_batch(out)


def _encoded_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
        ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, buckets: int = BUCKETS,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers) of each row of ``docs``.

    ``path`` is a file of token bytes and ranks that all executors have, ``pattern`` cuts texts
    into words. Takes columns ``doc_id`` and ``text``; other columns are not read.
    """
    return _joined(docs, path, pattern, buckets, block_chars).mapInArrow(
        _assemble, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, buckets: int = BUCKETS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``encode`` and ``decode`` in one Python worker per task, which halves their memory."""
    back = _decoder(path)
    return _joined(docs, path, pattern, buckets, block_chars).mapInArrow(
        lambda batches: back(_assemble(batches)), "doc_id long, ids binary, decoded binary")


def _joined(docs: DataFrame, path: str, pattern: str, buckets: int,
            block_chars: int) -> DataFrame:
    """Each block's texts with the ids of its words."""
    spark = docs.sparkSession
    # Rows are large here: the default of 10,000 rows to a batch takes hundreds of MB.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(buckets, parts), 1 << 16)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = _written(slim.mapInArrow(_cut(pattern, buckets, block_chars), _PACKED), parts)
    words = cut.filter("kind = 'words'").select("block", "bucket", "n", "payload").repartition(
        buckets, "bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encode_words(path, pattern), _PACKED).groupBy("block").agg(
        F.collect_list(F.struct("bucket", "payload")).alias("words"))
    texts = cut.filter("kind = 'texts'").select("block", "payload")
    # Blocks without words have no ids.
    return texts.join(ids, "block", "left").select("payload", "words")


def _written(blocks: DataFrame, parts: int) -> DataFrame:
    """The blocks in the shared folder, bucketed so that the join by block moves no texts.

    Spark keeps bucketing with a named table. Name and files are scratch: both may go once the
    result is written.
    """
    spark = blocks.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    kind = F.when(F.col("bucket") < 0, "texts").otherwise("words")
    blocks.withColumn("kind", kind).write.partitionBy("kind").bucketBy(parts, "block").option(
        "path", session.fresh_path(spark, "bpe-blocks")).saveAsTable(name)
    return spark.table(name)


@cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: as long as the vocabulary, whatever the data."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows with ``ids``; null ids give null."""
    return encoded.mapInArrow(
        _decoder(path), T.StructType(list(encoded.schema.fields)).add("decoded", "binary"))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = token_bytes(path).__getitem__
        for batch in batches:
            got = [None if ids is None else
                   b"".join(map(lookup, np.frombuffer(ids, "<u4").tolist()))
                   for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
