"""Tokenizing operators against the libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from leadloom.llm import bpe_words, pretokens, repair, token_counts

BYTES, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb", "a \n b", "a\t b\r\n\r\nc", "don't we'll 'x",
    "x" * 5000, "ab " * 3000, "été naïve Straße", "日本語 テキスト", "é b c d", "\x1c\x1d a\x1fb \x85 c",
    "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "1234 56!? ...", "emoji \U0001f600 here", "\U000323b0 x",
    "꟎ y ࢏", "tail space ", "\u0000 nul", "same words same words", "same words same words",
]


def texts():
    rng = random.Random(5)
    letters = "abe  \n\té'!1　\x1c日"
    return TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", b"y") for i, t in enumerate(texts())] + [(None, "no id", 1, "x", b"y")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, n_tokens int, ids string, decoded binary").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_parts_join_to_the_text():
    cache = pretokens.PartCache(lambda p: p, None, 50)
    for t in filter(None, texts()):
        assert "".join(cache.values_of(t)) == t


def test_new_parts_encoded_together_equal_whole_texts(library):
    for limit in (20, 1_000_000):
        own = repair.Encoder(JSON)
        own.parts.limit = limit
        for t in [*texts(), "a<|endoftext|>b c<|endoftext|> d", " ".join(filter(None, texts()))]:
            assert own.encode(t or "").tolist() == library.encode(
                t or "", add_special_tokens=False).ids


def test_words_encode_like_the_library_and_decode_to_the_text(docs):
    got = by_id(bpe_words.decode(bpe_words.encode(docs, BYTES, P.PATTERN, 4, 300), BYTES))
    whole = bpe_words.encoding(BYTES, P.PATTERN)
    assert len(got) == len(texts()) + 1
    for i, t in [*enumerate(texts()), (None, "no id")]:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == whole.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()


def test_digests_of_words(docs):
    got = by_id(bpe_words.digests(bpe_words.round_trip(docs, BYTES, P.PATTERN)))
    ids = bpe_words.encoding(BYTES, P.PATTERN).encode_ordinary(TEXTS[12])
    assert got[12].n_tokens == len(ids)
    assert got[12].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[12].decoded_sha256 == hashlib.sha256(TEXTS[12].encode()).hexdigest()


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe_words.decode(df, BYTES).head().decoded is None


def test_counts_like_the_library(docs, library):
    got = by_id(token_counts.count_tokens(docs, JSON, P.PATTERN, 5))
    for i, t in enumerate(texts()):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes) == (n, len((t or "").encode())), (i, t)
        assert got[i].over_limit == (n > 5)


def test_merges_equal_repeated_lowest_rank_merging():
    merges, first = token_counts.merge_table(JSON)
    rng = random.Random(2)
    for _ in range(200):
        symbols = [first[b] for b in "".join(rng.choice("aaabnn e") for _ in range(rng.randrange(1, 14))).encode()]
        plain, n = list(symbols), 0
        while True:
            ranked = [(merges[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in merges]
            if not ranked:
                break
            i = min(ranked)[1]
            plain[i:i + 2] = [merges[plain[i], plain[i + 1]][1]]
            n += 1
        assert token_counts.count_merges(symbols, merges) == n


def test_texts_encoded_together_equal_whole_texts(library, monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    letters = [*"aBz09  \n\n\t\r'.,-$éÉß×÷\x85\xa0\u200a\u3000日\x1c\x00ªñā\u0301²", "'s", "<|endoftext|>", "<|endo"]
    for k in range(60):
        own = repair.Encoder(JSON)
        some = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(40)] + [None, ""]
        own.parts.limit = rng.choice([5, 1_000_000])
        monkeypatch.setattr(repair, "TOGETHER", rng.choice([1, 60, 1 << 20]))
        column = pa.array(["cut off", *some], pa.large_string() if k % 2 else pa.string()).slice(1)
        for t, ids in zip(some, own.encode_all(column), strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_the_library_gets_words_without_marks_and_line_breaks(library):
    class Counted:
        def __init__(self):
            self.chars = 0

        def encode_batch_fast(self, texts, **more):
            self.chars += sum(map(len, texts))
            return library.encode_batch_fast(texts, **more)

    own, rng = repair.Encoder(JSON), random.Random(9)
    own.library = Counted()
    words = ["".join(rng.choice("abdéßt") for _ in range(12)) for _ in range(200)]
    for w in words:
        text = f"{w}, {w}. {w}; {w}\n{w}: {w}"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.library.chars < 2.5 * sum(map(len, words))


def test_a_full_cache_starts_again_with_all_parts_of_the_call(library):
    class Counted:
        def __init__(self):
            self.chars = 0

        def encode_batch_fast(self, texts, **more):
            self.chars += sum(map(len, texts))
            return library.encode_batch_fast(texts, **more)

    own, rng = repair.Encoder(JSON), random.Random(10)
    own.library, own.parts.limit = Counted(), 250
    words = ["".join(rng.choice("abdéßt") for _ in range(12)) for _ in range(300)]
    first, text = " ".join(words[:200]), " ".join(words[100:])
    for t in (first, text):
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    before = own.library.chars
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.library.chars == before and len(own.parts) <= 250


def test_pairs_grouped_by_one_sort_or_by_places():
    rng = np.random.default_rng(6)
    for top in (1, 2, 300, 1 << 17, 1 << 32):
        for size in (0, 1, 500):
            left, right = (rng.integers(0, top, size, np.uint64).astype(np.uint32) // 7 * 7 for _ in range(2))
            pairs, n, order = repair._grouped(left, right)
            plain = left.astype(np.uint64) << np.uint64(32) | right
            assert [x.tolist() for x in np.unique(plain, return_counts=True)] == [pairs.tolist(), n.tolist()]
            assert order.tolist() == np.argsort(plain, kind="stable").tolist()


def test_shards_round_trip(docs, library, tmp_path):
    folder = f"file://{tmp_path}/shards"
    shards = repair.write(docs, JSON, folder, shard_ids=700).cache()
    rows = repair.read(repair.with_starts(shards), folder).orderBy("start").collect()
    order = [(None, "no id"), *enumerate(texts())]
    start = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert shards.count() > 2


def test_one_document_is_read_without_the_others():
    rng = np.random.default_rng(1)
    ids = [np.append(rng.integers(3, 12, n), 2).astype("<u2") for n in (0, 1, 5000, 20000)]
    raw = repair.pack([None, 1, 2, 3], ids, 2, 50_257)
    shard = repair.Shard(raw)
    assert len(shard.rules) > 20 and shard.doc_ids == [None, 1, 2, 3]
    for i in (3, 0, 2, 1):
        assert (shard.ids(i) == ids[i]).all()
    assert len(raw) < 2 * sum(map(len, ids))
    for left, right, length in shard.rules:
        assert 2 not in (left, right)
        assert length == len(repair.expand(np.array([left, right]), shard.rules, shard.first))


def test_runs_of_one_id_and_the_end_id_inside_a_text():
    ids = [np.array([5] * 500 + [2, 5, 6] * 100 + [2], "<u2")]
    assert (repair.Shard(repair.pack([1], ids, 2, 50_257)).ids(0) == ids[0]).all()


def test_no_pair_is_left_that_comes_twice():
    rng = np.random.default_rng(2)
    many = np.tile(rng.permutation(np.arange(3, 20_003)), 2)
    one_left = np.stack([np.full(600, 3), np.arange(4, 604)], axis=1)[np.tile(np.arange(600), 30)].ravel()
    for ids in (many, one_left, np.full(5_000, 7), rng.integers(3, 12, 20_000), rng.integers(2, 5, 3_000),
                np.array([2]), np.array([5, 5, 5, 2, 5, 5, 5, 5, 2])):
        ids = ids.astype("<u2")
        symbols, rules = repair.compress(ids, 2, 50_257)
        assert (repair.expand(symbols, rules, 50_257) == ids).all()
        comes, last = {}, None
        for pair in zip(symbols.tolist(), symbols.tolist()[1:]):
            again = pair == last and pair[0] == pair[1]
            last = None if again else pair
            if 2 not in pair and not again:
                comes[pair] = comes.get(pair, 0) + 1
        assert max(comes.values(), default=0) < 2
        assert len({(a, b) for a, b, _ in rules.tolist()}) == len(rules)
    assert len(repair.compress(np.full(5_000, 7), 2, 50_257)[0]) < 30
    assert len(repair.compress(many, 2, 50_257)[1]) > 4_096


def test_all_places_of_a_shard_are_looked_at_only_when_the_floor_falls(monkeypatch):
    rng = np.random.default_rng(3)
    words = [rng.integers(3, 5_000, rng.integers(1, 6)) for _ in range(3_000)]
    often = 1 / np.arange(1, len(words) + 1)
    ids = np.concatenate([words[i] for i in rng.choice(len(words), 66_000, p=often / often.sum())]).astype("<u2")
    looked, plain = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda a: looked.append(len(a)) or plain(a))
    symbols, rules = repair.compress(ids, 2, 50_257)
    monkeypatch.undo()
    assert (repair.expand(symbols, rules, 50_257) == ids).all()
    assert sum(looked) < 16 * len(ids)


def test_pairs_are_chosen_as_one_after_the_other():
    rng = np.random.default_rng(12)
    for top in (1, 2, 5, 40, 900):
        for size in (0, 1, 30, 2_000):
            pairs = np.unique(rng.integers(0, top, size) << 32 | rng.integers(0, top, size)).astype(np.uint64)
            if top == 900 and size == 30:  # a chain, each pair against the next
                pairs = (np.arange(800) << 32 | np.arange(1, 801)).astype(np.uint64)
            n = np.sort(rng.integers(1, 900, len(pairs)))[::-1] if top == 900 else rng.integers(1, 9, len(pairs))
            lefts, rights, chosen = set(), set(), []
            for i in sorted(range(len(pairs)), key=lambda i: -n[i]):
                a, b = divmod(int(pairs[i]), 1 << 32)
                if n[i] >= 3 and a not in rights and b not in lefts:
                    lefts.add(a), rights.add(b), chosen.append(i)
            new = repair._choose(pairs, n, 3, top)
            assert np.flatnonzero(new).tolist() == sorted(chosen)
            assert new[new > 0].tolist() == list(range(top, top + len(chosen)))


def test_packed_columns():
    rng = np.random.default_rng(4)
    for bits in (0, 1, 7, 8, 17, 32, 33, 63, 64):
        for n in (0, 1, 3, 100):
            values = rng.integers(0, 2 ** bits, n, np.uint64, endpoint=False) if bits < 64 else rng.integers(
                0, 2 ** 64 - 1, n, np.uint64, endpoint=True)
            column = repair._Packed(b"xyz" + repair._packed(values), 3, n)
            assert column.end == 3 + len(repair._packed(values))
            assert column.all().tolist() == values.tolist()
            for a, b in ((0, 0), (n // 3, n // 2), (n // 2, n)):
                assert column.run(a, b).tolist() == values[a:b].tolist()


def test_any_ids_of_documents_and_steps_of_rules():
    ids = [-2 ** 63, -5, None, 0, 7, 7, 2 ** 63 - 1]
    texts = [np.append(np.tile([9, 300 * i + 8, 60_000], 40), 2).astype("<u4") for i in range(len(ids))]
    shard = repair.Shard(repair.pack(ids, texts, 2, 70_000))
    assert shard.doc_ids == ids
    assert all((shard.ids(i) == t).all() for i, t in enumerate(texts))


def test_shards_of_whole_texts_are_small(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toPandas()
    own = repair.encoder(JSON)
    ids = [np.append(own.encode(t or ""), 2).astype(own.dtype) for t in table["text"]]
    raw = repair.pack(list(range(len(ids))), ids, 2, own.library.get_vocab_size())
    assert len(raw) <= 0.6 * 2 * sum(map(len, ids))
    shard = repair.Shard(raw)
    assert all((shard.ids(i) == x).all() for i, x in enumerate(ids))


def test_digest_of_shards(spark, docs, library):
    got = by_id(repair.digests(docs, JSON))
    ids = np.array([*library.encode(TEXTS[12], add_special_tokens=False).ids, 2], "<u4")
    assert got[12].ids_crc32 == zlib.crc32(ids.tobytes())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not bpe_words.digests(bpe_words.decode(bpe_words.encode(none, BYTES, P.PATTERN), BYTES)).count()
    assert not token_counts.count_tokens(none, JSON, P.PATTERN).count()
    assert not repair.digests(none, JSON).count()


def test_repeated_rows_stay(spark):
    twice = spark.range(2).select(F.lit(7).alias("doc_id"), F.lit("a b").alias("text"))
    assert bpe_words.encode(twice, BYTES, P.PATTERN).count() == 2
    assert [r.start for r in repair.digests(twice, JSON).orderBy("start").collect()] == [0, 3]
