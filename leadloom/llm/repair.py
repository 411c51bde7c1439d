"""Token ids in binary shards under Re-Pair grammar compression.

Documents are ordered by id, encoded, and written in shards. Within a shard the most frequent
pairs of neighbouring ids are replaced by new symbols, again and again; the shard's file holds the
rules (left, right, and the number of ids a symbol stands for), the symbols, and the number of
symbols of each document, so that one document is decoded without the others. The end id closes
each document and is part of no rule, so no symbol reaches into the next document.

Rounds go on until no pair comes twice in the shard. Places of the shard are linked, and each keeps
how often its pair comes at most, by hash buckets or counted exactly. Rounds replace pairs that come
at least a quarter of the greatest count, until few are left; then that floor falls, and only then
all places are looked at again. In between a round counts exactly the pairs left over by the one
before and those with its new symbols, as no other pair gains places. Pairs of a round share no
symbol between a left and a right place, so replacements never overlap. A run of one symbol is
replaced left to right.

A file: 8 bytes ``RPAIR002``; seven unsigned 64-bit numbers (documents, ids, symbols, rules, first
rule's symbol, end id, different ids); then packed columns: different ids of the shard (steps); document ids
(steps; 0 if null), known or not, symbols and ids of each document; of the rules the left symbols
(steps, short), right symbols, lengths (short); the symbols. Symbols are numbered densely: the
shard's different ids in order, then the rules. A packed column is a byte with the bits of a value,
and the values in that many bits each, lowest first. A short column is a byte for each value and a
packed column of those from 255 on. Steps are differences of neighbours, modulo 2 to the 64th
(left symbols: 32nd). A document's symbols are found by their place in bits and unpacked alone.
Null texts are empty; each document has at least its end id. Rows of equal id are written in the
order of their texts; rows without an id come first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from leadloom import session
from leadloom.llm.pretokens import unsafe
from leadloom.llm.token_counts import special_tokens, split_specials

MAGIC = b"RPAIR002"
END_ID = 2
#: Ids in a shard; a shard ends with the document that reaches this.
SHARD_IDS = 2_000_000
#: A pair that comes less often is left alone; 2 is plain Re-Pair.
LEAST = 2
#: Bytes of text that are cut and looked up together; a longer text by itself.
TOGETHER = 4 << 20
#: A round of fewer rules is the last at its count; what it leaves is replaced at lower counts.
FEW = 1_000
#: Pairs of a round come at least this part of the greatest count.
STEP = 4
_HASH_BITS = 18
#: Places keep counts up to this.
_MOST = (1 << 16) - 1
#: In place of a new symbol: the pair is frequent but not chosen in this round.
_WAITS = (1 << 32) - 1


def _classes() -> bytes:
    table = bytearray(256)
    for b in range(0x21, 0x7F):
        table[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    table[ord("'")] = _QUOTE
    for b in b"\t\n\v\f\r ":
        table[b] = _SPACE
    return bytes(table)


#: Kinds of bytes; 0 for those of which a single byte says too little. From ``_QUOTE`` on visible.
_SPACE, _QUOTE, _DIGIT, _MARK, _LETTER = 1, 2, 3, 4, 5
_CLASSES = _classes()


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 text where a piece of the byte-level pattern ends whatever stands around.

    These lie before white space that follows a visible character, between a letter and a mark
    (but the quote), and between a letter and the line break before it if it stands alone.
    """
    kind = np.frombuffer(bytearray(data.tobytes().translate(_CLASSES)), "u1")
    # U+00C0 to U+00FF: letters but for two signs.
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    sign = (data[second] == 0x97) | (data[second] == 0xB7)
    kind[second] = np.where(sign, _QUOTE, _LETTER)
    left, right = kind[:-1], kind[1:]
    cut = (left >= _QUOTE) & (right == _SPACE)
    line = np.flatnonzero((data[1:-1] == 10) & cut[:-1]) + 1
    cut |= (left == _LETTER) & (right == _MARK)
    cut[line[right[line] == _LETTER]] = True
    return cut


class Encoder:
    """Ids of texts with one byte-level vocabulary file; each different part is encoded once.

    Texts are cut where the pattern always ends a piece, see ``_cuts``. Arrow numbers the different
    parts of many texts, and those that are new go to the library. Parts that start with a space
    and end with a visible character go as one string: no token spans two of them, and the bytes of
    the tokens say where a part ends.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = {s: self.library.token_to_id(s) for s in special_tokens(path)}
        small = self.library.get_vocab_size() < 1 << 16
        self.dtype = np.dtype("<u2" if small else "<u4")
        self.parts = Parts(self.dtype)
        # A byte-level token is written with one character for each of its bytes.
        self.n_bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.n_bytes[i] = len(token)
        self.joins = not any(" " in s for s in self.specials)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has."""
        found = [f.ids for f in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(n.sum())), n

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts and how many each has; the parts come in the order of ``new``."""
        texts = [p.decode() for p in new]
        join = np.array([self.joins and t[0] == " " and not unsafe(t[1:]) for t in texts], bool)
        alone = np.flatnonzero(~join)
        ids, n = self._library([texts[i] for i in alone])
        if len(alone) < len(new):
            joined, _ = self._library(["".join(t for t, j in zip(texts, join) if j)])
            sizes = np.fromiter(map(len, new), np.int64, len(new))[join]
            ends = np.searchsorted(np.cumsum(self.n_bytes[joined]), np.cumsum(sizes)) + 1
            ids, n = np.concatenate([ids, joined]), np.append(n, np.diff(ends, prepend=0))
            order = np.argsort(np.append(alone, np.flatnonzero(join)))
            ids, n = _taken(ids, (np.cumsum(n) - n)[order], n[order]), n[order]
        return ids, n

    def _plain(self, offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """Ids of texts without special strings, as offsets into their bytes."""
        if not len(data):
            return [np.empty(0, self.dtype)] * (len(offsets) - 1)
        cut = np.append(_cuts(data), True)
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        cut[inner - 1] = True
        ends = np.append(0, np.flatnonzero(cut) + 1)
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(ends) - 1,
            [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(data)]).dictionary_encode()
        places, stops = parts.indices.to_numpy(), np.frombuffer(parts.dictionary.buffers()[1], "<i8")
        raw = parts.dictionary.buffers()[2].to_pybytes()
        stops = stops[:len(parts.dictionary) + 1].tolist()
        known = self.parts.places([raw[a:b] for a, b in zip(stops, stops[1:])], self._learn)[places]
        start, size = self.parts.ends[known], np.diff(self.parts.ends)[known]
        ids, to = _taken(self.parts.ids, start, size), np.append(0, np.cumsum(size))
        stops = to[np.searchsorted(ends, offsets)].tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:])]

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string array, null as empty; ``TOGETHER`` bytes of text at a time."""
        texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset:][:len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", "u1")
        a = 0
        while a < len(texts):
            b = int(np.searchsorted(offsets, offsets[a] + TOGETHER, "right")) - 1
            b = min(max(b, a + 1), len(texts))
            some = data[offsets[a]:offsets[b]]
            if any(s.encode() in some.tobytes() for s in self.specials):
                yield from map(self._with_specials, texts[a:b].cast(pa.large_string()).to_pylist())
            else:
                yield from self._plain(offsets[a:b + 1] - offsets[a], some)
            a = b

    def _with_specials(self, text: str) -> np.ndarray:
        out = []
        for t in split_specials(text, list(self.specials)):
            if t in self.specials:
                out.append(np.array([self.specials[t]], self.dtype))
            else:
                raw = np.frombuffer(t.encode(), "u1")
                out += self._plain(np.array([0, len(raw)]), raw)
        return np.concatenate(out)

    def encode(self, text: str) -> np.ndarray:
        found, = self.encode_all(pa.array([text], pa.string()))
        return found


def _taken(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``size`` values from ``start`` on, one after another."""
    to = np.cumsum(size)
    return values[np.repeat(start - to + size, size) + np.arange(to[-1] if len(to) else 0)]


class Parts(dict):
    """The number of each known part, and the ids of all in one array.

    Holds ``limit`` parts or those of one call: when full it starts again with those of the call.
    """

    limit = 1_000_000

    def __init__(self, dtype: np.dtype):
        super().__init__()
        self.ids, self.ends = np.empty(0, dtype), np.zeros(1, np.int64)

    def places(self, keys: list[bytes], learn: Callable) -> np.ndarray:
        """The numbers of different parts; ``learn`` gives ids and sizes of those not known."""
        found = list(map(self.get, keys))
        new = [k for k, i in zip(keys, found) if i is None]
        if new and len(self) + len(new) > self.limit:
            old = [k for k, i in zip(keys, found) if i is not None]
            kept = np.array([i for i in found if i is not None], np.int64)
            size = np.diff(self.ends)[kept]
            self.ids, self.ends = _taken(self.ids, self.ends[kept], size), np.append(0, np.cumsum(size))
            self.clear()
            self.update(zip(old, range(len(old))))
            found = list(map(self.get, keys))
        if new:
            ids, n = learn(new)
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(n))
            fresh = iter(range(len(self) - len(new), len(self)))
            found = [next(fresh) if i is None else i for i in found]
        return np.array(found, np.int64)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _bucket_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint32(2654435761) ^ right * np.uint32(2246822519)
    return mixed >> np.uint32(32 - _HASH_BITS)


def _bucket_sizes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair how many of all come to its hash bucket."""
    bucket = _bucket_of(left, right)
    return np.bincount(bucket, minlength=1 << _HASH_BITS)[bucket]


def compress(ids: np.ndarray, end_id: int, first: int, least: int = LEAST
             ) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right, length) of a run of ids below ``first``.

    When it ends, no pair without the end id comes ``least`` times; pairs of equal symbols count
    from the left without overlap.
    """
    size, place = len(ids), np.int32 if len(ids) < 1 << 31 else np.int64
    # One more place stands for the end of the shard.
    symbols = np.append(ids.astype(np.uint32), np.uint32(end_id))
    after, before = np.arange(1, size + 2, dtype=place), np.arange(-1, size, dtype=place)
    alive = np.ones(size, bool)
    # How often a place's pair comes at most, up to ``_MOST``; 0 beside an end id. Only pairs with a
    # new symbol gain places, all in the round that makes it.
    most = np.zeros(size + 1, np.uint16)
    at = np.flatnonzero((symbols[:-1] != end_id) & (symbols[1:] != end_id))
    most[at] = np.minimum(_bucket_sizes(symbols[at], symbols[at + 1]), _MOST)
    rules, length, floor = [], np.ones(first, np.uint32), size
    while floor > least:
        floor = max(least, min(floor, int(most.max())) // STEP)
        at = np.flatnonzero(most >= floor)
        # What a bucket holds is no less than what each of its pairs holds.
        held = _bucket_sizes(symbols[at], symbols[after[at]])
        most[at] = np.minimum(held, _MOST)
        at = at[held >= floor]
        while len(at):
            left, right, top = symbols[at], symbols[after[at]], len(length)
            even = _even_in_run(at, after, left == right)
            odd, at = at[~even], at[even]
            pairs, n, order = _grouped(left[even], right[even])
            new = _choose(pairs, n, floor, top)
            chosen = np.flatnonzero(new)
            a, b = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
            # Runs stay as they are, for the places between.
            rare = (n < floor) & (a != b)
            most[at[order[np.repeat(rare, n)]]] = np.repeat(np.minimum(n[rare], _MOST), n[rare])
            a, b = a[chosen], b[chosen]
            made = np.stack([a, b, length[a] + length[b]], axis=1).astype(np.uint32)
            rules.append(made)
            length = np.concatenate([length, made[:, 2]])
            new[(n >= floor) & (new == 0)] = _WAITS
            # In the order of the places: their neighbours lie beside them.
            symbol = np.empty(len(at), np.uint32)
            symbol[order] = np.repeat(new, n)
            rest = np.concatenate([at[symbol == _WAITS], odd])
            found = np.flatnonzero((symbol > 0) & (symbol < _WAITS))
            hit, symbol = at[found], symbol[found]
            gone = after[hit]
            right_of = after[gone]
            symbols[hit] = symbol
            alive[gone] = False
            after[hit] = right_of
            before[right_of] = hit
            left_of = before[hit]
            most[hit] = most[gone] = most[left_of] = 0
            rest = rest[most[rest] > 0]
            # All places of pairs with a new symbol, those of two new symbols once.
            left = symbols[left_of]
            old = left < top
            fresh = np.concatenate([hit, left_of[old]])
            left = np.concatenate([symbol, left[old]])
            right = np.concatenate([symbols[right_of], symbol[old]])
            free = (left != end_id) & (right != end_id)
            fresh = fresh[free]
            held = _bucket_sizes(left[free], right[free])
            most[fresh] = np.minimum(held, _MOST)
            if len(chosen) < (1 if floor == least else FEW):
                break
            at = np.sort(np.concatenate([rest, fresh[held >= floor]]))
    return symbols[:-1][alive], np.concatenate([np.empty((0, 3), np.uint32), *rules])


def _even_in_run(at: np.ndarray, after: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Drops every second place of a run of equal symbols: there pairs would overlap."""
    keep = np.ones(len(at), bool)
    places = np.flatnonzero(same)
    if len(places):
        where = at[places]
        starts = np.append(True, after[where[:-1]] != where[1:])
        order = np.arange(len(places))
        begin = np.maximum.accumulate(np.where(starts, order, 0))
        keep[places] = (order - begin) % 2 == 0
    return keep


def _grouped(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, how often each comes, and the places in the order of their pairs."""
    size, width = len(left), int(right.max(initial=0)).bit_length()
    low = size.bit_length()
    if int(left.max(initial=0)).bit_length() + width + low <= 64:
        # Pair and place in one number: numbers sort faster than their places.
        both = (left.astype(np.uint64) << np.uint64(width) | right) << np.uint64(low)
        both |= np.arange(size, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << low) - 1)).view(np.int64)
        keys = both >> np.uint64(low)
    else:
        keys = left.astype(np.uint64) << np.uint64(width) | right
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:size])
    found = keys[starts]
    pairs = found >> np.uint64(width) << np.uint64(32) | found & np.uint64((1 << width) - 1)
    return pairs, np.diff(starts, append=size), order


def _choose(pairs: np.ndarray, n: np.ndarray, floor: int, top: int) -> np.ndarray:
    """New symbols from ``top`` on for pairs that come ``floor`` times, most frequent first; else 0.

    New symbols go by the order of ``pairs``. No symbol is both a left and a right one, except in a
    pair of its own, so places of chosen pairs never overlap.
    """
    able = np.flatnonzero(n >= floor)
    able = able[np.argsort(-n[able], kind="stable")]
    lefts = (pairs[able] >> np.uint64(32)).astype(np.int64)
    rights = (pairs[able] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    on_left, on_right, chosen = np.zeros(top, bool), np.zeros(top, bool), np.zeros(len(able), bool)
    none, rank = len(able), np.arange(len(able))
    # Pairs that no open pair before them stands against, all at once; what is left, one by one.
    for _ in range(6):
        a, b = lefts[rank], rights[rank]
        first_left, first_right = np.full(top, none), np.full(top, none)
        np.minimum.at(first_left, a, rank)
        np.minimum.at(first_right, b, rank)
        free = (first_right[a] >= rank) & (first_left[b] >= rank)
        chosen[rank[free]] = on_left[a[free]] = on_right[b[free]] = True
        rank = rank[~(free | on_right[a] | on_left[b])]
    on_left, on_right = bytearray(on_left), bytearray(on_right)
    for i, a, b in zip(rank.tolist(), lefts[rank].tolist(), rights[rank].tolist()):
        if not on_right[a] and not on_left[b]:
            on_left[a] = on_right[b] = 1
            chosen[i] = True
    new = np.zeros(len(pairs), np.uint32)
    new[np.sort(able[chosen])] = np.arange(top, top + np.count_nonzero(chosen))
    return new


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    symbols = symbols.astype(np.uint32)
    length = np.concatenate([np.ones(first, np.int64), rules[:, 2].astype(np.int64)])
    ends = np.cumsum(length[symbols])
    at = ends - length[symbols]
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    while len(symbols):
        plain = symbols < first
        out[at[plain]] = symbols[plain]
        at, symbols = at[~plain], symbols[~plain]
        left, right = (rules[symbols - first, k] for k in (0, 1))
        at, symbols = np.concatenate([at, at + length[left]]), np.concatenate([left, right])
    return out


def _packed(values: np.ndarray) -> bytes:
    """A packed column: the width of a value, then all values in that many bits."""
    values = values.astype("<u8")
    width = int(values.max(initial=0)).bit_length()
    kind = np.dtype("<u4" if width <= 32 else "<u8")
    bits = np.unpackbits(values.astype(kind).view("u1").reshape(len(values), kind.itemsize),
                         axis=1, count=width, bitorder="little")
    return bytes([width]) + np.packbits(bits, bitorder="little").tobytes()


def _short(values: np.ndarray) -> bytes:
    """A short column: a byte for each value, then those that do not fit, packed."""
    return np.minimum(values, 255).astype("u1").tobytes() + _packed(values[values >= 255])


def _steps(values: np.ndarray, kind: str) -> np.ndarray:
    return np.diff(values.astype(kind), prepend=np.zeros(1, kind))


class _Packed:
    """Any run of values of a packed column, unpacked from their own bytes."""

    def __init__(self, raw: bytes, at: int, count: int):
        self.raw, self.at, self.width, self.count = raw, at + 1, raw[at], count
        self.end = self.at + (count * self.width + 7) // 8

    def run(self, a: int, b: int) -> np.ndarray:
        kind = "<u4" if self.width <= 32 else "<u8"
        if a >= b or not self.width:
            return np.zeros(max(0, b - a), kind)
        bit, stop = a * self.width, b * self.width
        some = np.frombuffer(self.raw, "u1", (stop + 7) // 8 - bit // 8, self.at + bit // 8)
        bits = np.unpackbits(some, bitorder="little")[bit % 8:][:stop - bit]
        whole = np.zeros((b - a, 8 * np.dtype(kind).itemsize), "u1")
        whole[:, :self.width] = bits.reshape(b - a, self.width)
        return np.packbits(whole, axis=1, bitorder="little").view(kind).ravel()

    def all(self) -> np.ndarray:
        return self.run(0, self.count)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], end_id: int, first: int) -> bytes:
    """The bytes of a shard; ``ids`` of each document close with the end id."""
    whole = np.concatenate(ids)
    symbols, rules = compress(whole, end_id, first)
    # A document's last symbol is the end symbol that stands for its own last id.
    lengths = np.concatenate([np.ones(first, np.int64), rules[:, 2].astype(np.int64)])[symbols]
    sizes = np.array([len(x) for x in ids], np.int64)
    last = np.searchsorted(np.cumsum(lengths), np.cumsum(sizes)) + 1
    used = np.flatnonzero(np.bincount(whole, minlength=first))
    dense = np.zeros(first + len(rules), np.uint32)
    dense[used] = np.arange(len(used))
    dense[first:] = np.arange(len(used), len(used) + len(rules))
    head = [len(ids), len(whole), len(symbols), len(rules), first, end_id, len(used)]
    return b"".join([
        MAGIC, np.array(head, "<u8").tobytes(),
        _packed(_steps(used, "<u8")),
        _packed(_steps(np.array([i or 0 for i in doc_ids], "<i8"), "<u8")),
        _packed(np.array([i is not None for i in doc_ids])),
        _packed(np.diff(last, prepend=0)), _packed(sizes),
        _short(_steps(dense[rules[:, 0]], "<u4")), _packed(dense[rules[:, 1]]), _short(rules[:, 2]),
        _packed(dense[symbols])])


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a shard")
        n, self.n_ids, m, r, self.first, self.end_id, k = np.frombuffer(raw, "<u8", 7, 8).tolist()
        at = 64

        def packed(count: int) -> _Packed:
            nonlocal at
            column = _Packed(raw, at, count)
            at = column.end
            return column

        def short(count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, "u1", count, at).astype(np.uint32)
            at += count
            long = got == 255
            got[long] = packed(int(long.sum())).all()
            return got

        used = np.cumsum(packed(k).all(), dtype=np.uint64).astype(np.uint32)
        # Symbols as ids and, from ``first`` on, rules.
        self._symbol = np.concatenate([used, np.arange(self.first, self.first + r, dtype=np.uint32)])
        ids = np.cumsum(packed(n).all(), dtype=np.uint64).astype(np.int64)
        self.doc_ids = [i if known else None for i, known in zip(ids.tolist(), packed(n).all())]
        self.ends = np.cumsum(packed(n).all().astype(np.int64))
        self.sizes = packed(n).all()
        left = np.cumsum(short(r), dtype=np.uint32)
        right = packed(r).all()
        self.rules = np.stack([self._symbol[left], self._symbol[right], short(r)], axis=1)
        self._symbols = packed(m)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """All ids of document ``i``, by its own symbols and the rules."""
        return self.run(i, i + 1)

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids of documents ``a`` to ``b - 1``, one after another."""
        start = int(self.ends[a - 1]) if a else 0
        symbols = self._symbols.run(start, int(self.ends[b - 1]))
        return expand(self._symbol[symbols], self.rules, self.first)


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID,
          shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards below ``folder`` (any place that all executors reach); one row per shard.

    ``shard, part, number, n_docs, n_ids`` come back lazily, so write them to a table once. A task
    that runs again writes files of new names; only those of the rows that were kept are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        own, part = encoder(path), TaskContext.get().partitionId()
        first = own.library.get_vocab_size()
        number, doc_ids, ids, held = 0, [], [], 0

        def done() -> pa.RecordBatch:
            name = f"{part:06d}-{number:05d}-{uuid.uuid4().hex}.rpair"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pack(doc_ids, ids, end_id, first))
            return pa.RecordBatch.from_pydict({
                "shard": [name], "part": pa.array([part], pa.int32()),
                "number": pa.array([number], pa.int32()), "n_docs": [len(ids)], "n_ids": [held]})

        store.create_dir(base, recursive=True)
        end = np.array([end_id], own.dtype)
        for batch in batches:
            for doc_id, got in zip(batch.column("doc_id").to_pylist(),
                                   own.encode_all(batch.column("text"))):
                got = np.concatenate([got, end])
                doc_ids.append(doc_id)
                ids.append(got)
                held += len(got)
                if held >= shard_ids:
                    yield done()
                    number, doc_ids, ids, held = number + 1, [], [], 0
        if ids:
            yield done()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "shard string, part int, number int, n_docs long, n_ids long")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all shards before. Parts are summed first."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("number").rowsBetween(
        W.unboundedPreceding, 0)) - F.col("n_ids")
    return shards.withColumn("inside", inside).join(parts, "part").select(
        *shards.columns, (F.col("base") + F.col("inside")).alias("start"))


def read(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (u32 little-endian, with the end id) of the shards' documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("shard").to_pylist(),
                                   batch.column("start").to_pylist()):
                with store.open_input_file(f"{base}/{name}") as f:
                    shard = Shard(f.read())
                starts = start + np.cumsum(shard.sizes.astype(np.int64)) - shard.sizes
                for at in range(0, len(shard), 256):
                    to = min(at + 256, len(shard))
                    whole = shard.run(at, to).astype("<u4").tobytes()
                    ends = (4 * np.cumsum(shard.sizes[at:to].astype(np.int64))).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[at:to], pa.int64()), pa.array(starts[at:to]),
                         pa.array(shard.sizes[at:to].astype(np.int64)),
                         pa.array([whole[a:b] for a, b in zip([0, *ends], ends)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    return shards.select("shard", "start").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents, read the files back, and give what they hold."""
    from leadloom.llm.common import staged

    folder = session.fresh_path(docs.sparkSession, "shards")
    shards = staged(write(docs, path, folder), "shard-list")
    # A number of its own: the few bytes of the list would be coalesced into one reading task.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = with_starts(shards).repartition(parts, "shard")
    return read(listed, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
