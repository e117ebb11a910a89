"""Frequent prefixes of lines, with little to shuffle.

A phrase is as frequent as the cutoff asks only if every word of it is, and every pair of neighbours.  So words and pairs
are counted first, by hashes of ``KEY_BITS``, and the frequent ones set bits of a filter of ``FILTER_BITS``, whatever the
corpus.  A bit that several hashes share lets through what is rare; it never holds back what is frequent.  Chains are then
cut before the first word that the filter does not let through, added up where they are read, and shuffled as compressed
packs; their exact counts decide.  They can be shuffled in several rounds, each with the chains of a range of first words,
so that the files of one are gone when the next one's are written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import text as T

#: Bits of the hash of a word or a pair, and of the filter: 32 MB.
KEY_BITS, FILTER_BITS = 36, 28
#: What is left of chains takes a fraction of their place, so a partition gets those of several.
FEWER = 4
#: Words whose keys are added up at once, chains that are, and bytes of lines whose arrays are held at once.
KEYS_AT_ONCE, CHAINS_AT_ONCE, BYTES_AT_ONCE = 1 << 21, 1 << 20, 1 << 20

_CODEC = "zstd"
_BASE, _LEFT, _RIGHT, _WORD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


#: What normalisation makes of a byte: itself, a blank, nothing (apostrophes), or an end of a line.
_DROPPED, _ENDED, _NUL = 1, 2, 0
_NORMAL = np.full(256, 0x20, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _NORMAL[_c] = _NORMAL[ord(chr(_c).upper())] = _c
# 255 is in no text.
_NORMAL[[ord("'"), 0, 255]] = _DROPPED, _NUL, _ENDED


def normalized(data: np.ndarray, line_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lines as ``text.normalize`` has them, one line after the other, and the line of each byte."""
    x = _NORMAL.take(np.insert(data, line_ends, 255))
    ended = x == _ENDED
    line = np.cumsum(ended, dtype=np.int32)
    line -= ended
    if (x == _NUL).any():
        # A NUL ends the line: the next NUL or end after each byte, and the last end before it.
        nuls = np.cumsum(x == _NUL)
        before = np.concatenate(([0], nuls[x == _ENDED]))[line]
        x, line = x[(nuls == before) | (x == _ENDED)], line[(nuls == before) | (x == _ENDED)]
    at = np.flatnonzero(x != _DROPPED)
    x = x.take(at)
    x[x == _ENDED] = 0x20
    # Of several blanks the first stays, and none at the beginning.
    letter = x != 0x20
    stays = letter.copy()
    stays[1:] |= letter[:-1]
    some = np.flatnonzero(stays)
    return x.take(some), line.take(at.take(some))


#: Powers of _BASE and of its inverse, for places as ``_POWERS * high + low``.
_POWERS = 1024


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_UP = _powers(int(_BASE), _POWERS + 1)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), _POWERS + 1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of texts d: the sum of (d[k] + 1) * _BASE ** (length - k), as a difference of sums over all bytes before."""
    rows = -(-len(data) // _POWERS)
    terms = np.zeros(rows * _POWERS + 1, dtype=np.uint64)
    terms[1 : len(data) + 1] = data
    terms += np.uint64(1)
    terms[0] = 0
    own = terms[1:].reshape(rows, _POWERS)
    own *= _DOWN[:-1]
    own *= _powers(int(_DOWN[-1]), rows)[:, None]
    sums = np.cumsum(terms, out=terms)
    high = _powers(int(_UP[-1]), rows + 1)
    return (sums[ends] - sums[starts]) * _UP[ends % _POWERS] * high[ends // _POWERS]


class Range(NamedTuple):
    """Chains of first words whose first eight bytes are the numbers from ``low`` to ``high``, parted at the texts ``cuts``."""

    low: int
    high: int
    cuts: list[bytes]


def _first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of texts, those after an end as 0, as numbers in the order of the texts."""
    data = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))[starts].astype(np.uint64)
    over = np.uint64(64) - np.uint64(8) * np.clip(ends - starts, 1, 8).astype(np.uint64)
    return eight >> over << over


class Words:
    """The words of lines, as arrays over the places where their first chain with a whole word begins."""

    def __init__(self, data: np.ndarray, line_ends: np.ndarray, weights: np.ndarray):
        data, line_of = normalized(data, line_ends)
        self.data, ends = data, np.flatnonzero(data == 0x20)
        line = line_of[ends]
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        # A word of WINDOW or more characters starts anew after every WINDOW of them; only the last start has a whole word.
        starts = starts + (ends - starts) // T.WINDOW * T.WINDOW
        self.starts, self.ends, self.n = starts, ends, weights[line]
        self.whole = ends > starts
        self.paired = np.zeros(len(ends), dtype=bool)
        self.paired[:-1] = self.whole[:-1] & (line[1:] == line[:-1]) & (ends[1:] - starts[:-1] < T.WINDOW)
        h = _hashes(data, starts, ends) if len(ends) else np.zeros(0, dtype=np.uint64)
        self.words = _mixed(h * _WORD) >> np.uint64(64 - KEY_BITS)
        self.pairs = np.zeros(len(ends), dtype=np.uint64)
        self.pairs[:-1] = _mixed(h[:-1] * _LEFT + h[1:] * _RIGHT) >> np.uint64(64 - KEY_BITS)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all words and pairs, and their weights."""
        return np.concatenate((self.words[self.whole], self.pairs[self.paired])), np.concatenate((self.n[self.whole], self.n[self.paired]))

    def chains(self, bits: np.ndarray, within: Range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of WINDOW bytes (0 after the text), the hashes of their first words and their weights: what may be frequent."""
        count = len(self.ends)
        follows = np.zeros(count, dtype=bool)
        follows[self.paired] = _has(bits, self.pairs[self.paired])
        stops = np.flatnonzero(~follows)
        at = np.flatnonzero(self.whole)
        if within is not None:
            firsts = _first_bytes(self.data, self.starts[at], self.ends[at])
            at = at[(firsts >= np.uint64(within.low)) & (firsts <= np.uint64(within.high))]
        at = at[_has(bits, self.words[at])]
        # The last word: where a pair is rare, or where the window ends.
        last = np.minimum(stops[np.searchsorted(stops, at)], np.searchsorted(self.ends, self.starts[at] + T.WINDOW - 1, side="right") - 1)
        sizes = self.ends[last] + 1 - self.starts[at]
        rows = np.zeros((len(at), T.WINDOW), dtype=np.uint8)
        for k in range(T.WINDOW):
            some = np.flatnonzero(sizes > k)
            rows[some, k] = self.data[self.starts[at[some]] + k]
        return rows, np.where(last > at, self.pairs[at], self.words[at]), self.n[at]


#: For the hashes of the first word, pair and triple of a chain.
_FACTORS = (_WORD, _LEFT, _RIGHT)


class Counted:
    """The first words, pairs and triples of counted chains of up to WINDOW characters: their other pairs are not known to be chains too."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray):
        if len(starts) and ((ends - starts).max() > T.WINDOW or not data.all()):
            raise ValueError(f"chains must have at most {T.WINDOW} characters, and no NUL")
        blanks = np.concatenate((np.flatnonzero(data == 0x20), [len(data)] * len(_FACTORS)))
        at = np.searchsorted(blanks, starts)
        self.data, self.starts, self.n = data, starts, n
        self.stops = [blanks[at + k] for k in range(len(_FACTORS))]
        self.there = [x < ends for x in self.stops]
        self.hashes = [_mixed(_hashes(data, starts, np.minimum(x, ends)) * factor) >> np.uint64(64 - KEY_BITS) for x, factor in zip(self.stops, _FACTORS, strict=True)]
        self.last = blanks[np.searchsorted(blanks, ends) - 1]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(self.n, 0)  # what is taken away holds nothing back
        return np.concatenate([h[x] for h, x in zip(self.hashes, self.there, strict=True)]), np.concatenate([n[x] for x in self.there])

    def chains(self, bits: np.ndarray, within: Range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Words.chains``: chains are cut to what is frequent of their first words, others to whole words."""
        word, pair, triple = self.there[0].copy(), self.there[1].copy(), self.there[2].copy()
        word[word] = _has(bits, self.hashes[0][word])
        pair &= word
        pair[pair] = _has(bits, self.hashes[1][pair])
        triple &= pair
        triple[triple] = _has(bits, self.hashes[2][triple])
        at = np.flatnonzero(word)
        to = np.where(triple, self.last, np.where(pair, self.stops[1], self.stops[0]))[at]
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.data, np.zeros(T.WINDOW, dtype=np.uint8))), T.WINDOW)[self.starts[at]]
        rows = np.where(np.arange(T.WINDOW) < (to + 1 - self.starts[at])[:, None], rows, 0).astype(np.uint8)
        return rows, np.where(pair, self.hashes[1], self.hashes[0])[at], self.n[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[Counted]:
    """The counted chains of batches (line, n)."""
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if len(texts) and offsets[-1] > offsets[0]:
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            yield Counted(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], batch.column(1).fill_null(0).to_numpy())


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(KEY_BITS - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of batches (line, n), some lines at a time."""
    for batch in batches:
        lines, weights = batch.column(0).cast(pa.large_binary()), batch.column(1).fill_null(0).to_numpy()
        offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
        if offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(lines.buffers()[2], dtype=np.uint8)
        at = 0
        while at < len(lines):
            to = max(int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1, at + 1)
            yield Words(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], weights[at:to])
            at = to


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of ``n``."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers with all their first bytes first: small ones are mostly zeros, which compress."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, count: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, count).T).view("<i8")[:, 0]


def _packed(part: list[int], count: list[int], raw: list[bytes]) -> pa.RecordBatch:
    codec = pa.Codec(_CODEC, compression_level=3)
    packs = [codec.compress(x, asbytes=True) for x in raw]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(count, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(packs, pa.binary())], names=_PACK_NAMES)


_PACK_NAMES = ["part", "count", "size", "pack"]
_PACK = "part int, count long, size long, pack binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    codec = pa.Codec(_CODEC)
    for batch in batches:
        for part, count, size, pack in zip(*(batch.column(i) for i in range(4)), strict=True):
            yield part.as_py(), count.as_py(), codec.decompress(pack.as_buffer(), size.as_py(), asbytes=True)


def _key_packs(batches: Iterator[pa.RecordBatch], parts: int, read: Callable = _words) -> Iterator[pa.RecordBatch]:
    """Packs of the keys of every part, a range of keys, with the sums of their weights."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def packs() -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()  # what was put together is not kept twice while it is sorted
        keys, n = _added(keys, n)
        cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(KEY_BITS - (parts.bit_length() - 1)))
        some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        own = [slice(cuts[p], cuts[p + 1]) for p in some]
        return _packed(some, [s.stop - s.start for s in own], [_planes(np.diff(keys[s], prepend=np.uint64(0))) + _planes(n[s]) for s in own])

    for words in read(batches):
        held.append(words.keys())
        if sum(len(k) for k, _ in held) >= KEYS_AT_ONCE:
            yield packs()
            held = []
    if held:
        yield packs()


def _bit_slices(batches: Iterator[pa.RecordBatch], cutoff: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The bits of the frequent keys, a slice of the filter for every part."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def met(part: int) -> None:
        own = waiting.pop(part) + ([sums[part]] if part in sums else [])
        sums[part] = _added(*(np.concatenate(x) for x in zip(*own, strict=True)))

    for part, count, raw in _unpacked(batches):
        keys = np.cumsum(_numbers(raw[: 8 * count], count)).astype(np.uint64)
        waiting.setdefault(part, []).append((keys, _numbers(raw[8 * count :], count)))
        if sum(len(k) for k, _ in waiting[part]) >= KEYS_AT_ONCE:
            met(part)
    for part in list(waiting):
        met(part)
    width = (1 << FILTER_BITS) // parts
    for part, (keys, n) in sums.items():
        at = np.unique((keys[n >= cutoff] >> np.uint64(KEY_BITS - FILTER_BITS)).astype(np.int64) - part * width)
        bits = np.zeros(width, dtype=np.uint8)
        bits[at] = 1
        yield _packed([part], [width // 8], [np.packbits(bits, bitorder="little").tobytes()])


def _all_bits(slices: list) -> np.ndarray:
    bits, codec = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8), pa.Codec(_CODEC)
    for part, width, pack in slices:
        bits[part * width : (part + 1) * width] = np.frombuffer(codec.decompress(pack, width, asbytes=True), dtype=np.uint8)
    return bits


def _first_words(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted chains: those of more than one word, as places, and the rows and weights of the first words of all."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64), rows, n
    end, sizes = np.argmax(rows == 0x20, axis=1), (rows != 0).sum(axis=1)
    words = np.where(np.arange(rows.shape[1]) <= end[:, None], rows, 0).astype(np.uint8)
    first = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]).any(axis=1))))
    return np.flatnonzero(sizes > end + 1), words[first], np.add.reduceat(n, first)


def _chain_packs(batches: Iterator[pa.RecordBatch], slices: list, parts: int, within: Range | None = None, read: Callable = _words) -> Iterator[pa.RecordBatch]:
    """Packs of the chains that may be frequent, cut and added up, by the hash of their first words.

    Those ``within`` a range are parted by its cuts; packs of the parts from ``parts`` on have the counts of first words,
    each in the part where it lies itself, as its chains may lie in several.
    """
    bits = _all_bits(slices)
    cuts = None if within is None else np.array(within.cuts, dtype=f"S{T.WINDOW}")
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pack(rows: np.ndarray, n: np.ndarray, at: np.ndarray, base: int) -> pa.RecordBatch:
        some = [p for p in range(len(at) - 1) if at[p] < at[p + 1]]
        sizes = (rows != 0).sum(axis=1).astype(np.uint8)
        raw = [b"".join((sizes[s].tobytes(), _planes(n[s]), rows[s][rows[s] != 0].tobytes())) for s in (slice(at[p], at[p + 1]) for p in some)]
        return _packed([base + p for p in some], [int(at[p + 1] - at[p]) for p in some], raw)

    def parted(rows: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.searchsorted(rows.view(f"S{T.WINDOW}")[:, 0], cuts), [len(rows)]))

    def packs() -> Iterator[pa.RecordBatch]:
        rows, part, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # Sorted as numbers of eight bytes, the first ones first.
        order = np.lexsort((*rows.view(">u8").astype(np.uint64).T[::-1], part))
        rows, part, n = rows[order], part[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (rows[1:] != rows[:-1]).any(axis=1))))
        n, rows, part = np.add.reduceat(n, first), rows[first], part[first]
        if cuts is None:
            yield pack(rows, n, np.searchsorted(part, np.arange(parts + 1)), 0)
            return
        longer, words, words_n = _first_words(rows, n)
        yield pack(words, words_n, parted(words), parts)
        yield pack(rows[longer], n[longer], parted(rows[longer]), 0)

    for words in read(batches):
        rows, firsts, n = words.chains(bits, within)
        if len(rows):
            part = np.zeros(len(rows), dtype=np.int32) if within is not None else (_mixed(firsts) % np.uint64(parts)).astype(np.int32)
            held.append((rows, part, n))
        if sum(len(r) for r, _, _ in held) >= CHAINS_AT_ONCE:
            yield from packs()
            held = []
    if held:
        yield from packs()


def group_packs(held: list[tuple[np.ndarray, ...]], parts: int, names: list[str | None]) -> pa.RecordBatch:
    """A pack for each part of what is ``held``: rows of chains, their parts, weights and numbers of groups; equal ones are added up."""
    rows, part, n, codes = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((*rows.view(">u8").astype(np.uint64).T[::-1], codes, part))
    rows, part, n, codes = rows[order], part[order], n[order], codes[order]
    first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)))) if len(rows) else np.zeros(0, dtype=np.int64)
    n, rows, part, codes = np.add.reduceat(n, first) if len(first) else n, rows[first], part[first], codes[first]
    at = np.searchsorted(part, np.arange(parts + 1))
    some = [p for p in range(parts) if at[p] < at[p + 1]]
    sizes, raw = (rows != 0).sum(axis=1).astype(np.uint8), []
    for s in (slice(at[p], at[p + 1]) for p in some):
        own, number = np.unique(codes[s], return_inverse=True)
        named = json.dumps([names[c] for c in own]).encode()
        raw.append(b"".join((len(named).to_bytes(8, "little"), named, sizes[s].tobytes(), _planes(n[s]), _planes(number), rows[s][rows[s] != 0].tobytes())))
    return _packed(some, [int(at[p + 1] - at[p]) for p in some], raw)


def _group_packs(batches: Iterator[pa.RecordBatch], slices: list, parts: int) -> Iterator[pa.RecordBatch]:
    """``_chain_packs`` of lines (line, n, g), of which every chain has the group of its line and counts once."""
    bits = _all_bits(slices)
    held: list[tuple[np.ndarray, ...]] = []
    names: list[str | None] = []
    known: dict[str | None, int] = {}
    for batch in batches:
        for name in (found := batch.column(2).dictionary_encode(null_encoding="encode")).dictionary.to_pylist():
            if name not in known:
                known[name] = len(names)
                names.append(name)
        code = np.array([known[x] for x in found.dictionary.to_pylist()], dtype=np.int64)[found.indices.to_numpy(zero_copy_only=False)]
        # The number of the group goes where the weight of a line does.
        for words in _words(iter([pa.RecordBatch.from_arrays([batch.column(0), pa.array(code)], names=["line", "n"])])):
            rows, firsts, codes = words.chains(bits)
            held.append((rows, (_mixed(firsts) % np.uint64(parts)).astype(np.int32), np.ones(len(rows), dtype=np.int64), codes))
            if sum(len(x[0]) for x in held) >= CHAINS_AT_ONCE:
                yield group_packs(held, parts, names)
    if held:
        yield group_packs(held, parts, names)


def group_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, t and n of ``group_packs``."""
    for _, count, raw in _unpacked(batches):
        named = 8 + int.from_bytes(raw[:8], "little")
        names, raw = pa.array(json.loads(raw[8:named]), pa.string()), raw[named:]
        sizes, n, number, flat = raw[:count], _numbers(raw[count : 9 * count], count), _numbers(raw[9 * count : 17 * count], count), raw[17 * count :]
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, dtype=np.uint8), dtype=np.int32))).astype(np.int32)
        texts = pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), texts, pa.array(n)], names=["g", "t", "n"])


def _chain_texts(batches: Iterator[pa.RecordBatch], parts: int | None = None) -> Iterator[pa.RecordBatch]:
    """t and n of packed chains, and g before them where ``parts`` is given: "w" for the counts of first words, "" for chains."""
    for part, count, raw in _unpacked(batches):
        sizes, n, flat = raw[:count], _numbers(raw[count : 9 * count], count), raw[9 * count :]
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, dtype=np.uint8), dtype=np.int32))).astype(np.int32)
        columns = {"t": pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(ends), pa.py_buffer(flat)]), "n": pa.array(n)}
        if parts is not None:
            columns = {"g": pa.repeat("w" if part >= parts else "", count)} | columns
        yield pa.RecordBatch.from_pydict(columns)


#: Lines that place the ranges of chains, and how many characters of a line.
RANGE_LINES, RANGE_LINE_CHARS = 2000, 400


def _ranges(drawn: list, slices: list, rounds: int, parts: int) -> list[Range]:
    """All chains in ``rounds`` ranges or fewer, each parted in ``parts`` or fewer, of about the same size by drawn lines.

    A range has all chains of its first words, a part all those of its first two words.
    """
    whole = (1 << 64) - 1
    lines = pa.RecordBatch.from_arrays([pa.array([r.line for r in drawn], pa.string()), pa.array([1] * len(drawn), pa.int64())], names=["line", "n"])
    bits = _all_bits(slices)
    found = [words.chains(bits)[0] for words in _words(iter([lines]))]
    rows = np.unique(np.concatenate(found).view(f"S{T.WINDOW}")[:, 0]) if found else np.zeros(0, dtype=f"S{T.WINDOW}")
    # Where every line was drawn one round does.
    rounds = rounds if len(drawn) == RANGE_LINES else 1
    firsts = np.array([int.from_bytes(x.split(b" ", 1)[0][:8].ljust(8, b"\0"), "big") for x in rows.tolist()], dtype=np.uint64)
    lows = sorted({0} | {int(firsts[len(firsts) * i // rounds]) for i in range(1, rounds) if len(firsts)})
    out = []
    for low, high in zip(lows, [x - 1 for x in lows[1:]] + [whole], strict=True):
        own = rows[(firsts >= np.uint64(low)) & (firsts <= np.uint64(high))].tolist()
        cuts = {b"".join(x + b" " for x in own[len(own) * i // parts].split(b" ")[:-1][:2]) for i in range(1, parts) if own}
        out.append(Range(low, high, sorted(cuts)))
    return out


class Frequent:
    """What may be frequent in lines: words and pairs of words, counted when this is made.

    With ``chained`` the lines are chains already, with their counts as weights, and have ``chains`` only.
    """

    def __init__(self, lines: DataFrame, cutoff: int, line_col: str = "line", weight: Column | None = None, chained: bool = False):
        spark = lines.sparkSession
        session.attach(spark)
        self.rows = lines.select(F.coalesce(F.col(line_col), F.lit("")).alias("line"), (F.lit(1) if weight is None else weight).cast("long").alias("n"))
        parts = session.parts(self.rows)
        self.parts = max(parts // FEWER, min(parts, spark.sparkContext.defaultParallelism))
        ranges = 1 << (self.parts - 1).bit_length()
        self.read = read = _counted if chained else _words
        keys = self.rows.mapInArrow(lambda b: _key_packs(b, ranges, read), _PACK).repartitionById(ranges, "part")
        with session.shuffles_dropped(spark):
            self.slices = [(r.part, r["count"], bytes(r.pack)) for r in keys.mapInArrow(lambda b: _bit_slices(b, cutoff, ranges), _PACK).collect()]
        self.sent = spark.sparkContext.broadcast(self.slices)

    def chains(self) -> DataFrame:
        """t and n; all rows of a chain's first two words, or of its one word, are in one partition."""
        sent, parts, read = self.sent, self.parts, self.read
        packs = self.rows.mapInArrow(lambda b: _chain_packs(b, sent.value, parts, None, read), _PACK).repartitionById(parts, "part")
        return packs.mapInArrow(_chain_texts, "t string, n long")

    def group_chains(self, lines: DataFrame, line_col: str, group_col: str) -> DataFrame:
        """g, t and n: ``chains`` of the same lines, without weights, by their group; frequent is what is so in all groups together."""
        sent, parts = self.sent, self.parts
        rows = lines.select(F.coalesce(F.col(line_col), F.lit("")).alias("line"), F.lit(1).cast("long").alias("n"), F.col(group_col).cast("string").alias("g"))
        packs = rows.mapInArrow(lambda b: _group_packs(b, sent.value, parts), _PACK).repartitionById(parts, "part")
        return packs.mapInArrow(group_texts, "g string, t string, n long")

    def ranges(self, rounds: int) -> list[DataFrame]:
        """g, t and n: of ranges of texts, in order, chains of two words or more (g is "") and counts of first words ("w").

        The partitions of each are ranges too, in which all chains of the same first two words are.
        """
        drawn = self.rows.select(F.substring("line", 1, RANGE_LINE_CHARS).alias("line")).orderBy(F.rand(1)).limit(RANGE_LINES).collect()
        return [self._range(x) for x in _ranges(drawn, self.slices, rounds, self.parts)]

    def _range(self, within: Range) -> DataFrame:
        sent, parts = self.sent, self.parts
        packs = self.rows.mapInArrow(lambda b: _chain_packs(b, sent.value, parts, within), _PACK).repartitionById(parts, F.col("part") % parts)
        return packs.mapInArrow(lambda b: _chain_texts(b, parts), "g string, t string, n long")


def frequent_chains(lines: DataFrame, cutoff: int, line_col: str = "line", weight: Column | None = None) -> DataFrame:
    """t and n of the chains of lines that can have a prefix of ``cutoff`` or more, cut to it.

    Every prefix of that count has its count among them; rarer ones may have less or be missing.  Weights must not be below 0.
    """
    return Frequent(lines, cutoff, line_col, weight).chains()
