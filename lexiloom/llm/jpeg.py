"""Progressive JPEG in numpy: many images at once, a restart segment per lane.

Decoding accumulates the scans of a file - bands of coefficients (spectral selection), their high bits first and one
more bit in each refinement (successive approximation) - into coefficient arrays.  The segments between restart
markers decode in lock step, over all images of a batch.  Then comes the inverse transform as one product with an
integer basis, exact in double precision so that equal images give equal pixels in any batch, the upsampling of the
chroma planes and the conversion to RGB.

Encoding writes given coefficients in the scan order of ``SCRIPT``.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

RESTART = 8  # blocks or units between restart markers
#: components, first and last coefficient, high bit position before and after
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    *[((c,), low, high, 0, 1) for c in (1, 2) for low, high in ((1, 5), (6, 63))],
    ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    *[((c,), 1, 63, 1, 0) for c in (0, 1, 2)],
]
U8 = np.uint64(8)


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


@lru_cache(maxsize=1)
def basis() -> np.ndarray:
    """Zigzag coefficients to row-major samples, in units of 2 ** -16."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.kron(one, one)[zigzag()] * 65536)


class Huffman:
    """A canonical code: by symbol for encoding, by the next 16 bits for decoding."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols = counts, symbols
        self.code, self.length = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
        self.peek = np.zeros(1 << 16, dtype=np.int64)  # symbol * 32 + length; length 0: no code
        self._whole: np.ndarray | None = None
        code, at = 0, 0
        for n, times in enumerate(counts, 1):
            for s in symbols[at : at + times]:
                self.code[s], self.length[s] = code, n
                self.peek[code << (16 - n) : (code + 1) << (16 - n)] = s * 32 + n
                code += 1
            at += times
            code <<= 1

    @classmethod
    def of(cls, weights: dict[int, float]) -> Huffman:
        """The code for symbol weights, at most 16 bits long, the code of all ones left free."""
        import heapq

        least = sum(weights.values()) / 4000  # keeps every code under 16 bits
        heap = [(max(w, least), i, [s]) for i, (s, w) in enumerate([*sorted(weights.items()), (-1, 0.0)])]
        length = dict.fromkeys([*weights, -1], 0)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                length[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        # The free code must be the last of the longest.
        longest = max(length.values())
        spare = next(s for s in length if length[s] == longest)
        length[-1], length[spare] = longest, length[-1]
        order = sorted((n, s) for s, n in length.items() if s >= 0)
        assert longest <= 16
        return cls([sum(n == i for n, _ in order) for i in range(1, 17)], [s for _, s in order])

    def whole(self) -> np.ndarray:
        """By the next 16 bits, a coefficient that lies in them with its code: (value + 32768) * 65536 + zeros before it * 256 + bits; else 0."""
        if self._whole is None:
            bits = np.arange(1 << 16)
            n, r, s = self.peek & 31, self.peek >> 9, self.peek >> 5 & 15
            fits = (n > 0) & (s > 0) & (n + s <= 16)
            value = extend((bits >> np.where(fits, 16 - n - s, 0)) & ((1 << s) - 1), s)
            self._whole = np.where(fits, (value + 32768) << 16 | r << 8 | n + s, 0)
        return self._whole

    def segment(self, kind: int, slot: int) -> bytes:
        body = bytes([kind << 4 | slot, *self.counts, *self.symbols])
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(maxsize=1)
def own_codes() -> tuple[Huffman, Huffman, Huffman]:
    """Codes for first DC bits, first AC bits and AC refinement."""
    dc = {s: 1.0 for s in range(12)}
    sizes = [0, 1, 1, 4, 8, 40, 80, 12, 2, 1, 1]  # text bytes lie 6 to 96 below 128
    ac = {r << 4 | s: sizes[s] * 2.0 ** (-4 * min(r, 3)) / (1 + r) for r in range(16) for s in range(1, 11)} | {0x00: 0.5, 0xF0: 0.01}
    ac |= {r << 4: 0.01 for r in range(1, 15)}
    more = {0x00: 20.0, 0xF0: 0.01} | {r << 4 | 1: 4.0 / (1 + r) for r in range(16)} | {r << 4: 0.01 for r in range(1, 15)}
    return Huffman.of(dc), Huffman.of(ac), Huffman.of(more)


@dataclass(frozen=True)
class Geometry:
    """Where the blocks of an image are: components one after the other, each padded to whole units, by row."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    shapes: tuple[tuple[int, int], ...] = field(init=False)
    bases: tuple[int, ...] = field(init=False)
    blocks: int = field(init=False)

    def __post_init__(self) -> None:
        most_h, most_v = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        shapes = tuple((down * v, across * h) for h, v in self.sampling)
        sizes = [r * c for r, c in shapes]
        for k, v in (("shapes", shapes), ("bases", tuple(sum(sizes[:i]) for i in range(len(sizes)))), ("blocks", sum(sizes))):
            object.__setattr__(self, k, v)

    def order(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(block, component) in the order of a scan, and the blocks in a unit."""
        return _order(self, parts)


@lru_cache(maxsize=4096)
def _order(g: Geometry, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    most_h, most_v = max(h for h, _ in g.sampling), max(v for _, v in g.sampling)
    if len(parts) == 1:
        h, v = g.sampling[parts[0]]
        rows, cols = -(-(-(-g.height * v // most_v)) // 8), -(-(-(-g.width * h // most_h)) // 8)
        at = g.bases[parts[0]] + np.arange(rows)[:, None] * g.shapes[parts[0]][1] + np.arange(cols)
        return at.ravel(), np.full(at.size, parts[0]), 1
    across, down = -(-g.width // (8 * most_h)), -(-g.height // (8 * most_v))
    some, which = [], []
    for p in parts:
        h, v = g.sampling[p]
        r = np.arange(down)[:, None, None, None] * v + np.arange(v)[None, None, :, None]
        c = np.arange(across)[None, :, None, None] * h + np.arange(h)[None, None, None, :]
        some.append((g.bases[p] + r * g.shapes[p][1] + c).reshape(down * across, v * h))
        which.append(np.full((down * across, v * h), p))
    at = np.concatenate(some, axis=1)
    return at.ravel(), np.concatenate(which, axis=1).ravel(), at.shape[1]


def segments_of(orders: list[tuple[np.ndarray, np.ndarray, int]], restarts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry, entries, image) of every restart segment of a scan over several images."""
    n = np.array([len(blocks) for blocks, _, _ in orders], dtype=np.int64)
    step = np.array([restart * unit for restart, (_, _, unit) in zip(restarts, orders, strict=True)], dtype=np.int64)
    step = np.where(step > 0, step, np.maximum(n, 1))
    times = -(-n // step)
    image = np.repeat(np.arange(len(n)), times)
    inside = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * step[image]
    return inside + (np.cumsum(n) - n)[image], np.minimum(step[image], n[image] - inside), image


_BITS = np.ceil(np.log2(np.arange(1 << 16) + 1.0)).astype(np.int64)


def bits_of(v: np.ndarray) -> np.ndarray:
    """Bits in the magnitude of integers of up to 16 bits."""
    return _BITS[np.abs(v)]


def pack(value: np.ndarray, n: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each filled up with ones, and the number of bytes of each."""
    bits = np.bincount(segment, weights=n, minlength=segments).astype(np.int64)
    size = -(-bits // 8)
    start = (np.cumsum(size) - size) * 8
    total = np.cumsum(n)
    before = np.cumsum(bits) - bits
    at = total - n - before[segment] + start[segment]
    x = value << (np.uint64(64) - (at & 31).astype(np.uint64) - n.astype(np.uint64))
    word = at >> 5
    out = np.zeros(int(size.sum() // 4 + 3), dtype=np.uint64)
    if len(word):
        head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[head]] += np.add.reduceat(x >> np.uint64(32), head)
        out[word[head] + 1] += np.add.reduceat(x & np.uint64(0xFFFFFFFF), head)
    data = out.astype(">u4").view(np.uint8)[: int(size.sum())].copy()
    fill = (size * 8 - bits).astype(np.int64)
    last = (np.cumsum(size) - 1)[size > 0]
    data[last] |= ((1 << fill[size > 0]) - 1).astype(np.uint8)
    return data, size


def marked(data: np.ndarray, size: np.ndarray, image: np.ndarray, images: int) -> list[bytes]:
    """The entropy-coded data of each image: zeros after 255s, restart markers between segments."""
    times = 1 + (data == 255)
    first = np.concatenate(([True], image[1:] != image[:-1]))
    number = np.arange(len(image)) - np.maximum.accumulate(np.where(first, np.arange(len(image)), 0))
    more = np.concatenate((image[1:] == image[:-1], [False]))  # a marker follows
    gap = np.cumsum(2 * more) - 2 * more
    ends = np.cumsum(size)
    place = np.cumsum(times) - times + np.repeat(gap, size)
    total = np.concatenate(([0], np.cumsum(times)))
    out = np.zeros(int(total[-1] + 2 * more.sum()), dtype=np.uint8)
    out[place] = data
    after = total[ends] + gap
    out[after[more]] = 255
    out[after[more] + 1] = 0xD0 + number[more] % 8
    raw = out.tobytes()
    stop = (after + 2 * more)[np.concatenate((image[1:] != image[:-1], [True]))].tolist()
    return [raw[a:b] for a, b in zip([0, *stop], stop, strict=False)]


def woven(key: np.ndarray, items: tuple[np.ndarray, ...], more_key: np.ndarray, more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(keys, items) of two lists of items by key, the first sorted by key and the second short."""
    if not len(more_key):
        return key, *items
    order = np.argsort(more_key, kind="stable")
    at = np.searchsorted(key, more_key[order])
    return np.insert(key, at, more_key[order]), *(np.insert(a, at, b[order]) for a, b in zip(items, more, strict=True))


def _ac_first_sparse(v: np.ndarray, low: int, high: int, code: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items (value, bits, row) of the blocks' first bits ``v`` of a band, zeros among them."""
    row, k = np.nonzero(v)
    x = v[row, k]
    new = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    gap = k - np.concatenate(([0], k[:-1] + 1))[: len(k)]
    gap[new] = k[new]
    size = bits_of(x)
    extra = np.where(x < 0, x + (1 << size) - 1, x).astype(np.uint64)
    sym = (gap & 15) << 4 | size
    longs = gap >> 4
    last = np.full(len(v), -1)
    last[row] = k
    short = np.flatnonzero(last < high - low)
    # Order: by block and place; runs of 16 zeros come before their coefficient, the end of block last.
    many = int(longs.sum())
    value = (code.code[sym] << size.astype(np.uint64)) | extra
    more = np.concatenate((np.full(many, code.code[0xF0]), np.full(len(short), code.code[0]))), np.concatenate((np.full(many, code.length[0xF0]), np.full(len(short), code.length[0])))
    key, value, n = woven(row * 256 + k * 2 + 1, (value, code.length[sym] + size), np.concatenate((np.repeat(row * 256 + k * 2, longs), short * 256 + 255)), more)
    return value, n, key >> 8


def _in_order(full: np.ndarray, rows: int, dense: tuple[np.ndarray, np.ndarray], sparse: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items (value, bits, row) of all blocks from those of the ``full`` ones, by block, and those of the others."""
    row = np.repeat(np.flatnonzero(full), dense[0].shape[1])
    if len(sparse[2]) == 0:
        return dense[0].ravel(), dense[1].ravel(), row
    others = np.flatnonzero(~full)
    more = others[sparse[2]]
    # Both are sorted by block and share none.
    times = np.bincount(more, minlength=rows)
    times[full] = dense[0].shape[1]
    start = np.cumsum(times) - times
    value, n = np.empty(int(times.sum()), dtype=np.uint64), np.empty(int(times.sum()), dtype=np.int64)
    at = start[full][:, None] + np.arange(dense[0].shape[1])
    value[at], n[at] = dense
    new = np.concatenate(([True], more[1:] != more[:-1]))
    place = np.arange(len(more))
    at = start[more] + place - np.maximum.accumulate(np.where(new, place, 0))
    value[at], n[at] = sparse[:2]
    return value, n, np.repeat(np.arange(rows), times)


def _ac_first(c: np.ndarray, low: int, high: int, bit: int, code: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items (value, bits, row) of the blocks ``c`` for the first bits of a band."""
    v = c[:, low : high + 1].astype(np.int32)
    v = np.sign(v) * (np.abs(v) >> bit)
    full = (v != 0).all(axis=1)
    x = v[full]
    size = _BITS[np.abs(x)]
    extra = np.where(x < 0, x + (1 << size) - 1, x).astype(np.uint64)
    dense = (code.code[size] << size.astype(np.uint64)) | extra, code.length[size] + size
    if full.all():
        return _in_order(full, len(v), dense, (extra[:0], size[:0], size[:0].ravel()))
    return _in_order(full, len(v), dense, _ac_first_sparse(v[~full].astype(np.int64), low, high, code))


def _ac_more_sparse(v: np.ndarray, low: int, high: int, bit: int, code: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of the blocks' values ``v`` of a band for one more bit, some of them new or zero."""
    size = np.abs(v) >> bit
    old = size > 1
    new = size == 1
    zero = ~old & ~new
    later = np.cumsum(new[:, ::-1], axis=1)[:, ::-1] > 0
    zeros = np.cumsum(zero, axis=1)
    base = np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    run = zeros - base  # zeros since the last new coefficient
    skip = zero & later & (run % 16 == 0)
    row, k = np.nonzero(new | skip)
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=bool)
    prev = np.concatenate(([-1], k[:-1])) if len(k) else k
    prev[first] = -1
    is_new = new[row, k]
    before = np.concatenate((np.zeros((len(v), 1), dtype=np.int64), zeros), axis=1)
    gap = np.where(is_new, before[row, k] - before[row, prev + 1], 15)
    sym = np.where(is_new, gap << 4 | 1, 0xF0)
    sign = (v[row, k] > 0).astype(np.uint64)
    value = np.where(is_new, (code.code[sym] << np.uint64(1)) | sign, code.code[sym])
    n = code.length[sym] + is_new
    last = np.full(len(v), -1)
    last[row] = k
    short = np.flatnonzero(last < high - low)
    o_row, o_k = np.nonzero(old)
    more_key = np.concatenate((row * 256 + prev * 2 + 3, short * 256 + last[short] * 2 + 3))
    more = np.concatenate((value, np.full(len(short), code.code[0]))), np.concatenate((n, np.full(len(short), code.length[0])))
    bits = (size[o_row, o_k] & 1).astype(np.uint64), np.ones(len(o_row), dtype=np.int64)
    key, value, n = woven(o_row * 256 + o_k * 2 + 2, bits, more_key, more)
    return value, n, key >> 8


def _ac_more(c: np.ndarray, low: int, high: int, bit: int, code: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of the blocks ``c`` for one more bit of a band."""
    v = c[:, low : high + 1].astype(np.int32)
    size = np.abs(v) >> bit
    full = (size > 1).all(axis=1)
    # Nothing new: the block's end, and then a bit of every coefficient, up to 24 of them in an item.
    bits = (size[full] & 1).astype(np.uint64)
    width, cuts = high - low + 1, range(0, high - low + 1, 24)
    value, n = np.empty((len(bits), len(cuts) + 1), dtype=np.uint64), np.empty((len(bits), len(cuts) + 1), dtype=np.int64)
    value[:, 0], n[:, 0] = code.code[0], code.length[0]
    for i, k in enumerate(cuts, 1):
        some = min(24, width - k)
        value[:, i] = bits[:, k : k + some] @ (np.uint64(1) << np.arange(some - 1, -1, -1, dtype=np.uint64))
        n[:, i] = some
    if full.all():
        return _in_order(full, len(v), (value, n), (value[:0], n[:0], n[:0].ravel()))
    return _in_order(full, len(v), (value, n), _ac_more_sparse(v[~full].astype(np.int64), low, high, bit, code))


def encode(coefs: np.ndarray, images: list[Geometry], quant: list[np.ndarray] | None = None, comments: list[bytes] | None = None, restart: int = RESTART) -> list[bytes]:
    """Files of images of three components; ``coefs`` [blocks of all images, 64] in zigzag order, as quantised."""
    bases = np.concatenate(([0], np.cumsum([g.blocks for g in images])))
    dc, ac, more = own_codes()
    tables = quant or [np.ones(64, dtype=np.int64)] * 2
    bodies: list[list[bytes]] = [[] for _ in images]
    sent: dict[bool, Huffman | None] = {False: None, True: None}
    for parts, low, high, was, bit in SCRIPT:
        orders = [g.order(parts) for g in images]
        first, size, image = segments_of(orders, [restart] * len(images))
        blocks = np.concatenate([o[0] + b for o, b in zip(orders, bases, strict=False)])
        segment = np.repeat(np.arange(len(first)), size)
        c = coefs[blocks]
        if low == 0 and was == 0:
            x = c[:, 0].astype(np.int64) >> bit
            part = np.concatenate([o[1] for o in orders])
            order = np.lexsort((np.arange(len(x)), part, segment))
            y, same = x[order], np.concatenate(([False], (segment[order][1:] == segment[order][:-1]) & (part[order][1:] == part[order][:-1])))
            diff = np.empty_like(x)
            diff[order] = y - np.where(same, np.concatenate(([0], y[:-1])), 0)
            n = bits_of(diff)
            value = (dc.code[n] << n.astype(np.uint64)) | np.where(diff < 0, diff + (1 << n) - 1, diff).astype(np.uint64)
            n, row = dc.length[n] + n, np.arange(len(x))
        elif low == 0:
            value, n, row = (c[:, 0].astype(np.int64) >> bit & 1).astype(np.uint64), np.ones(len(c), dtype=np.int64), np.arange(len(c))
        elif was == 0:
            value, n, row = _ac_first(c, low, high, bit, ac)
        else:
            value, n, row = _ac_more(c, low, high, bit, more)
        data, n_bytes = pack(value, n, segment[row], len(first))
        table = dc if not low else ac if was == 0 else more
        head = table.segment(int(low > 0), 0) if table is not sent[low > 0] else b""
        sent[low > 0] = table
        head += b"\xff\xda" + (6 + 2 * len(parts)).to_bytes(2, "big") + bytes([len(parts), *(x for p in parts for x in (p + 1, 0)), low, high, was << 4 | bit])
        for body, raw in zip(bodies, marked(data, n_bytes, image, len(images)), strict=True):
            body += [head, raw]
    out = []
    for i, g in enumerate(images):
        head = b"\xff\xd8"
        if comments:
            head += b"\xff\xfe" + (len(comments[i]) + 2).to_bytes(2, "big") + comments[i]
        head += b"".join(b"\xff\xdb\x00\x43" + bytes([k]) + t.astype(np.uint8).tobytes() for k, t in enumerate(tables))
        head += b"\xff\xc2\x00\x11\x08" + g.height.to_bytes(2, "big") + g.width.to_bytes(2, "big") + b"\x03" + bytes(x for k, (h, v) in enumerate(g.sampling) for x in (k + 1, h << 4 | v, min(k, 1)))
        head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
        out.append(head + b"".join(bodies[i]) + b"\xff\xd9")
    return out


@dataclass
class Scan:
    parts: tuple[int, ...]
    low: int
    high: int
    was: int
    bit: int
    dc: list[Huffman | None]
    ac: Huffman | None
    restart: int
    data: tuple[int, int]


@dataclass
class File:
    geometry: Geometry
    quant: list[np.ndarray]
    scans: list[Scan]
    comments: list[bytes]
    raw: np.ndarray


_codes: dict[bytes, Huffman] = {}


def _code(body: bytes) -> tuple[int, Huffman, int]:
    size = 17 + sum(body[1:17])
    key = body[1:size]
    if key not in _codes:
        if len(_codes) > 256:
            _codes.clear()
        _codes[key] = Huffman(list(body[1:17]), list(body[17:size]))
    return body[0], _codes[key], size


def parse(raw: bytes) -> File:
    """The structure of a progressive file of 8-bit samples."""
    a = np.frombuffer(raw, dtype=np.uint8)
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    ff = np.flatnonzero(a[:-1] == 255)
    after = a[ff + 1]
    real = ff[(after != 0) & (after != 255) & ((after & 0xF8) != 0xD0)].tolist()
    quant, codes, scans, comments = {}, {}, [], []
    restart, frame, ids = 0, None, []
    at = 2
    while at < len(raw):
        if raw[at] != 255:
            raise ValueError("no marker where one must be")
        kind = raw[at + 1]
        if kind == 255:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                if body[0] >> 4:
                    quant[body[0] & 15], body = np.frombuffer(body[1:129], dtype=">u2").astype(np.float64), body[129:]
                else:
                    quant[body[0]], body = np.frombuffer(body[1:65], dtype=np.uint8).astype(np.float64), body[65:]
        elif kind == 0xC4:
            while body:
                slot, code, used = _code(body)
                codes[slot], body = code, body[used:]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            comments.append(body)
        elif kind == 0xC2:
            if body[0] != 8:
                raise ValueError("samples must have 8 bits")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            ids = [p[0] for p in parts]
            frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), tuple((p[1] >> 4, p[1] & 15) for p in parts)), [p[2] for p in parts]
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman-coded file")
        elif kind == 0xDA:
            n = body[0]
            parts = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            slots = [body[2 + 2 * i] for i in range(n)]
            low, high, bits = body[1 + 2 * n : 4 + 2 * n]
            j = bisect.bisect_left(real, at)
            end = real[j] if j < len(real) else len(raw)
            scans.append(Scan(parts, low, high, bits >> 4, bits & 15, [codes.get(s >> 4) for s in slots], codes.get(16 | slots[0] & 15), restart, (at, end)))
            at = end
    if frame is None:
        raise ValueError("no frame")
    return File(Geometry(*frame[0]), [quant[q] for q in frame[1]], scans, comments, a)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as one number."""
    padded = np.concatenate((data, np.zeros(9, dtype=np.uint8))).astype(np.uint64)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    for i in range(8):
        out = (out << U8) | padded[i : i + len(out)]
    return out


def _segments(files: list[File], scans: list[Scan]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first bit of each segment, segments by file) of the i-th scan of several files, zeros after 255 removed."""
    data = np.concatenate([f.raw[s.data[0] : s.data[1]] for f, s in zip(files, scans, strict=True)])
    sizes = np.array([s.data[1] - s.data[0] for s in scans])
    ff = np.flatnonzero(data[:-1] == 255)
    marks = ff[(data[ff + 1] & 0xF8) == 0xD0]
    gone = np.zeros(len(data) + 1, dtype=bool)
    gone[ff[data[ff + 1] == 0] + 1] = True
    gone[marks] = gone[marks + 1] = True
    starts = np.sort(np.concatenate((np.cumsum(sizes) - sizes, marks + 2)))
    new = np.concatenate(([0], np.cumsum(~gone)))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return _windows(data[~gone[:-1]]), new[starts] * 8, np.bincount(owner, minlength=len(files))


class Lanes:
    """Bit positions of several segments."""

    def __init__(self, windows: np.ndarray, pos: np.ndarray):
        self.windows, self.pos = windows, pos

    def view(self) -> np.ndarray:
        """At least 57 bits from the position on, at the top."""
        return self.windows[np.minimum(self.pos >> 3, len(self.windows) - 1)] << (self.pos & 7).astype(np.uint64)

    @staticmethod
    def top(view: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (0 too) after ``skip``."""
        return (((view << skip.astype(np.uint64)) >> np.uint64(1)) >> (np.uint64(63) - n.astype(np.uint64))).astype(np.int64)


def _symbols(view: np.ndarray, code: Huffman) -> tuple[np.ndarray, np.ndarray]:
    got = code.peek[(view >> np.uint64(48)).astype(np.int64)]
    n = got & 31
    if not n.all():
        raise ValueError("broken entropy-coded data")
    return got >> 5, n


def extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _decode_dc(coefs: np.ndarray, blocks: np.ndarray, part: np.ndarray, first: np.ndarray, size: np.ndarray, lanes: Lanes, scan: Scan) -> None:
    if scan.was:
        n = np.repeat(lanes.pos - np.cumsum(size) + size, size) + np.arange(size.sum())
        bit = (lanes.windows[n >> 3] >> (np.uint64(63) - (n & 7).astype(np.uint64))).astype(np.int64) & 1
        coefs[blocks, 0] |= (bit << scan.bit).astype(coefs.dtype)
        return
    before = np.zeros((len(first), 4), dtype=np.int64)
    lane, e = np.arange(len(first)), first.copy()
    end = first + size
    where = {p: i for i, p in enumerate(scan.parts)}
    tables = np.stack([scan.dc[where[p]].peek if p in where else np.zeros(1 << 16, dtype=np.int64) for p in range(max(scan.parts) + 1)])
    while len(lane):
        p = part[e]
        view = lanes.view()
        got = tables[p, (view >> np.uint64(48)).astype(np.int64)]
        n, s = got & 31, got >> 5
        if not n.all():
            raise ValueError("broken entropy-coded data")
        before[lane, p] += extend(lanes.top(view, n, s), s)
        coefs[blocks[e], 0] = before[lane, p] << scan.bit
        e += 1
        lanes.pos = lanes.pos + n + s
        stay = e < end
        if not stay.all():
            lane, e, end, lanes.pos = lane[stay], e[stay], end[stay], lanes.pos[stay]


def _decode_ac(coefs: np.ndarray, blocks: np.ndarray, first: np.ndarray, size: np.ndarray, lanes: Lanes, scan: Scan) -> None:
    flat, table = coefs.reshape(-1), scan.ac.whole()
    e, end = first.copy(), first + size
    k = np.full(len(e), scan.low)
    base = blocks[e] * 64
    while len(e):
        view = lanes.view()
        got = table[(view >> np.uint64(48)).astype(np.int64)]
        plain = got != 0
        k += got >> 8 & 255
        odd = np.flatnonzero(~plain)
        if len(odd):
            some = view[odd]
            sym, n = _symbols(some, scan.ac)
            r, s = sym >> 4, sym & 15
            stop = (s == 0) & (r < 15)
            m = np.where(stop, r, s)
            bits = lanes.top(some, n, m)
            got[odd] = n + m
            k[odd] += r
            real = s > 0
            if k[odd[real]].max(initial=0) > 63 or k[plain].max(initial=0) > 63:
                raise ValueError("broken entropy-coded data")
            flat[base[odd[real]] + k[odd[real]]] = extend(bits[real], s[real]) << scan.bit
            flat[(base + k)[plain]] = ((got[plain] >> 16) - 32768) << scan.bit
            k += 1
            over = k > scan.high
            over[odd[stop]] = True
            step = over.astype(np.int64)
            step[odd[stop]] = (1 << r[stop]) + bits[stop]
        else:
            if k.max() > 63:
                raise ValueError("broken entropy-coded data")
            flat[base + k] = ((got >> 16) - 32768) << scan.bit
            k += 1
            over = step = k > scan.high
        lanes.pos = lanes.pos + (got & 255)
        if over.any():
            e = e + step
            k[over] = scan.low
            stay = e < end
            if not stay.all():
                e, end, k, lanes.pos = e[stay], end[stay], k[stay], lanes.pos[stay]
            base = blocks[e] * 64


def _refine_ac(coefs: np.ndarray, blocks: np.ndarray, first: np.ndarray, size: np.ndarray, lanes: Lanes, scan: Scan) -> None:
    low, high = scan.low, scan.high
    old = coefs[blocks, low : high + 1] != 0
    zeros = np.zeros((len(blocks), high - low + 2), dtype=np.int8)  # before each place
    np.cumsum(~old, axis=1, out=zeros[:, 1:])
    width = high - low + 1
    e, end = first.copy(), first + size
    k = np.zeros(len(e), dtype=np.int64)
    skip = np.zeros(len(e), dtype=np.int64)  # blocks left of a run of ended blocks
    events: list[tuple[np.ndarray, ...]] = []  # (entry, from, to, bit position): old coefficients that read a bit each
    fresh: list[tuple[np.ndarray, ...]] = []
    while len(e):
        view = lanes.view()
        inside = skip > 0
        got = scan.ac.peek[(view >> np.uint64(48)).astype(np.int64)]
        n, sym = np.where(inside, 0, got & 31), np.where(inside, 0, got >> 5)
        if not ((n > 0) | inside).all():
            raise ValueError("broken entropy-coded data")
        r, s = sym >> 4, sym & 15
        stop = ~inside & (s == 0) & (r < 15)
        m = np.where(stop, r, s)
        bits = lanes.top(view, n, m)
        lanes.pos = lanes.pos + n + m
        skip = np.where(stop, (1 << np.where(stop, r, 0)) + bits, skip)
        whole = skip > 0
        to = np.full(len(e), width)
        run = np.flatnonzero(~whole)
        if len(run):
            want = zeros[e[run], k[run]].astype(np.int64) + r[run] + 1
            hit = zeros[e[run], 1:] >= want[:, None]
            to[run] = np.where(hit.any(axis=1), hit.argmax(axis=1), width)
            new = run[(s[run] > 0) & (to[run] < width)]
            fresh.append((e[new], to[new], np.where(bits[new] > 0, 1, -1)))
        n_old = (to - k) - (zeros[e, to].astype(np.int64) - zeros[e, k])
        events.append((e, k, to, lanes.pos))
        lanes.pos = lanes.pos + n_old
        k = to + 1
        over = whole | (k >= width)
        skip = np.where(whole, skip - 1, skip)
        e = e + over
        k[over] = 0
        stay = e < end
        if not stay.all():
            e, end, k, skip, lanes.pos = e[stay], end[stay], k[stay], skip[stay], lanes.pos[stay]
    if not events:
        return
    entry, frm, to, pos = (np.concatenate(x) for x in zip(*events, strict=True))
    flat = coefs.reshape(-1)
    # Blocks of old coefficients alone, passed in one event: their bits follow one another.
    dense = old.all(axis=1)
    mine = np.flatnonzero((frm == 0) & (to == width) & dense[entry])
    if len(mine):
        band = coefs[blocks[entry[mine]], low : high + 1]
        for k in range(0, width, 32):
            view = Lanes(lanes.windows, pos[mine] + k).view()[:, None]
            some = np.arange(k, min(k + 32, width))
            bit = (view >> (np.uint64(63) - (some - k).astype(np.uint64))) & np.uint64(1)
            band[:, some] += np.sign(band[:, some]) * (bit.astype(band.dtype) << scan.bit)
        coefs[blocks[entry[mine]], low : high + 1] = band
        old[entry[mine]] = False
    # Every other old coefficient lies in one event of its block; its bit is the event's first and the old ones before it.
    order = np.lexsort((frm, entry))
    entry, frm, to, pos = entry[order], frm[order], to[order], pos[order]
    row, col = np.nonzero(old)
    i = np.searchsorted(entry * 128 + frm, row * 128 + col, side="right") - 1
    rank = (col - frm[i]) - (zeros[row, col].astype(np.int64) - zeros[row, frm[i]])
    at = pos[i] + rank
    bit = (lanes.windows[np.minimum(at >> 3, len(lanes.windows) - 1)] >> (np.uint64(63) - (at & 7).astype(np.uint64))) & np.uint64(1)
    on = np.flatnonzero(bit)
    where = blocks[row[on]] * 64 + low + col[on]
    flat[where] += np.sign(flat[where]) * (1 << scan.bit)
    for some, place, sign in fresh:
        flat[blocks[some] * 64 + low + place] = sign << scan.bit


def coefficients(files: list[File]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients [blocks of all files, 64] as quantised, in zigzag order; first block of each file)."""
    bases = np.concatenate(([0], np.cumsum([f.geometry.blocks for f in files])))
    coefs = np.zeros((int(bases[-1]), 64), dtype=np.int32)
    for i in range(max((len(f.scans) for f in files), default=0)):
        groups: dict[tuple, list[int]] = {}
        for j, f in enumerate(files):
            if i < len(f.scans):
                s = f.scans[i]
                groups.setdefault((s.parts, s.low, s.high, s.was, s.bit, *map(id, s.dc if s.low == 0 else [s.ac])), []).append(j)
        for some in groups.values():
            scans = [files[j].scans[i] for j in some]
            orders = [files[j].geometry.order(scans[0].parts) for j in some]
            first, size, image = segments_of(orders, [s.restart for s in scans])
            windows, pos, n = _segments([files[j] for j in some], scans)
            if (n != np.bincount(image, minlength=len(some))).any():
                raise ValueError("restart markers are missing")
            blocks = np.concatenate([o[0] + bases[j] for o, j in zip(orders, some, strict=True)])
            lanes = Lanes(windows, pos)
            if scans[0].low == 0:
                _decode_dc(coefs, blocks, np.concatenate([o[1] for o in orders]), first, size, lanes, scans[0])
            elif scans[0].was == 0:
                _decode_ac(coefs, blocks, first, size, lanes, scans[0])
            else:
                _refine_ac(coefs, blocks, first, size, lanes, scans[0])
    return coefs, bases


def samples(coefs: np.ndarray) -> np.ndarray:
    """Samples [blocks, 64] of dequantised coefficients."""
    x = coefs @ basis()
    x *= 1 / 65536
    x += 128.5
    return np.clip(np.floor(x, out=x), 0, 255, out=x)


def pixels(file: File, coefs: np.ndarray) -> np.ndarray:
    """The full-resolution RGB tensor [height, width, 3] of one file's coefficients."""
    g = file.geometry
    most_h, most_v = max(h for h, _ in g.sampling), max(v for _, v in g.sampling)
    planes = []
    for (rows, cols), base, q, (h, v) in zip(g.shapes, g.bases, file.quant, g.sampling, strict=True):
        x = samples(coefs[base : base + rows * cols] * q)
        plane = x.astype(np.int32).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if most_v % v or most_h % h:
            raise ValueError("sampling factors must divide the largest")
        planes.append(np.repeat(np.repeat(plane, most_v // v, axis=0), most_h // h, axis=1)[: g.height, : g.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    # The conversion's factors 1.402, 0.344136, 0.714136 and 1.772 in units of 2 ** -16.
    out = np.stack((y + ((91881 * r + 32768) >> 16), y - ((22554 * b + 46802 * r + 32768) >> 16), y + ((116130 * b + 32768) >> 16)), axis=2)
    return np.clip(out, 0, 255).astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """The RGB tensor of a file."""
    file = parse(raw)
    return pixels(file, coefficients([file])[0])
