"""Language-model scoring with a causal self-attention model trained in numpy.

Tokens of the score are lower-cased words and one end per text; inside, each word is a blank and its bytes in subword
ids: byte-level BPE with the first ``MERGES`` merges of a public vocabulary.  The model has one attention layer over
subwords with learned relative positions; it predicts the class of the next subword, and the subword follows from its
class and the subword before it:

    p(word | context) = SHARE * base(word) + (1 - SHARE) * product over its subwords of
                        p(class | attention over the window) * p(subword | class, subword before)

Texts are laid out in rows of ``STRIDE`` subwords behind a row of padding.  A window is a row and the row before it,
``WINDOW`` subwords, and scores those of its last row: each subword is scored once, and with at least WINDOW - STRIDE
subwords before it where the text has them.  All windows of a batch are views of the same rows.

Everything is learned from all training documents.

1. Code.  One narrow pass over the texts deals them into blocks, numbers each block's words, splits every distinct word
   into subwords once and writes: the coded block, the block's words with their counts, the subwords of the training
   texts in pieces, and sums of a fixed size (subword pairs inside words and across them, and what classes are made of).
2. Count.  The word counts behind ``base`` are a distributed table and never meet in one place; the counts of a block's
   words come back to it by a join.
3. Train.  The attention weights start at random and learn in ``ROUNDS`` from the pieces, of which each belongs to one
   round: every task takes steps of its own from the weights of the round before over all its windows, and the round's
   weights are the mean over the tasks by windows.  A step learns from all targets of its windows.
   Later rounds have more pieces; together they have all.
4. Score.  Every block by itself.

Nothing is dealt by a key of the documents, so rows that repeat an id or a text do not meet.

Defined results: null and empty texts hold the end alone; rows with a null id are learned from and not held out; rows
that repeat an id are scored each; without training documents every count is 0 and the base is uniform over one
unknown token; an empty table gives an empty result.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import drop_written, prepare, release, spread, text_of, written
from lexiloom.llm.ragged import SmallPairTable, merge_lowest

MERGES, CLASSES, WIDTH, WINDOW, STRIDE = 768, 64, 16, 32, 16
SHARE, SMOOTH, FOLDS = 0.5, 0.1, 10
#: Shares of 64 of the pieces that each round learns from; rows and windows of a row in a step; the first round's rate.
ROUNDS, SEGMENTS, RUN, RATE = (2, 2, 4, 8, 16, 32), 32, 8, 0.04
TRAITS, CHUNK = 24, 4096
BLOCK_BYTES, PIECE_WORDS, POOL = 8 << 20, 100_000, 1_000_000
END_WORD = "\n"  # no word holds a line feed
#: Kinds of rows of the coded table.
BLOCK, PIECE, WORD, SUM = range(4)


class Subwords:
    """Byte-level BPE with the first merges of a vocabulary file: ids 0-255 are bytes, then merges by rank."""

    TOGETHER = 8192

    def __init__(self, path: str, merges: int = MERGES):
        from lexiloom.llm.bpe import byte_letters

        with open(path, encoding="utf-8") as f:
            pairs = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"][:merges]]
        ids = byte_letters()
        rows = []
        for rank, (a, b) in enumerate(pairs):
            ids[a + b] = 256 + rank
            rows.append((ids[a], ids[b], rank, 256 + rank))
        left, right, rank, merged = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        self.size = 256 + len(pairs)
        self.end, self.pad = self.size, self.size + 1
        self.table = SmallPairTable(left, right, rank, merged, self.size)
        blank = [c for c, b in byte_letters().items() if b == 0x20][0]
        self.starts = np.array([n.startswith(blank) for n in sorted(ids, key=ids.get)] + [True, False])

    def split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number by word); every word gets a blank before it."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        all_ids, all_n = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(words), self.TOGETHER):  # bounds the symbol arrays
            cut = offsets[i : i + self.TOGETHER + 1]
            lengths = np.diff(cut) + 1
            symbols = np.full(int(lengths.sum()), 0x20, dtype=np.int64)
            symbols[np.arange(cut[-1] - cut[0]) + np.repeat(np.arange(1, len(lengths) + 1), lengths - 1)] = data[cut[0] : cut[-1]]
            ids, n = merge_lowest(symbols, lengths, self.table)
            all_ids.append(ids)
            all_n.append(n)
        return np.concatenate(all_ids), np.concatenate(all_n)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word numbers, how many by text, the words): lower-cased words parted by ASCII white space, and word 0 as each text's end."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    some = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) > 0
    lists = pc.ascii_split_whitespace(trimmed.filter(pa.array(some)))
    sizes = np.zeros(len(some), dtype=np.int64)
    sizes[some] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    numbers = np.zeros(len(coded) + len(sizes), dtype=np.int32)
    numbers[np.arange(len(coded)) + np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy(zero_copy_only=False) + 1
    return numbers, sizes + 1, coded.dictionary


@dataclass
class Lexicon:
    """The subwords of a block's words, one after the other; word 0 is the end."""

    ids: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        self.at = np.cumsum(self.n) - self.n

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subwords, where each word's begin, how many)."""
        k = self.n[numbers]
        ends = np.cumsum(k)
        before = ends - k
        at = np.repeat((self.at[numbers] - before).astype(np.int32), k)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids.take(at), before, k


def lay_out(tokens: np.ndarray, lengths: np.ndarray, end: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of documents that follow one another in ``tokens``: (inputs, targets), both [rows, STRIDE].

    A document takes a row of padding and then its own; an input is the subword before its target, at the beginning an
    end.  -1 marks what is no target.
    """
    n = -(-lengths // STRIDE) + 1
    first = (np.cumsum(n) - n + 1) * STRIDE
    x, y = np.full((2, int(n.sum()) * STRIDE), (pad,), dtype=np.int16)
    y[:] = -1
    ends = np.cumsum(lengths)
    at = np.repeat(first - ends + lengths, lengths) + np.arange(int(lengths.sum()))
    y[at] = tokens
    inner = np.ones(len(at), dtype=bool)
    inner[ends - 1] = False
    x[at[inner] + 1] = tokens[inner]
    x[first] = end
    return x.reshape(-1, STRIDE), y.reshape(-1, STRIDE)


def _windows(rows: np.ndarray) -> np.ndarray:
    """A view of [segments, rows + 1, STRIDE, columns]: of each row but the first the WINDOW subwords up to its last."""
    g, b, s, c = rows.shape
    w = rows.strides
    return as_strided(rows, (g, b - 1, 2 * s, c), (w[0], w[1], w[2], w[3]), writeable=False)


class Weights:
    """The parameters; all have a fixed size.  The learned ones are views of one vector."""

    def __init__(self, flat: np.ndarray, own: np.ndarray, inside: np.ndarray, class_of: np.ndarray):
        self.flat, self.own, self.inside, self.class_of = flat, own, inside, class_of
        size, at = len(class_of), 0
        for name, shape in self.shapes(size).items():
            setattr(self, name, flat[at : at + int(np.prod(shape))].reshape(shape))
            at += int(np.prod(shape))

    @staticmethod
    def shapes(size: int) -> dict[str, tuple[int, ...]]:
        return {"query": (size, WIDTH), "key": (size, WIDTH), "value": (size, WIDTH), "mix": (WIDTH, CLASSES), "near": (WINDOW,)}

    def __reduce__(self):
        return Weights, (self.flat, self.own, self.inside, self.class_of)

    def with_flat(self, flat: np.ndarray) -> Weights:
        return Weights(flat, self.own, self.inside, self.class_of)

    def tables(self, pad: int) -> tuple:
        """Query, key and value rows with a column more, so that products mask padding and sum weights on the way."""
        one = np.ones((len(self.query), 1), dtype=np.float32)
        mask = np.where(np.arange(len(self.query))[:, None] == pad, np.float32(-1e9), np.float32(0))
        far = np.arange(STRIDE, WINDOW)[:, None] - np.arange(WINDOW)
        bias = np.where(far >= 0, self.near[np.maximum(far, 0)], np.float32(-1e9)).astype(np.float32)
        norm = lambda t, axis: float(np.sqrt((t * t).sum(axis=axis)).max())
        # Whether exponents could leave what exp can give; then their maximum is taken off first.
        tall = norm(self.query, 1) * norm(self.key, 1) + float(np.abs(self.near).max()) > 60
        wide = norm(self.value, 1) * norm(self.mix, 0) + float(np.abs(self.own).max()) > 60
        return np.hstack((self.query, one)), np.hstack((self.key, mask)), np.hstack((self.value, one)), bias, tall, wide

    def attend(self, x: np.ndarray, tables: tuple, rows: slice = slice(None)) -> tuple[np.ndarray, ...]:
        """Of [segments, rows + 1, STRIDE] inputs; ``rows`` are the places of a row to predict from."""
        query, key, value, bias, tall, wide = tables
        late = x[:, 1:, rows]
        q, k, v = query.take(late, axis=0), key.take(x, axis=0), value.take(x, axis=0)
        s = q @ _windows(k).swapaxes(2, 3)
        s += bias[rows]
        if tall:
            s -= s.max(axis=3, keepdims=True)
        a = np.exp(s, out=s)
        h = a @ _windows(v)
        total = np.maximum(h[..., -1:], np.float32(1e-30))
        h = h[..., :-1] / total
        z = h.reshape(-1, WIDTH) @ self.mix
        z += self.own.take(late.ravel(), axis=0)
        if wide:
            z -= z.max(axis=1, keepdims=True)
        return q, k, v, a, total, h, z

    def log_probs(self, x: np.ndarray, y: np.ndarray, pad: int, rows: int = 256) -> np.ndarray:
        """Natural log probability of each target of what ``lay_out`` gives, in order."""
        out = np.zeros(y.shape, dtype=np.float32)
        tables, size = self.tables(pad), len(self.class_of)
        one = np.ones((CLASSES, 1), dtype=np.float32)
        flat, inside = np.arange(rows * STRIDE) * CLASSES, self.inside.ravel()
        for i in range(0, len(x) - 1, rows):
            late, t = x[i + 1 : i + rows + 1].ravel(), np.maximum(y[i + 1 : i + rows + 1], 0).ravel()
            z = self.attend(x[None, i : i + rows + 1], tables)[-1]
            own = z.ravel().take(flat[: len(t)] + self.class_of[t])
            got = own - np.log((np.exp(z, out=z) @ one)[:, 0]) + inside.take(late.astype(np.int64) * size + t)
            out[i + 1 : i + rows + 1] = got.reshape(-1, STRIDE)
        return out[y >= 0]


def trait_sums(tokens: np.ndarray, lengths: np.ndarray, marks: np.ndarray, size: int) -> np.ndarray:
    """Random projections of the documents each subword occurs in, summed: whole numbers, so that no order matters."""
    out = np.zeros((size, TRAITS), dtype=np.int64)
    ends = np.cumsum(lengths)
    for i in range(0, len(lengths), 256):
        n = lengths[i : i + 256]
        some = tokens[ends[i] - n[0] : ends[i + len(n) - 1]]
        share = np.bincount(np.repeat(np.arange(len(n)), n) * size + some, minlength=len(n) * size).reshape(len(n), size) / n[:, None]
        signs = ((marks[i : i + 256, None] >> np.arange(TRAITS)) & 1) * 2 - 1
        out += (np.rint(share * (1 << 16)).T @ signs.astype(np.float64)).astype(np.int64)
    return out


def classes(traits: np.ndarray, pairs: np.ndarray, starts: np.ndarray, n_classes: int) -> np.ndarray:
    """A class for every subword: frequent word starts alone, the others by the documents they occur in."""
    size = len(starts)
    freq = pairs.sum(axis=0)
    alone = [i for i in np.argsort(-freq, kind="stable").tolist() if starts[i]][: n_classes // 4]
    out = np.full(size, -1, dtype=np.int64)
    out[alone] = np.arange(len(alone))
    code = traits.astype(np.float64)
    code /= np.linalg.norm(code, axis=1, keepdims=True) + 1e-9
    at = len(alone)
    for group in (True, False):
        some = np.flatnonzero((starts == group) & (out < 0))
        k = min((n_classes - len(alone)) // 2, len(some))
        if not k:
            continue
        heavy = some[np.argsort(-freq[some], kind="stable")]
        centre = code[heavy[:k]].copy()
        for _ in range(10):
            near = np.argmax(code[some] @ centre.T, axis=1)
            for c in range(k):
                mine = some[near == c]
                if len(mine):
                    centre[c] = (code[mine] * (freq[mine, None] + 1)).sum(axis=0)
            centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
        out[some] = at + near
        at += k
    return out


def count_tables(pairs: np.ndarray, across: np.ndarray, class_of: np.ndarray, starts: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(log p(class | before), log p(subword | class, before)) from pair counts with back-off.

    ``pairs`` has the counts inside words, and in its last row those of first subwords; ``across`` those of a word's
    last subword and the next word's first.  A word's start does not depend on the subword before it but through its
    class.
    """
    size = len(class_of)
    one_hot = np.zeros((size, n_classes))
    one_hot[np.arange(size), class_of] = 1
    total = pairs.sum(axis=0) + 0.01
    alone = total / (total @ one_hot)[class_of]
    by_class = pairs @ one_hot
    inside = (pairs + 5 * alone) / (by_class[:, class_of] + 5)
    inside[:, starts] = ((pairs[-1] + 0.01) / ((pairs[-1] + 0.01) @ one_hot)[class_of])[starts]
    first = (pairs[-1] @ one_hot + 0.01) / (pairs[-1].sum() + 0.01 * n_classes)
    own = by_class[:-1] + across @ one_hot + first
    own = (own + 0.01) / (own + 0.01).sum(axis=1, keepdims=True)
    return np.log(own).astype(np.float32), np.log(inside[:-1]).astype(np.float32)


def initial(traits: np.ndarray, pairs: np.ndarray, across: np.ndarray, sub: Subwords, seed: int = 5) -> Weights:
    """The weights before any step: attention at random, everything else from the counts."""
    rng = np.random.default_rng(seed)
    class_of = classes(traits, pairs, sub.starts, CLASSES)
    own, inside = count_tables(pairs, across, class_of, sub.starts, CLASSES)
    scale = {"query": 0.3, "key": 0.3, "value": 0.3, "mix": 0.03, "near": 0.0}
    flat = np.concatenate([(rng.normal(size=shape) * scale[n]).astype(np.float32).ravel() for n, shape in Weights.shapes(sub.size + 2).items()])
    return Weights(flat, own, inside, class_of)


class Places:
    """Sums rows by the subword they belong to."""

    def __init__(self, at: np.ndarray, size: int):
        at = at.ravel()
        self.size, self.order = size, np.argsort(at, kind="stable")  # by radix: subwords are 16-bit
        at = at[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.at = at[self.first]

    def sums(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, WIDTH), dtype=np.float32)
        out[self.at] = np.add.reduceat(rows.reshape(-1, WIDTH).take(self.order, axis=0), self.first, axis=0)
        return out


def _of_keys(weights: np.ndarray, late: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """[segments, rows + 1, STRIDE, WIDTH]: what reaches every input as a key from the row it is in and the one after."""
    out = np.empty((*shape, WIDTH), dtype=np.float32)
    out[:, 0] = 0
    np.matmul(weights[..., STRIDE:].swapaxes(2, 3), late, out=out[:, 1:])
    out[:, :-1] += weights[..., :STRIDE].swapaxes(2, 3) @ late
    return out


def gradient(w: Weights, x: np.ndarray, y: np.ndarray, pad: int, rows: slice = slice(None)) -> np.ndarray:
    """Of the mean loss over the targets at the places ``rows`` of [segments, rows (+ 1 for x), STRIDE], by the learned weights."""
    q, k, v, a, total, h, p = w.attend(x, w.tables(pad), rows)
    size = len(w.class_of)
    target = y[:, :, rows].ravel()
    share = (target >= 0).astype(np.float32)
    share /= max(share.sum(), 1)
    np.exp(p, out=p)
    p *= (share / (p @ np.ones(CLASSES, dtype=np.float32)))[:, None]
    p.ravel()[np.arange(len(target)) * CLASSES + w.class_of[np.maximum(target, 0)]] -= share
    a /= total
    dh = (p @ w.mix.T).reshape(h.shape)
    ds = dh @ _windows(v)[..., :-1].swapaxes(2, 3)
    ds -= np.einsum("...i,...i->...", dh, h)[..., None]
    ds *= a
    keys, queries = Places(x, size), Places(x[:, 1:, rows], size)
    near = np.zeros(WINDOW, dtype=np.float32)
    far = (np.arange(STRIDE, WINDOW)[:, None] - np.arange(WINDOW))[rows].ravel()
    by_place = np.ones(ds.shape[0] * ds.shape[1], dtype=np.float32) @ ds.reshape(-1, far.size)
    np.add.at(near, np.maximum(far, 0), np.where(far >= 0, by_place, 0))
    parts = queries.sums(ds @ _windows(k)[..., :-1]), keys.sums(_of_keys(ds, q[..., :-1], x.shape)), keys.sums(_of_keys(a, dh, x.shape)), h.reshape(-1, WIDTH).T @ p, near
    return np.concatenate([x.ravel() for x in parts])


class Descent:
    """Adam over the windows it is fed, in place."""

    def __init__(self, w: Weights, rate: float, pad: int, seed: int):
        self.w, self.rate, self.pad, self.rng = w, rate, pad, np.random.default_rng(seed)
        self.mean, self.square, self.step, self.windows = np.zeros_like(w.flat), np.zeros_like(w.flat), 0, 0

    def feed(self, x: np.ndarray, y: np.ndarray) -> None:
        """Steps over all rows of ``lay_out``: runs of RUN windows, in random order."""
        x = np.concatenate((x, np.full((-(len(x) - 1) % RUN, STRIDE), self.pad, dtype=x.dtype)))
        y = np.concatenate((y, np.full((len(x) - len(y), STRIDE), -1, dtype=y.dtype)))
        start = self.rng.permutation(np.arange(0, len(x) - 1, RUN))
        for i in range(0, len(start), SEGMENTS):
            at = start[i : i + SEGMENTS, None] + np.arange(RUN + 1)
            grad = gradient(self.w, x[at], y[at[:, 1:]], self.pad)
            self.step += 1
            self.windows += at[:, 1:].size
            self.mean += 0.1 * (grad - self.mean)
            self.square += 0.01 * (grad * grad - self.square)
            now = self.rate * min(1, self.step / 20) / (1 - 0.9**self.step)
            self.w.flat -= np.float32(now) * self.mean / (np.sqrt(self.square / np.float32(1 - 0.99**self.step)) + np.float32(1e-6))


def packed(a: np.ndarray, kind: str) -> bytes:
    """Compressed; of four bytes all lowest ones first, then the next: they compress better by themselves."""
    import zstandard

    a = a.astype(kind)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes() if a.itemsize == 4 else a.tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(data.reshape(4, -1).T).view(kind).ravel() if np.dtype(kind).itemsize == 4 else data.view(kind)


class Speller:
    """Lexicons of a task's blocks; words of the blocks before are not split again."""

    MOST = 1_000_000

    def __init__(self, sub: Subwords):
        self.sub, self.words, self.lexicon = sub, pa.array([], type=pa.string()), Lexicon(np.array([sub.end], dtype=np.int16), np.array([1]))

    def lexicon_of(self, words: pa.Array) -> Lexicon:
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        ids, n = self.sub.split(new)
        known = Lexicon(np.concatenate((self.lexicon.ids, ids.astype(np.int16))), np.concatenate((self.lexicon.n, n)))
        number = np.arange(len(self.words), len(self.words) + len(words))
        old = at.is_valid().to_numpy(zero_copy_only=False)
        number[old] = at.drop_null().to_numpy()
        number[~old] = np.arange(len(self.words), len(self.words) + len(new))
        ids, _, n = known.expand(np.concatenate(([0], number + 1)))
        out = Lexicon(ids, n)
        self.words, self.lexicon = (pa.concat_arrays([self.words, new]), known) if len(known.n) < self.MOST else (words, out)
        return out


class Coder:
    """What the first pass makes of a task's documents."""

    NAMES = ("kind", "block", "part", "ids", "held_out", "lengths", "numbers", "subword_counts", "subwords", "word", "no", "c")

    def __init__(self, sub: Subwords, id_type: pa.DataType, part: int):
        self.sub, self.part, self.blocks, self.speller = sub, part, 0, Speller(sub)
        size = sub.size + 2
        self.types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        self.pairs, self.across, self.traits = np.zeros((size + 1) * size, dtype=np.int64), np.zeros(size * size, dtype=np.int64), np.zeros((size, TRAITS), dtype=np.int64)

    def rows(self, kind: int, n: int, **columns) -> pa.RecordBatch:
        columns["kind"] = np.full(n, kind, dtype=np.int32)
        return pa.RecordBatch.from_arrays([columns[x] if isinstance(columns.get(x), pa.Array) else pa.array(columns[x], type=t) if x in columns else pa.nulls(n, t) for x, t in zip(self.NAMES, self.types, strict=True)], names=list(self.NAMES))

    def block(self, ids: pa.Array, texts: pa.Array, held_out: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers, lengths, words = numbered(texts)
        words = words.cast(pa.string())
        lexicon = self.speller.lexicon_of(words)
        number = (self.part << 24) + self.blocks
        self.blocks += 1
        lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), a)
        yield self.rows(BLOCK, 1, block=[number], ids=lists(ids), held_out=lists(pa.array(held_out)), lengths=[packed(lengths, "<i4")], numbers=[packed(numbers, "<i4")], subword_counts=[packed(lexicon.n, "<i4")], subwords=[packed(lexicon.ids, "<i2")])
        mine = np.repeat(~held_out, lengths)
        counts = np.bincount(numbers[mine], minlength=len(lexicon.n))
        names = pa.concat_arrays([pa.array([END_WORD]), words])
        for i in range(0, len(counts), 1 << 16):
            n = len(counts[i : i + (1 << 16)])
            yield self.rows(WORD, n, block=np.full(n, number), word=names[i : i + n], no=np.arange(i, i + n), c=counts[i : i + n])
        self.count(lexicon, counts)
        yield from self.pieces(number, numbers[mine], lengths[~held_out], marks[~held_out], lexicon)

    def count(self, lexicon: Lexicon, counts: np.ndarray) -> None:
        """Subword pairs inside the words; the last row has first subwords."""
        size = self.sub.size + 2
        before = np.concatenate(([size], lexicon.ids[:-1]))
        before[lexicon.at] = size
        self.pairs += np.bincount(before * size + lexicon.ids, weights=np.repeat(counts, lexicon.n), minlength=len(self.pairs)).astype(np.int64)

    def pieces(self, number: int, numbers: np.ndarray, lengths: np.ndarray, marks: np.ndarray, lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
        size = self.sub.size + 2
        ends = np.cumsum(lengths)
        i = 0
        while i < len(lengths):
            start = ends[i] - lengths[i]
            j = max(i + 1, int(np.searchsorted(ends, start + PIECE_WORDS, side="right")))
            some, n = numbers[start : ends[j - 1]], lengths[i:j]
            tokens, before, k = lexicon.expand(some)
            last = np.concatenate(([self.sub.end], tokens[(before + k - 1)[:-1]])).astype(np.int64)
            last[np.cumsum(n)[:-1]] = self.sub.end  # stands for the start, as in windows
            self.across += np.bincount(last * size + tokens[before], minlength=len(self.across))
            by_text = np.add.reduceat(k, np.cumsum(n) - n)
            self.traits += trait_sums(tokens, by_text, marks[i:j], size)
            yield self.rows(PIECE, 1, block=[number], part=[int(marks[i] >> 32 & 63)], lengths=[packed(by_text, "<i4")], subwords=[packed(tokens, "<i2")])
            i = j

    def sums(self) -> Iterator[pa.RecordBatch]:
        held = np.concatenate((self.pairs, self.across, self.traits.ravel()))
        at = np.flatnonzero(held)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield self.rows(SUM, len(some), no=some, c=held[some])


def coded(rows: DataFrame, vocab_path: str, block_bytes: int) -> DataFrame:
    """The coded table of rows (id, text, held_out, mark), by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, texts, out, marks = (pa.concat_arrays([b.column(i) for b in held]) for i in range(4))
            return coder.block(ids, texts, out.to_numpy(zero_copy_only=False).astype(bool), marks.to_numpy())

        for batch in batches:
            if coder is None:
                coder = Coder(subwords(vocab_path), batch.schema.field(0).type, TaskContext.get().partitionId())
            start = 0
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > block_bytes:
                    held.append(batch.slice(start, i - start))
                    yield from flush()
                    held, size, start = [], 0, i
                size += n
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from flush()
        if coder is not None:
            yield from coder.sums()

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"kind int, block long, part int, ids array<{kind}>, held_out array<boolean>, lengths binary, numbers binary, subword_counts binary, subwords binary, word string, no long, c long"
    return written(spread(rows).mapInArrow(run, schema), "coded", ["kind"])


def fixed_sums(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(traits, pairs inside words, pairs across words) over all training texts; of a fixed size."""
    found = table.filter(F.col("kind") == SUM).groupBy("no").agg(F.sum("c").alias("c")).toPandas()
    cuts = [(size + 1) * size, (2 * size + 1) * size]
    out = np.zeros(cuts[1] + size * TRAITS)
    out[found["no"].to_numpy(dtype=np.int64)] = found["c"].to_numpy(dtype=np.float64)
    pairs, across, traits = np.split(out, cuts)
    return traits.reshape(size, TRAITS), pairs.reshape(size + 1, size), across.reshape(size, size)


def _stepper(sent, rate: float, vocab_path: str):
    """A task's weights after a pass over its pieces, in chunks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, part = subwords(vocab_path), TaskContext.get().partitionId()
        descent = Descent(sent.value.with_flat(sent.value.flat.copy()), rate, sub.pad, part)
        pool, held = [], 0

        def feed() -> None:
            tokens, lengths = np.concatenate([t for t, _ in pool]), np.concatenate([n for _, n in pool])
            descent.feed(*lay_out(tokens, lengths, sub.end, sub.pad))

        for batch in batches:
            for tokens, lengths in zip(batch.column(0), batch.column(1), strict=True):
                pool.append((unpacked(tokens.as_py(), "<i2"), unpacked(lengths.as_py(), "<i4").astype(np.int64)))
                held += len(pool[-1][0])
                if held >= POOL:
                    feed()
                    pool, held = [], 0
        if pool:
            feed()
        if descent.step:
            flat = descent.w.flat
            parts = [flat[i : i + CHUNK].tobytes() for i in range(0, len(flat), CHUNK)]
            many = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(many), type=pa.int32()), pa.array([part] * many, type=pa.int32()), pa.array([descent.windows] * many, type=pa.int64()), pa.array(parts, type=pa.binary())], names=["chunk", "task", "n", "w"])

    return step


def _mean(key: tuple, table: pa.Table) -> pa.Table:
    """Of a chunk over tasks, by windows."""
    table = table.sort_by("task")
    n = table.column("n").to_numpy().astype(np.float64)
    total = 0.0
    for share, part in zip(n / n.sum(), table.column("w"), strict=True):
        total = total + share * np.frombuffer(part.as_py(), dtype=np.float32)
    return pa.table({"chunk": pa.array([key[0].as_py()], type=pa.int32()), "task": table.column("task")[:1], "n": pa.array([int(n.sum())], type=pa.int64()), "w": pa.array([total.astype(np.float32).tobytes()], type=pa.binary())})


def learn(pieces: DataFrame, start: Weights, vocab_path: str) -> Weights:
    """``start`` after a pass over the windows of all pieces (subwords, lengths, part)."""
    spark = pieces.sparkSession
    w, done = start, 0
    shape = "chunk int, task int, n long, w binary"
    for r, share in enumerate(ROUNDS):
        step = _stepper(spark.sparkContext.broadcast(w), RATE * (1 - r / (len(ROUNDS) + 2)), vocab_path)
        mine = pieces.filter((F.col("part") >= done) & (F.col("part") < done + share))
        done += share
        stepped = mine.select("subwords", "lengths").mapInArrow(step, shape)
        # In two steps, so that no group has more than about the root of the number of tasks.
        some = max(1, round(pieces.rdd.getNumPartitions() ** 0.5))
        means = stepped.groupBy("chunk", (F.col("task") % some).alias("task_group")).applyInArrow(_mean, shape).groupBy("chunk").applyInArrow(_mean, shape)
        got = sorted(means.select("chunk", "w").collect())
        if got:
            w = w.with_flat(np.frombuffer(b"".join(bytes(x.w) for x in got), dtype=np.float32).copy())
    return w


def score_block(numbers: np.ndarray, lengths: np.ndarray, lexicon: Lexicon, counts: np.ndarray, total: int, distinct: int, w: Weights, sub: Subwords, share: float = SHARE) -> tuple[np.ndarray, ...]:
    """(n_known, base_score, score) of each text."""
    base = np.log((counts + SMOOTH) / (total + SMOOTH * (distinct + 1)))
    n_texts = len(lengths)
    out_base, out_score, known = np.zeros(n_texts), np.zeros(n_texts), np.zeros(n_texts, dtype=np.int64)
    ends = np.cumsum(lengths)
    i = 0
    while i < n_texts:  # some documents at a time
        start = ends[i] - lengths[i]
        j = max(i + 1, int(np.searchsorted(ends, start + PIECE_WORDS, side="right")))
        some, n = numbers[start : ends[j - 1]], lengths[i:j]
        tokens, before, k = lexicon.expand(some)
        heads = np.cumsum(n) - n
        x, y = lay_out(tokens, np.add.reduceat(k, heads), sub.end, sub.pad)
        by_word = np.add.reduceat(w.log_probs(x, y, sub.pad).astype(np.float64), before)
        mixed = np.logaddexp(np.log(share) + base[some], np.log(1 - share) + by_word) if share else by_word
        out_base[i:j] = np.add.reduceat(base[some], heads)
        out_score[i:j] = np.add.reduceat(mixed, heads)
        known[i:j] = np.add.reduceat((counts[some] > 0).astype(np.int64), heads)
        i = j
    return known, out_base / np.log(10), out_score / np.log(10)


def lm_scores(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, share: float = SHARE) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row; ``share`` is the base's in the score."""
    spark = docs.sparkSession
    prepare(spark)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    text = text_of(text_col)
    table = coded(docs.select(F.col(id_col).alias("id"), text.alias("text"), held_out.alias("held_out"), F.xxhash64(text).alias("mark")), vocab_path, block_bytes)
    used = table.filter(F.col("kind") == WORD).select("block", "no", "word", "c")
    totals = written(used.groupBy("word").agg(F.sum("c").alias("c")), "totals")
    total, distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    sub = Subwords(vocab_path)
    start = initial(*fixed_sums(table, sub.size + 2), sub)
    weights = spark.sparkContext.broadcast(learn(table.filter(F.col("kind") == PIECE), start, vocab_path))
    drop_written(table, f"kind={PIECE}")  # else the pieces stay on disk until the end
    release(spark)

    # A hash of the counts in each partition spares sorting the longer side by words.
    known = used.select(F.col("block").alias("owner"), "no", "word").join(totals.hint("shuffle_hash"), "word").select("owner", "no", "c")
    blocks = table.filter(F.col("kind") == BLOCK).select("block", "ids", "held_out", "lengths", "numbers", "subword_counts", "subwords")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0] if left.num_rows else None
        ids = left.column("ids").combine_chunks().flatten()
        if row is None:
            got, lengths = [[]] * 3, np.zeros(0, dtype=np.int64)
        else:
            lengths = unpacked(row["lengths"], "<i4").astype(np.int64)
            counts = np.zeros(right.num_rows, dtype=np.int64)
            counts[right.column("no").to_numpy()] = right.column("c").to_numpy()
            lexicon = Lexicon(unpacked(row["subwords"], "<i2"), unpacked(row["subword_counts"], "<i4").astype(np.int64))
            got = score_block(unpacked(row["numbers"], "<i4"), lengths, lexicon, counts, total, distinct, weights.value, subwords(vocab_path), share)
        return pa.table({"id": ids, "held_out": left.column("held_out").combine_chunks().flatten(), "n_tokens": pa.array(lengths, type=pa.int64()), "n_known": pa.array(got[0], type=pa.int64()), "base_score": pa.array(got[1], type=pa.float64()), "score": pa.array(got[2], type=pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(known.groupBy("owner")).applyInArrow(scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
