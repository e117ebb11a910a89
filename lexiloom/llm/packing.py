"""Packing of token sequences by minimum bin slack.

1. Documents become pieces of at most ``capacity`` tokens.  A task numbers its pieces of each length, so a piece is
   known by (length, task, number) and the table of pieces, with their ids, is written once.
2. Pieces of equal length can stand for each other, so the histogram of lengths, at most ``capacity`` numbers however
   large the corpus, is all that the packing depends on.  For each bin the sums that the available lengths reach are the
   bits of one integer; the fullest sum is traced back to its lengths, which are taken away.  A combination that was the
   fullest stays the fullest while all of it is there, so it is taken as often as it can be, and one step may fill
   millions of bins.  Each bin must hold the longest piece that is left, or need not: the better of the two plans counts.
3. A piece's rank among those of its length follows from the counts of the tasks before; the plan says which ranks go to
   which bins, so the pieces find their places without meeting each other.

The plan goes to all tasks.  Its size has a bound that no corpus changes: a step leaves some length with fewer pieces
than it took of it, at most ``capacity / length``, so there are at most ``capacity * (2 + ln capacity)`` steps, of at most
``sqrt(2 capacity)`` lengths each.

Defined results: a null or empty text is one piece, the end id alone; a text of any length is cut into pieces of
``capacity`` tokens and a rest; rows that repeat an id or a text are pieces like any others, null ids too; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import prepare, spread, text_of, written

CAPACITY, END = 4096, 1
#: Runs without white space, and pre-tokens, that a task remembers the ids of, and the longest of them.
CACHE_RUNS, CACHE_BYTES = 600_000, 64
#: Characters of texts that are encoded together; a longer text goes by itself.
CHUNK = 1 << 20


class _Numbers(dict):
    """Numbers of runs; one that is asked for first gets the next number and is ``fresh``."""

    def __init__(self):
        self.fresh: list[bytes] = []
        self.count = 0

    def __missing__(self, run: bytes) -> int:
        number = self[run] = self.count
        self.count += 1
        self.fresh.append(run)
        return number


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for a pre-token.

    The vocabulary's pre-tokens, and its special tokens, never hold white space, and its normalisation never joins over
    it, so a text's ids are those of its runs without ASCII white space, one after another.  A run of PLAIN characters is
    lower-cased and cut into PRETOKENS as the vocabulary does, and the library's model merges those that are new.  Other
    runs, and those that may hold a special token, go through the whole of the library (both tested on whole texts).
    """

    #: The vocabulary's pre-tokens, and characters that its normalisation only lower-cases, one by one.
    PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u017e]+")
    SPECIAL = "<|"
    #: The model's character for a byte: itself if it is printed, else one of those from 256 on, in order.
    PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
    BYTES = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - PRINTED))}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.words: dict[str, bytes] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _cut(self, run: str) -> Sequence[str] | None:
        """The pre-tokens of a run, None if it is the library's to cut."""
        plain = run.isprintable() if run.isascii() else self.PLAIN.fullmatch(run)
        if not plain or self.SPECIAL in run:
            return None
        word = run.lower()
        if word.isalpha():
            return (word,)
        # A word with one mark or digit behind it is most of the rest.
        return (word[:-1], word[-1]) if word[:-1].isalpha() and not word[-1].isalpha() else self.PRETOKENS.findall(word)

    def _found(self, runs: list[str]) -> list[bytes]:
        """The ids of runs, as little-endian unsigned 32-bit integers."""
        cut, known, merged = list(map(self._cut, runs)), self.words, self.tokenizer.model.tokenize
        fresh = list({w for c in cut if c for w in c if w not in known})
        ids, ends = [], [0]
        for w in fresh:
            ids += [t.id for t in merged(w if w.isascii() else w.encode().decode("latin-1").translate(self.BYTES))]
            ends.append(4 * len(ids))
        data = np.array(ids, dtype="<u4").tobytes()
        known.update(zip(fresh, map(data.__getitem__, map(slice, ends, ends[1:])), strict=False))
        whole = [r for r, c in zip(runs, cut, strict=True) if c is None]
        others = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        return [np.array(next(others).ids, dtype="<u4").tobytes() if c is None else known[c[0]] if len(c) == 1 else b"".join(map(known.__getitem__, c)) for c in cut]

    def _learn(self, runs: list[bytes]) -> None:
        found = self._found([r.decode() for r in runs])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(found), dtype="<u4")
        self.used += total

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, how many each has)."""
        if len(self.sizes) > CACHE_RUNS or len(self.words) > CACHE_RUNS:
            self.clear()
        try:
            return self._encoded(texts)
        except BaseException:
            self.clear()  # fresh runs may have numbers and no ids
            raise

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.encode().split() for t in texts]
        known = self.number
        last = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(last[-1]) if len(last) else 0)
        fresh, known.fresh = known.fresh, []
        if fresh:
            self._learn(fresh)
        n = self.sizes[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(n.sum())]
        total = np.concatenate(([0], ends))[last]
        for r in fresh:
            if len(r) > CACHE_BYTES:  # rarely comes again
                del known[r]
                for w in self._cut(r.decode()) or ():
                    if len(w) > CACHE_BYTES:
                        self.words.pop(w, None)
        return ids, np.diff(total, prepend=0)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The process's encoder: what a task has learned stays for the next one."""
    return Encoder(path)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about CHUNK characters of their second column."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.utf8_length(batch.column(1))).to_numpy()
        start = 0
        while start < batch.num_rows:
            least = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, least + CHUNK, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length and ``ids`` (little-endian unsigned 32-bit) of every piece; part and slot number those of a length."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in _chunks(batches):
            ids, n = encode(batch.column(1).to_pylist())
            # The end id goes behind each text.
            whole = np.insert(ids, np.cumsum(n), end).astype("<u4", copy=False)
            n += 1
            each = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), each)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(n[of] - start, capacity)
            order = np.argsort(length, kind="stable")
            new = np.diff(length[order], prepend=-1) != 0
            first = np.flatnonzero(new)
            slot = np.empty_like(length)
            slot[order] = seen[length[order]] + np.arange(len(order)) - first[np.cumsum(new) - 1]
            seen += np.bincount(length, minlength=capacity + 1)
            ends = np.cumsum(length)
            offsets = pa.py_buffer(np.concatenate(([0], ends * 4)).astype("<i8").tobytes())
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, offsets, pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(piece), pa.array(start), pa.array(length), values.cast(pa.binary()), pa.array(np.full(len(of), part)), pa.array(slot)],
                names=[id_col, "piece", "start", "length", "ids", "part", "slot"],
            )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece long, start long, length long, ids binary, part long, slot long"
    return spread(docs.select(F.col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, schema)


def fullest(left: dict[int, int], capacity: int, longest: int = 0) -> dict[int, int]:
    """How many of each length of ``left`` fill a bin best, one of ``longest`` among them if that is given.

    Of equally full ones that is taken which the longer lengths reach.
    """
    mask = (1 << (capacity + 1)) - 1
    reached, steps = 1 << longest, []
    for length in sorted(left, reverse=True):
        copies = min(left[length] - (length == longest), (capacity - longest) // length)
        some = 1
        while copies > 0 and not reached >> capacity:
            some = min(some, copies)
            steps.append((length, some, reached))
            reached |= reached << (length * some) & mask
            copies -= some
            some *= 2
        if reached >> capacity:
            break
    total, taken = reached.bit_length() - 1, {longest: 1} if longest else {}
    for length, some, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + some
            total -= length * some
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY, seeded: bool = True) -> list[tuple[int, dict[int, int]]]:
    """(bins, how many of each length in one) until all ``counts`` are gone; ``seeded`` bins hold the longest that is left."""
    left, plan = {k: n for k, n in counts.items() if n}, []
    while left:
        taken = fullest(left, capacity, max(left) if seeded else 0)
        times = min(left[k] // n for k, n in taken.items())
        plan.append((times, taken))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """The plan of fewer bins, with or without the longest piece in every bin."""
    return min((minimum_bin_slack(counts, capacity, seeded) for seeded in (True, False)), key=lambda p: sum(t for t, _ in p))


@dataclass
class Places:
    """Where the piece of a length and rank goes: for each step and length the ranks from ``key``, ``copies`` to a bin."""

    key: np.ndarray
    copies: np.ndarray
    bin: np.ndarray
    offset: np.ndarray

    SHIFT = 48

    @classmethod
    def of(cls, plan: list[tuple[int, dict[int, int]]]) -> Places:
        rank: dict[int, int] = {}
        rows, bins = [], 0
        for times, taken in plan:
            offset = 0
            for length, n in sorted(taken.items(), reverse=True):
                rows.append(((length << cls.SHIFT) + rank.get(length, 0), n, bins, offset))
                rank[length] = rank.get(length, 0) + n * times
                offset += n * length
            bins += times
        return cls(*np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of pieces."""
        key = (length << self.SHIFT) + rank
        at = np.searchsorted(self.key, key, side="right") - 1
        nth = key - self.key[at]
        return self.bin[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def pack(stored: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a written table of pieces (length, part, slot) with their sequence_id and offset instead of part and slot."""
    spark = stored.sparkSession
    counts = written(stored.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    plan = best_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    places = spark.sparkContext.broadcast(Places.of(plan))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = stored.join(base, ["length", "part"]).withColumn("slot", F.col("base") + F.col("slot"))
    ranked = ranked.select(*[c for c in stored.columns if c != "part"])
    keep = [f for f in ranked.schema.fields if f.name != "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, offset = places.value(batch["length"].to_numpy(), batch["slot"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in keep), pa.array(at), pa.array(offset)], names=[*(f.name for f in keep), "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ``ids`` of the filled sequences, from packed pieces with their ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the CRC-32 of their ids, read back from the table that holds them, and their places."""
    stored = written(pieces(docs, tokenizer, capacity), "pieces")
    return pack(stored.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "slot"), capacity)
