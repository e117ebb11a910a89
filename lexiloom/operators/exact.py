"""Exact counts of all chains, with little to shuffle.

Nearly all chains of a corpus occur once.  So chains are first told apart by hashes of ``KEY_BITS``, which are all that is
shuffled of them, and those hashes that occur more than once set bits of a filter of ``FILTER_BITS``.  A chain whose bit is
not set occurs once and is a result where it is read; the others, among them a few that only share a bit, are shuffled as
compressed packs and added up.  The filter decides how much is shuffled, never what is counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import text as T
from lexiloom.operators import frequent as Q

#: Bits of the hash of a chain; least number of ranges of hashes, as a power of 2, each of which is sorted by itself.
KEY_BITS, LEAST_RANGES = 40, 8


class Block(NamedTuple):
    """Chains as places in bytes, with their counts and the numbers of their groups."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    n: np.ndarray
    codes: np.ndarray

    def keys(self, marks: list[int]) -> np.ndarray:
        h = Q._hashes(self.data, self.starts, self.ends) * Q._WORD if len(self.starts) else np.zeros(0, dtype=np.uint64)
        return Q._mixed(h + np.array(marks, dtype=np.uint64)[self.codes]) >> np.uint64(64 - KEY_BITS)

    def of(self, some: np.ndarray) -> Block:
        return Block(self.data, self.starts[some], self.ends[some], self.n[some], self.codes[some])

    def texts(self) -> pa.Array:
        sizes = self.ends - self.starts
        to = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        flat = self.data[np.repeat(self.starts - to[:-1], sizes) + np.arange(to[-1])]
        return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(flat.tobytes())])

    def rows(self) -> np.ndarray:
        """Rows of WINDOW bytes, 0 after the text."""
        width = np.arange(T.WINDOW)
        rows = np.concatenate((self.data, np.zeros(T.WINDOW, dtype=np.uint8)))
        rows = np.lib.stride_tricks.sliding_window_view(rows, T.WINDOW)[self.starts]
        return np.where(width < (self.ends - self.starts)[:, None], rows, 0).astype(np.uint8)


class Groups:
    """Numbers of the groups that a task has met; without a column of groups all is in one."""

    def __init__(self) -> None:
        self.names: list[str | None] = []
        self.marks: list[int] = []
        self.known: dict[str | None, int] = {}

    def number(self, name: str | None) -> int:
        if name not in self.known:
            self.known[name] = len(self.names)
            self.names.append(name)
            self.marks.append(0 if name is None else int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big"))
        return self.known[name]

    def numbers(self, column: pa.Array | None, count: int) -> np.ndarray:
        if column is None:
            return np.full(count, self.number(None))
        found = column.dictionary_encode(null_encoding="encode")
        return np.array([self.number(x) for x in found.dictionary.to_pylist()], dtype=np.int64)[found.indices.to_numpy(zero_copy_only=False)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)), offsets


def _chains(data: np.ndarray, line_ends: np.ndarray, codes: np.ndarray) -> Block:
    """All chains of lines, as ``text.chains`` has them."""
    data, line_of = Q.normalized(data, line_ends)
    stops = np.flatnonzero(data == 0x20)
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    line = line_of[stops]
    end = stops[np.searchsorted(line, line, side="right") - 1] + 1
    count = -(-(stops - starts) // T.WINDOW)
    if (count > 1).any():
        # A word of more than WINDOW characters starts anew after every WINDOW of them.
        again = np.repeat(np.arange(len(count)), count)
        starts = starts[again] + T.WINDOW * (np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count))
        end, line = end[again], line[again]
    return Block(data, starts, np.minimum(starts + T.WINDOW, end), np.ones(len(starts), dtype=np.int64), codes[line])


def of_lines(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[Block]:
    """The chains of batches (line) or (line, g), some lines at a time."""
    for batch in batches:
        data, offsets = _bytes_of(batch.column(0))
        codes = groups.numbers(batch.column(1) if batch.num_columns > 1 else None, batch.num_rows)
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(offsets, offsets[at] + Q.BYTES_AT_ONCE, side="right")) - 1, at + 1)
            yield _chains(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], codes[at:to])
            at = to


def of_rows(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[Block]:
    """The chains of batches (chain, n) or (chain, n, g)."""
    for batch in batches:
        if batch.num_rows:
            data, offsets = _bytes_of(batch.column(0))
            codes = groups.numbers(batch.column(2) if batch.num_columns > 2 else None, batch.num_rows)
            yield Block(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0], batch.column(1).to_numpy(), codes)


Read = Callable[[Iterator[pa.RecordBatch], Groups], Iterator[Block]]


def _hash_packs(batches: Iterator[pa.RecordBatch], read: Read, bits: int) -> Iterator[pa.RecordBatch]:
    """Packs of the keys of every range of keys, repeats included."""
    groups, held, size = Groups(), [], 0

    def packs() -> pa.RecordBatch:
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        cuts = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
        some = [p for p in range(1 << bits) if cuts[p] < cuts[p + 1]]
        return Q._packed(some, [int(cuts[p + 1] - cuts[p]) for p in some], [Q._planes(np.diff(keys[cuts[p] : cuts[p + 1]], prepend=np.uint64(0))) for p in some])

    for block in read(batches, groups):
        held.append(block.keys(groups.marks))
        size += len(held[-1])
        if size >= Q.KEYS_AT_ONCE:
            yield packs()
            size = 0
    if size:
        yield packs()


def _repeated_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The filter's bits of keys that occur more than once, a slice for every range; packs come range by range."""
    width = (1 << Q.FILTER_BITS) >> bits

    def slice_of(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys.sort()
        at = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(KEY_BITS - Q.FILTER_BITS)).astype(np.int64) - part * width
        found = np.zeros(width, dtype=np.uint8)
        found[at] = 1
        return Q._packed([part], [width // 8], [np.packbits(found, bitorder="little").tobytes()])

    last, held = None, []
    for part, count, raw in Q._unpacked(batches):
        if part != last and held:
            yield slice_of(last, held)
            held = []
        last = part
        held.append(np.cumsum(Q._numbers(raw, count)).astype(np.uint64))
    if held:
        yield slice_of(last, held)


def _repeats(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(KEY_BITS - Q.FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _once(batches: Iterator[pa.RecordBatch], read: Read, slices: list) -> Iterator[pa.RecordBatch]:
    """g, chain and n of the chains that occur once."""
    bits, groups = Q._all_bits(slices), Groups()
    for block in read(batches, groups):
        own = block.of(np.flatnonzero(~_repeats(bits, block.keys(groups.marks))))
        yield pa.RecordBatch.from_arrays([pa.array(groups.names, pa.string()).take(pa.array(own.codes)), own.texts(), pa.array(own.n)], names=["g", "chain", "n"])


def _repeat_packs(batches: Iterator[pa.RecordBatch], read: Read, slices: list, parts: int) -> Iterator[pa.RecordBatch]:
    """Packs of the other chains, added up, by their hash."""
    bits, groups = Q._all_bits(slices), Groups()
    held: list[tuple[np.ndarray, ...]] = []
    for block in read(batches, groups):
        keys = block.keys(groups.marks)
        some = np.flatnonzero(_repeats(bits, keys))
        own = block.of(some)
        held.append((own.rows(), (keys[some] % np.uint64(parts)).astype(np.int32), own.n, own.codes))
        if sum(len(x[0]) for x in held) >= Q.CHAINS_AT_ONCE:
            yield Q.group_packs(held, parts, groups.names)
    if held:
        yield Q.group_packs(held, parts, groups.names)


def added_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, chain and n, the sum over the rows (g, t, n) of equal g and t, which follow one another."""
    names, held = ["g", "chain", "n"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, pa.RecordBatch.from_arrays(batch.columns, names=names)]).combine_chunks().to_batches()[0]
        g, t, n = batch.columns
        code = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        same = pc.equal(t.slice(1), t.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False) & (code[1:] == code[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        some = pa.array(first)
        out = pa.RecordBatch.from_arrays([g.take(some), t.take(some), pa.array(np.add.reduceat(n.to_numpy(), first))], names=names)
        yield out.slice(0, len(first) - 1)
        held = out.slice(len(first) - 1)
    if held is not None:
        yield held


def _counts(rows: DataFrame, read: Read) -> DataFrame:
    spark = rows.sparkSession
    session.attach(spark)
    parts = session.parts(rows)
    bits = max(LEAST_RANGES, (parts - 1).bit_length())
    with session.shuffles_dropped(spark):
        keys = rows.mapInArrow(partial(_hash_packs, read=read, bits=bits), Q._PACK).repartitionById(parts, F.expr(f"cast((part * {parts}L) >> {bits} as int)")).sortWithinPartitions("part")
        slices = [(r.part, r["count"], bytes(r.pack)) for r in keys.mapInArrow(partial(_repeated_bits, bits=bits), Q._PACK).collect()]
    sent, few = spark.sparkContext.broadcast(slices), max(parts // Q.FEWER, min(parts, spark.sparkContext.defaultParallelism))
    once = rows.mapInArrow(lambda b: _once(b, read, sent.value), "g string, chain string, n long")
    packs = rows.mapInArrow(lambda b: _repeat_packs(b, read, sent.value, few), Q._PACK).repartitionById(few, "part")
    met = packs.mapInArrow(Q.group_texts, "g string, t string, n long").sortWithinPartitions("g", "t")
    return once.unionByName(met.mapInArrow(added_runs, "g string, chain string, n long"))


def counts_of_lines(lines: DataFrame, line_col: str = "line", by: str | None = None) -> DataFrame:
    """chain and n, how often every chain of the lines occurs, in every group of the column ``by``; the hashes are counted now."""
    line = F.coalesce(F.col(line_col), F.lit("")).alias("line")
    out = _counts(lines.select(line, *([] if by is None else [F.col(by).cast("string").alias("g")])), of_lines)
    return out.select("chain", "n") if by is None else out.select(F.col("g").alias(by), "chain", "n")


def counts_of_rows(rows: DataFrame) -> DataFrame:
    """chain and n, the sum over the rows (chain, n) of every chain of up to WINDOW characters, as ``counts_of_lines`` gives them."""
    return _counts(rows.select("chain", "n"), of_rows).select("chain", "n")
