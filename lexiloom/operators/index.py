"""The phrase index: chain counts, prefix counts, pruning, merging.

An index is the relation of word-complete prefixes ``text`` (each ends in a space) with their counts ``c``; pruning at a
cutoff keeps exactly the prefixes with a count of at least the cutoff, and their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import text as T
from lexiloom.operators import exact
from lexiloom.operators.frequent import Frequent


def checked_cutoff(cutoff: int) -> int:
    if isinstance(cutoff, bool) or not isinstance(cutoff, int) or cutoff <= 0:
        raise ValueError(f"the cutoff must be a whole number above 0, not {cutoff!r}")
    return cutoff


def chain_rows(lines: DataFrame, line_col: str = "line", weight: Column | None = None, window: int = T.WINDOW, *keep: str) -> DataFrame:
    """chain and n, its weight, of every chain of the lines, with the columns ``keep``; equal chains are not added up."""
    rows = lines.select(*keep, T.normalize(F.col(line_col)).alias("norm"), (F.lit(1) if weight is None else weight).cast("long").alias("n"))
    return rows.select(*keep, F.explode(T.chains("norm", window)).alias("chain"), "n")


def added(rows: DataFrame, *by: str) -> DataFrame:
    """chain and n, the sum over the rows of every chain, in every group of the columns ``by``.

    Nearly all chains of a corpus are different, so they go to their partitions as they are; those are many enough to add
    up in memory.
    """
    return rows.repartition(session.parts(rows), *by, "chain").groupBy(*by, "chain").agg(F.sum("n").alias("n"))


def chain_counts(lines: DataFrame, line_col: str = "line", weight: Column | None = None, window: int = T.WINDOW) -> DataFrame:
    """chain and n, the weighted count of every chain of the lines.

    Without weights only hashes of the chains that occur once are shuffled; those are counted now.
    """
    if weight is None and window == T.WINDOW:
        return exact.counts_of_lines(lines, line_col)
    return added(chain_rows(lines, line_col, weight, window))


def _flat_texts(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The first ``sizes`` bytes of rows of bytes as texts."""
    flat = rows[np.arange(rows.shape[1]) < sizes[:, None]]
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])


def _sorted_runs(batches: Iterator[pa.RecordBatch], cutoff: int) -> Iterator[pa.RecordBatch]:
    """g, text and c of the word-complete prefixes of rows (g, t, n) that are sorted by g and t.

    Rows with a prefix in common follow one another, so a prefix's count is the sum over a run, which may go on in the
    next batch.  Prefixes of more than one word go where they count less than the cutoff.
    """
    row, group, going = np.zeros(0, dtype=np.uint8), None, np.zeros(0, dtype=bool)
    open_c = np.zeros(0, dtype=np.int64)
    blank = 0x20

    def kept(texts: np.ndarray, ends: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (c >= cutoff) | (np.argmax(texts == blank, axis=1) == ends)

    def ended(at: np.ndarray) -> pa.RecordBatch:
        """The runs of the last row that end with it, by the places of their spaces."""
        texts = np.repeat(row[None], len(at), axis=0)
        some = kept(texts, at, open_c[at]) if len(at) else np.zeros(0, dtype=bool)
        return pa.RecordBatch.from_arrays([pa.array([group] * int(some.sum()), type=pa.string()), _flat_texts(texts[some], at[some] + 1), pa.array(open_c[at][some])], names=["g", "text", "c"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, t = batch.column(0), batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset : t.offset + n + 1]
        data = np.frombuffer(t.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        width = max(int(sizes.max()), len(row))
        # 255 is in no text.
        rows = np.full((n + 1, width), 255, dtype=np.uint8)
        rows[0, : len(row)] = row
        rows[1:][np.arange(width) < sizes[:, None]] = data
        same = rows[1:] == rows[:-1]
        shared = np.where(same.all(axis=1), width, same.argmin(axis=1))
        code = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        shared[1:][code[1:] != code[:-1]] = 0
        if g[0].as_py() != group:
            shared[0] = 0
        rows = rows[1:]
        spaces = rows == blank
        going = np.concatenate((going, np.zeros(width - len(going), dtype=bool)))
        goes_on = going & spaces[0] & (shared[0] > np.arange(width))
        yield ended(np.flatnonzero(going & ~goes_on))

        col, at = np.nonzero(spaces.T)
        first = np.flatnonzero((shared[at] <= col) | np.concatenate(([True], col[1:] != col[:-1])) if len(col) else np.zeros(0, dtype=bool))
        counts = batch.column(2).fill_null(0).to_numpy()
        c = np.add.reduceat(counts[at], first) if len(first) else np.zeros(0, dtype=np.int64)
        col, at, last = col[first], at[first], at[np.concatenate((first[1:], [len(at)])) - 1] if len(first) else at
        old = (at == 0) & goes_on[col]
        c[old] += open_c[col[old]]
        stays = last == n - 1
        row, group = rows[-1], g[n - 1].as_py()
        going, open_c = np.zeros(width, dtype=bool), np.zeros(width, dtype=np.int64)
        going[col[stays]], open_c[col[stays]] = True, c[stays]
        col, at, c = col[~stays], at[~stays], c[~stays]
        some = kept(rows[at], col, c) if len(at) else np.zeros(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([g.take(pa.array(at[some])), _flat_texts(rows[at[some]], col[some] + 1), pa.array(c[some])], names=["g", "text", "c"])
        row = row[row != 255]
        going, open_c = going[: len(row)], open_c[: len(row)]
    if len(row):
        yield ended(np.flatnonzero(going))


def _rolled_up(rows: DataFrame, cutoff: int) -> DataFrame:
    """g, text and c of the word-complete prefixes of rows (g, t, n) that occur ``cutoff`` times or more in a group g.

    The rows are shuffled once, to where their first two words are counted, and sorted there.  Of the prefixes of two words
    or more only the frequent ones go on; first words, which are few, meet those of other partitions.
    """
    session.attach(rows.sparkSession)
    rows = rows.filter(F.contains("t", F.lit(" "))).select(F.col("g").cast("string").alias("g"), "t", "n")
    met = rows.repartition(session.parts(rows), "g", F.substring_index("t", " ", 2)).sortWithinPartitions("g", "t")
    runs = met.mapInArrow(lambda batches: _sorted_runs(batches, cutoff), "g string, text string, c long")
    return runs.groupBy("g", "text").agg(F.sum("c").alias("c")).filter(F.col("c") >= cutoff)


def prefix_counts(counted: DataFrame, cutoff: int = 1, text_col: str = "chain", n_col: str = "n") -> DataFrame:
    """text and c of the word-complete prefixes that occur ``cutoff`` times or more.

    Counts never rise with a prefix's length, so the cutoff needs no back-off: what a longer phrase loses stays in its
    parent's count anyway.  Texts without a space have no such prefix and go.  Rows of equal texts add up.
    """
    checked_cutoff(cutoff)
    return _rolled_up(counted.select(F.lit("").alias("g"), F.col(text_col).alias("t"), F.col(n_col).cast("long").alias("n")), cutoff).drop("g")


def parent(text: Column) -> Column:
    """The prefix without its last word."""
    return F.regexp_replace(text, "[^ ]+ $", "")


def terminals(prefixes: DataFrame) -> DataFrame:
    """text and n, what a prefix's count has beyond its children's; texts without a rest go.

    A stored index has the parents; they are read, not made again.
    """
    up = F.col("parent") if "parent" in prefixes.columns else parent(F.col("text"))
    below = prefixes.groupBy(up.alias("text")).agg(F.sum("c").alias("below"))
    rest = F.col("c") - F.coalesce("below", F.lit(0))
    return prefixes.join(below, "text", "left").select("text", rest.alias("n")).filter("n > 0")


def corpus_total(prefixes: DataFrame) -> DataFrame:
    """One row: N, the sum of the counts of all first words."""
    return prefixes.filter(F.expr("instr(text, ' ') = length(text)")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_total"))


def _met_prefixes(chains: DataFrame, cutoff: int) -> DataFrame:
    """g, text and c of the prefixes of rows (g, t, n) of which all with the same first two words are in one partition."""
    return chains.sortWithinPartitions("g", "t").mapInArrow(lambda batches: _sorted_runs(batches, cutoff), "g string, text string, c long")


def stored_prefix_counts(counted: DataFrame, cutoff: int = 1, text_col: str = "chain", n_col: str = "n") -> DataFrame:
    """As ``prefix_counts`` of chains of up to WINDOW characters that are stored, so that reading them twice is cheap.

    Their first words, pairs and triples are counted now; of chains that begin with rare ones only what is frequent is shuffled.
    """
    chains = Frequent(counted, checked_cutoff(cutoff), text_col, F.col(n_col), chained=True).chains()
    runs = _met_prefixes(chains.select(F.lit("").alias("g"), "t", "n"), cutoff)
    return runs.groupBy("text").agg(F.sum("c").alias("c")).filter(F.col("c") >= cutoff)


def merge(shards: list[DataFrame], cutoff: int, text_col: str = "chain", n_col: str = "n", stored: bool = False) -> DataFrame:
    """Prefix counts over several shards of counted texts; equal texts add up.  With ``stored`` by ``stored_prefix_counts``."""
    if not shards:
        raise ValueError("at least one shard must be given")
    counts = stored_prefix_counts if stored else prefix_counts
    return counts(reduce(DataFrame.unionByName, [s.select(text_col, n_col) for s in shards]), cutoff, text_col, n_col)


def merge_two_stage(counted: DataFrame, group_col: str, first: int = 2, second: int = 5, text_col: str = "chain", n_col: str = "n") -> DataFrame:
    """Prefix counts pruned at ``first`` inside each group, added up over the groups and pruned at ``second``."""
    checked_cutoff(first)
    checked_cutoff(second)
    rows = counted.select(F.col(group_col).alias("g"), F.col(text_col).alias("t"), F.col(n_col).cast("long").alias("n"))
    grouped = _rolled_up(rows, first)
    return grouped.groupBy("text").agg(F.sum("c").alias("c")).filter(F.col("c") >= second)


#: Rows of prefixes that are added up over their groups at once.
RUNS_AT_ONCE = 1 << 21


def _over_groups(runs: Iterator[pa.RecordBatch], cutoff: int) -> Iterator[pa.RecordBatch]:
    """g, text and c of first words as they are; prefixes of two words or more, which are in this partition only, are added up over their groups, and rare ones go."""
    held, size = [], 0

    def added_up() -> pa.Table:
        return pa.Table.from_batches(held).group_by("text").aggregate([("c", "sum")]).rename_columns(["text", "c"])

    for run in runs:
        longer = pc.greater(pc.count_substring(run.column(1), " "), 1)
        yield run.filter(pc.invert(longer))
        held.append(run.filter(longer).select(["text", "c"]))
        size += held[-1].num_rows
        if size >= RUNS_AT_ONCE:
            held = added_up().combine_chunks().to_batches()
            size = 0
    if held:
        table = added_up()
        for batch in table.filter(pc.greater_equal(table["c"], cutoff)).to_batches():
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.string()), *batch.columns], names=["g", "text", "c"])


def merge_two_stage_lines(lines: DataFrame, group_col: str, first: int = 2, second: int = 5, line_col: str = "line") -> DataFrame:
    """As ``merge_two_stage`` of the chains of lines in groups; words and pairs of words are counted now, and chains of rare ones are not shuffled.

    What passes both cutoffs occurs at least as often as the larger one asks, over all groups.
    """
    least = max(checked_cutoff(first), checked_cutoff(second))
    chains = Frequent(lines, least, line_col).group_chains(lines, line_col, group_col)
    runs = chains.sortWithinPartitions("g", "t").mapInArrow(lambda batches: _over_groups(_sorted_runs(batches, first), second), "g string, text string, c long")
    longer = F.instr("text", " ") < F.length("text")
    grouped = runs.groupBy("g", "text").agg(F.sum("c").alias("c")).filter((F.col("c") >= first) | longer)
    return grouped.groupBy("text").agg(F.sum("c").alias("c")).filter(F.col("c") >= second)


def indexed(prefixes: DataFrame) -> DataFrame:
    """Prefix counts with what searches filter by: first character, words, letters, letter and telephone keys."""
    text = F.col("text")
    return prefixes.select(
        "text",
        "c",
        F.substring(text, 1, 1).alias("first_ch"),
        F.regexp_count(text, F.lit(" ")).alias("n_words"),
        F.length(F.replace(text, F.lit(" "), F.lit(""))).alias("n_letters"),
        parent(text).alias("parent"),
        T.letters_key(text).alias("letters_key"),
        T.phone_key(text).alias("phone_key"),
    )


#: Rounds in which the chains of a stored index are shuffled.
ROUNDS = 4


def _range_prefixes(chains: DataFrame, cutoff: int) -> DataFrame:
    """text and c of the prefixes of a range of chains, as ``Frequent.ranges`` gives it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _sorted_runs(batches, cutoff):
            g, text, c = runs.columns
            # Chains of a first word may be in several partitions; its count is in one.
            of_one = pc.or_(pc.equal(g, "w"), pc.greater(pc.count_substring(text, " "), 1))
            yield pa.RecordBatch.from_arrays([text, c], names=["text", "c"]).filter(pc.and_(of_one, pc.greater_equal(c, cutoff)))

    return chains.sortWithinPartitions("g", "t").mapInArrow(counted, "text string, c long")


def frequent_prefixes(lines: DataFrame, cutoff: int = 5, line_col: str = "line", weight: Column | None = None) -> DataFrame:
    """text and c of the word-complete prefixes of lines that occur ``cutoff`` times or more; a partition has a range of texts.

    As ``prefix_counts`` of all chains, but words and pairs are counted now, and chains of rare ones are not shuffled.
    """
    [chains] = Frequent(lines, checked_cutoff(cutoff), line_col, weight).ranges(1)
    return _range_prefixes(chains, cutoff)


def build_index(lines: DataFrame, cutoff: int = 5, line_col: str = "line", weight: Column | None = None) -> DataFrame:
    """The index of a corpus of lines; a partition has a range of texts."""
    return indexed(frequent_prefixes(lines, cutoff, line_col, weight))


def index_rounds(lines: DataFrame, cutoff: int = 5, line_col: str = "line", weight: Column | None = None, rounds: int = ROUNDS) -> list[DataFrame]:
    """``build_index`` in ranges of texts, to be stored one after the other: the lines are read for each, and each shuffles its chains only."""
    return [indexed(_range_prefixes(chains, cutoff)) for chains in Frequent(lines, checked_cutoff(cutoff), line_col, weight).ranges(rounds)]


def dump(prefixes: DataFrame) -> DataFrame:
    """line: every phrase with the count of its own, in order."""
    return terminals(prefixes).orderBy("text").select(F.format_string("%5d [%s]", F.col("n"), F.col("text")).alias("line"))


def explore(prefixes: DataFrame, path: str = "", depth: int | None = None) -> DataFrame:
    """prefix and c: along ``path`` character by character, then all below it down to ``depth``.

    Depth counts characters from the root and is the path's length by default; negative is without bound, 0 an error.
    Rows come parents first, children by falling count.  Counts are of the phrases themselves, not of the rest of a
    prefix count whose longer phrases were pruned.
    """
    if depth == 0:
        raise ValueError("invalid depth 0")
    depth = len(path) if depth is None else depth
    most = None if depth < 0 else depth
    # Terminals add up to the counts of the first words, and below a path only what begins like it is needed.
    total = corpus_total(prefixes).select(F.lit("").alias("prefix"), F.col("n_total").alias("c"), F.array().cast("array<struct<a:bigint,b:string>>").alias("place"))
    if most == 0:
        return total.select("prefix", "c")
    # Where the whole path does not occur, the part of it that does is shown.
    near = terminals(prefixes.filter(F.col("text").startswith(path[0])) if path else prefixes)
    if path:
        along = F.filter(T.char_prefixes("text", min(most, len(path)) if most else len(path)), lambda x: F.lit(path).startswith(x))
        below = F.when(F.col("text").startswith(path), F.filter(T.char_prefixes("text", most), lambda x: F.length(x) > len(path))).otherwise(F.array().cast("array<string>"))
        near = near.select(F.explode(F.concat(along, below)).alias("prefix"), "n")
    else:
        near = near.select(F.explode(T.char_prefixes("text", most)).alias("prefix"), "n")
    counts = near.groupBy("prefix").agg(F.sum("n").alias("c"))
    # The order needs the counts of all ancestors.
    ranked = counts.select("prefix", "c", F.posexplode(T.char_prefixes("prefix")).alias("i", "above"))
    up = ranked.join(counts.select(F.col("prefix").alias("above"), F.col("c").alias("above_c")), "above")
    placed = up.groupBy("prefix").agg(F.max("c").alias("c"), F.array_sort(F.collect_list(F.struct("i", (-F.col("above_c")).alias("a"), F.expr("right(above, 1)").alias("b")))).alias("place"))
    placed = placed.select("prefix", "c", F.transform("place", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("place"))
    return total.unionByName(placed).orderBy("place").select("prefix", "c")


def children(prefixes: DataFrame, prefix: str = "", least: str = " ", most: str = "z") -> DataFrame:
    """ch and c: the characters between ``least`` and ``most`` that follow ``prefix``."""
    n = len(prefix)
    # What takes from a text's count begins with it too, so the index is filtered first.
    rows = terminals(prefixes.filter(F.col("text").startswith(prefix)) if prefix else prefixes).filter(F.length("text") > n)
    return rows.groupBy(F.substring("text", n + 1, 1).alias("ch")).agg(F.sum("n").alias("c")).filter(F.col("ch").between(least, most))
