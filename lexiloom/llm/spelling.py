"""Spelling variants by full neighbourhood generation.

1. Words and their counts come from all texts; counting combines on the map side, so a word that holds a third of all
   rows is one row from each task.
2. Every word of the vocabulary emits each text that is one deletion, one replacement or one insertion away, over the
   alphabet that the vocabulary has, each once: of equal neighbours a deletion takes the last character of a run, and an
   insertion goes in front of a run of its character, never behind it.
3. A neighbour that is itself a word is a near word; the join is on equal texts, so no distance is computed.

A word has about 2 x length x alphabet neighbours, of which few are words.  So that the others are neither built nor
shuffled, a neighbour is first a polynomial hash, which follows from the word's by one term, and is looked up in a bitmap
of the vocabulary's hashes that every task has; what passes is built and joined exactly.  The bitmap has 64 bits a word
up to ``MOST_BITS`` bits, 64 MB; a larger vocabulary lets more neighbours through to the join and loses none.

Defined results: null texts have no words; a null id counts as an empty one in the hash that decides what is deleted;
a text may have any length; rows that repeat count again; words of equal n are ordered by code points; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import drop_written, prepare, spread, written

#: Code points and occurrences that a word has at least, how many times as frequent a form is, one in how many runs loses
#: a code point, and the characters of a run (fixed values).
LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP, LETTERS = 6, 5, 5, 199, "A-Za-zÀ-ÿ"
#: Bits of the bitmap, as a power of two: at least and at most.  Each word sets PROBES of them.
LEAST_BITS, MOST_BITS, PROBES = 16, 29, 3
#: Neighbours that are hashed together, and words of a task.
BLOCK, TASK_WORDS = 1 << 20, 4096
#: Bits of one native bitmap (fixed value).
BUCKET = 32768


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` (the id as text) and ``run``, with A-Z lower-cased, of every maximal run of letters long enough to matter."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = spread(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col))).select("key", F.explode(found).alias("run"))
    lowered = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    return rows.select("key", F.when(F.col("run").rlike("[A-Z]"), lowered).otherwise(F.col("run")).alias("run"))


def slipped(rows: DataFrame) -> DataFrame:
    """``word``: the run, without one code point where SLIP divides the CRC-32 of ``key:run``."""
    marked = rows.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return marked.select(F.when(F.col("h") % SLIP == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def alphabet(words: DataFrame) -> list[str]:
    """The characters of the words; there are at most as many as a run can have."""
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1))))
    return sorted(r[0] for r in words.select(each.alias("ch")).distinct().collect())


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: The hash of a text is the sum of VALUE[character] * POWER ** place, modulo 2 ** 64; characters are below 256.
POWER = 0x9E3779B97F4A7C15
VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(POWER))


class Ragged:
    """The characters of several words, one after another, with what their hashes are made from."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.code = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.place = np.arange(len(self.code)) - self.start[self.word]
        self.power = np.concatenate((np.ones(1, dtype=np.uint64), np.full(int(self.size.max(initial=0)) + 1, POWER, dtype=np.uint64))).cumprod(dtype=np.uint64)
        self.term = VALUE[self.code] * self.power[self.place]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), self.term.cumsum(dtype=np.uint64)))
        self.total = sums[self.start + self.size] - sums[self.start]
        #: Of each character the sum of those before it in its word.
        self.before = sums[:-1] - sums[self.start][self.word]


def probed(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit that a hash has in the bitmap."""
    return (_mixed(h + np.uint64(probe)) >> np.uint64(64 - bits)).astype(np.int64)


class Neighbours:
    """Neighbours over an alphabet whose hashes are all in the bitmap."""

    def __init__(self, letters: str, bitmap: np.ndarray, bits: int):
        self.letters = np.frombuffer(letters.encode("latin-1"), dtype=np.uint8)
        self.bitmap, self.bits = bitmap, bits

    def _in(self, h: np.ndarray, probe: int) -> np.ndarray:
        at = probed(h, probe, self.bits)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def _held(self, base: np.ndarray, power: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, letter) where ``base`` + letter * ``power`` is in the bitmap and the letter is not the row's ``other``."""
        value, step = VALUE[self.letters], max(1, BLOCK // max(1, len(self.letters)))
        for i in range(0, len(base), step):
            h = base[i : i + step, None] + power[i : i + step, None] * value
            row, letter = np.nonzero(self._in(h, 0) & (other[i : i + step, None] != self.letters))
            h = h[row, letter]
            for probe in range(1, PROBES):
                stay = self._in(h, probe)
                row, letter, h = row[stay], letter[stay], h[stay]
            yield row + i, self.letters[letter]

    def __call__(self, words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """(numbers of words, a neighbour of each)."""
        r = Ragged(words)
        p, inverse = np.uint64(POWER), np.uint64(pow(POWER, -1, 1 << 64))
        after = r.total[r.word] - r.before - r.term
        # Deletions, by a letter of value 0.
        last = np.append((r.code[1:] != r.code[:-1]) | (r.word[1:] != r.word[:-1]), True)[: len(r.code)]
        h = r.before + after * inverse
        at = np.flatnonzero(last)
        for probe in range(PROBES):
            at = at[self._in(h[at], probe)]
        yield r.word[at].tolist(), [words[w][:i] + words[w][i + 1 :] for w, i in zip(r.word[at].tolist(), r.place[at].tolist(), strict=True)]
        for row, letter in self._held(r.before + after, r.power[r.place], r.code):
            of, place, new = r.word[row].tolist(), r.place[row].tolist(), map(chr, letter.tolist())
            yield of, [words[w][:i] + a + words[w][i + 1 :] for w, i, a in zip(of, place, new, strict=True)]
        # In front of each character, and at the end; the letter before is not inserted again.
        ends = r.start + r.size
        gap = np.insert(np.arange(len(r.code)), ends, -1)
        word = np.insert(r.word, ends, np.arange(len(words)))
        place = np.where(gap < 0, r.size[word], r.place[gap])
        before = np.where(gap < 0, r.total[word], r.before[gap])
        previous = np.where(place > 0, r.code[np.maximum(r.start[word] + place - 1, 0)].astype(np.int64), -1)
        for row, letter in self._held(before + (r.total[word] - before) * p, r.power[place], previous):
            of, new = word[row].tolist(), map(chr, letter.tolist())
            yield of, [words[w][:i] + a + words[w][i:] for w, i, a in zip(of, place[row].tolist(), new, strict=True)]


def bitmap_of(words: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the hashes of ``words``: 2 ** bits bits, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = Ragged(batch.column(0).to_pylist()).total
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([probed(h, k, bits) for k in range(PROBES)]))], names=["bit"])

    rows = words.select("word").mapInArrow(run, "bit long")
    held = rows.groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("bytes"))
    out = np.zeros(max(1 << bits, BUCKET) // 8, dtype=np.uint8)
    for bucket, part in held.toLocalIterator():
        out[bucket * BUCKET // 8 :][: len(part)] = np.frombuffer(part, dtype=np.uint8)
    return out


def near_words(words: DataFrame, total: int) -> DataFrame:
    """word, n_near and ``best``, the near word of largest n (the first of them) with its n, of the words that have one."""
    spark = words.sparkSession
    prepare(spark)
    bits = min(max((64 * total).bit_length(), LEAST_BITS), MOST_BITS)
    letters, bitmap = "".join(alphabet(words)), spark.sparkContext.broadcast(bitmap_of(words, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(letters, bitmap.value, bits)
        for batch in batches:
            given = batch.column(0).to_pylist()
            for of, found in near(given):
                yield pa.RecordBatch.from_arrays([pa.array([given[i] for i in of], type=pa.string()), pa.array(found, type=pa.string())], names=["from", "word"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_WORDS))
    emitted = words.select("word").repartition(tasks).mapInArrow(run, "`from` string, word string")
    near = emitted.join(words, "word").groupBy("from").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("best"))
    return near.select(F.col("from").alias("word"), "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form (word, form): where their forms lead to.

    Forms are at least TIMES as frequent, so paths are short; every round halves what is left of them.
    """
    rows = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = rows.select(F.col("word").alias("root"), F.col("root").alias("over"))
        further = written(rows.join(up, "root", "left").select("word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")), "roots")
        drop_written(rows)
        rows = further.select("word", "root")
        rows._lexiloom_folder = further._lexiloom_folder
        if further.filter("moved").isEmpty():
            return rows


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of a vocabulary (word, n)."""
    words = written(words, "vocabulary")
    near = near_words(words, words.count())
    good = F.col("best_n") >= TIMES * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    named = written(named, "forms")
    ended = roots(named.filter("form IS NOT NULL"))
    return named.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` with their forms."""
    return variants(vocabulary(slipped(runs(docs))))
