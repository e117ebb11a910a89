"""Exact deduplication over an extendible-hash index on shared files; DataFrame operations only.

Keys.  One pass writes the key of every row (id, 64-bit hash, SHA-256 of the text for the result) without the text.

Directory.  Hashes are counted by their lowest ``MAX_DEPTH`` bits, which gives at most 2 ** MAX_DEPTH numbers
whatever the table's size; only these reach the driver.  There the directory grows from one bucket: an overfull bucket
splits on its next bit, and the directory doubles when that bucket is as deep as the directory.  A bucket that cannot
split further keeps a longer chain.

Buckets.  Owner tasks each have a range of buckets, and write one entry for every hash in them: the hash, how many rows
have it, and the row that is asked first, that of the largest id.  A hash of one row needs nothing else.

Chains.  The texts of the other hashes meet their entry's text, byte by byte.  Rows that are equal get the entry; rows
that collide with it, the same hash over other bytes, go on to the next place of the chain, whose entry is the largest
of them, until every row has its entry.  The entries with the number of their rows are the index; each place is a table
in the shared folder, in bucket order.

Probe.  Every row finds its bucket through the directory and its entry by hash and place in the chain; what it is told
there, the id that stays and how many are equal, is the result.

Copies.  A hash with more than a thousandth of the rows meets its entry by broadcast (there are at most a thousand such
hashes, and entries have no text), and its texts meet the entry's text in parts, each with a copy of that text.

Defined results: null text counts as empty; the largest id of equal texts stays, nulls last; rows that repeat an id
and a text are one document, kept or dropped together; in a group with only null ids all rows stay.  An empty
table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import HOT_SHARE, join_by_key, text_of, written

MAX_DEPTH, CAPACITY, PLACES = 16, 1024, 100_000


@dataclass
class Directory:
    """Extendible hashing over cells, the lowest MAX_DEPTH hash bits: ``buckets`` has (depth, bits) -> keys."""

    depth: int
    buckets: dict[tuple[int, int], int]

    @classmethod
    def grown(cls, cells: dict[int, int], capacity: int) -> Directory:
        out = cls(0, {(0, 0): sum(cells.values())})
        inside = {(0, 0): sorted(cells)}
        todo = [(0, 0)]
        while todo:
            depth, bits = full = todo.pop()
            if out.buckets[full] <= capacity or depth == MAX_DEPTH:
                continue
            if depth == out.depth:
                out.depth += 1  # the directory doubles: two pointers to every other bucket
            del out.buckets[full]
            held = inside.pop(full)
            for half in (bits, bits | 1 << depth):
                inside[depth + 1, half] = [c for c in held if c & ((1 << depth + 1) - 1) == half]
                out.buckets[depth + 1, half] = sum(cells[c] for c in inside[depth + 1, half])
                todo.append((depth + 1, half))
        return out

    def pointers(self) -> list[int]:
        """The bucket of each of the 2 ** depth directory cells, numbered in the order of their bits from the lowest."""
        order = sorted(self.buckets, key=lambda b: int(f"{b[1]:0{MAX_DEPTH}b}"[::-1], 2))
        out = [0] * (1 << self.depth)
        for number, (depth, bits) in enumerate(order):
            for cell in range(bits, 1 << self.depth, 1 << depth):
                out[cell] = number
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """cell -> bucket; at most 2 ** MAX_DEPTH rows, which is why it may be broadcast."""
        pointers = self.pointers()
        rows = spark.range(1).select(F.lit(",".join(map(str, pointers))).alias("p"))
        return rows.select(F.posexplode(F.split("p", ",")).alias("cell", "bucket")).select("cell", F.col("bucket").cast("int").alias("bucket"))


def directory_of(found: DataFrame, capacity: int) -> Directory:
    """The directory over all rows of ``found`` (h, ...)."""
    cells = {r.cell: r["count"] for r in found.groupBy(F.col("h").bitwiseAND((1 << MAX_DEPTH) - 1).cast("int").alias("cell")).count().collect()}
    # At most about 2 ** (MAX_DEPTH - 2) full buckets, however many hashes there are.
    return Directory.grown(cells, max(capacity, -(-sum(cells.values()) // (1 << (MAX_DEPTH - 2)))))


def located(rows: DataFrame, directory: Directory) -> DataFrame:
    """``rows`` with the bucket of their hash."""
    cell = F.col("h").bitwiseAND((1 << directory.depth) - 1).cast("int")
    return rows.withColumn("cell", cell).join(F.broadcast(directory.table(rows.sparkSession)), "cell").drop("cell")


def _hashes(keys: DataFrame) -> DataFrame:
    """h, first (id and digest of the row that is asked first) and n of every hash."""
    return keys.groupBy("h").agg(F.max(F.struct("id", "sha")).alias("first"), F.count("*").alias("n"))


def _entries(found: DataFrame, directory: Directory, place: int) -> DataFrame:
    """One entry a hash, written by the owners of bucket ranges: bucket, h, place, first, n."""
    dealt = located(found, directory).withColumn("place", F.lit(place))
    return written(dealt.repartitionByRange("bucket").sortWithinPartitions("bucket", "h"), f"bucket-{place}")


def _parts(n: Column, total: int) -> Column:
    """In how many parts the rows of a hash meet their entry's text."""
    return F.ceil(n / F.lit(max(1, total // HOT_SHARE))).cast("int")


def _compared(members: DataFrame, total: int) -> DataFrame:
    """``members`` (id, h, sha, t, first, n) with ``same``: whether the bytes are those of their entry's text."""
    mine = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha"))
    texts = members.filter(mine).select("h", F.col("t").alias("held"), "n").dropDuplicates(["h"])
    texts = texts.select("h", "held", F.explode(F.sequence(F.lit(0), _parts(F.col("n"), total) - 1)).alias("part"))
    dealt = members.withColumn("part", F.pmod(F.monotonically_increasing_id(), _parts(F.col("n"), total).cast("long")).cast("int"))
    return dealt.join(texts, ["h", "part"]).select("id", "h", "sha", "t", (F.col("t") == F.col("held")).alias("same"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[str], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, Directory, int]:
    """(rows with their place, index, directory, number of rows): (id, h, sha, place) and (bucket, h, place, keep_id, group_size)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).withColumn("h", hash_of("t"))
    keys = written(rows.select("id", "h", F.sha2("t", 256).alias("sha")), "keys")
    found = written(_hashes(keys), "hashes")
    directory = directory_of(found, capacity)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entry = _entries(found, directory, 1)
    alone = entry.filter("n = 1")
    index = [alone.select("bucket", "h", "place", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"))]
    # A row of a hash of its own needs no text.
    placed = [join_by_key(keys, alone.select("h", "n"), ["h"], "n", total).select("id", "h", "sha", F.lit(1).alias("place"))]
    pending = rows.withColumn("sha", F.sha2("t", 256))
    for place in range(1, PLACES):
        more = entry.filter("n > 1") if place == 1 else entry
        members = written(join_by_key(pending, more.select("h", "first", "n"), ["h"], "n", total).select("id", "h", "sha", "t", "first", "n"), "members")
        compared = written(_compared(members, total), "compared")
        same = compared.filter("same")
        sizes = same.groupBy("h").agg(F.count("*").alias("group_size"))
        index.append(more.join(sizes, "h").select("bucket", "h", "place", F.col("first.id").alias("keep_id"), "group_size"))
        placed.append(same.select("id", "h", "sha", F.lit(place).alias("place")))
        pending = compared.filter(~F.col("same")).select("id", "h", "sha", "t")
        if pending.isEmpty():
            break
        entry = _entries(_hashes(pending), directory, place + 1)
    else:
        raise RuntimeError("a chain does not end")
    out_index, out_placed = index[0], placed[0]
    for more in index[1:]:
        out_index = out_index.unionByName(more)
    for more in placed[1:]:
        out_placed = out_placed.unionByName(more)
    return out_placed, written(out_index, "index"), directory, total


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row."""
    placed, index, directory, total = build_index(docs, id_col, text_col, capacity, hash_of)
    out = join_by_key(located(placed, directory), index, ["bucket", "h", "place"], "group_size", total)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
