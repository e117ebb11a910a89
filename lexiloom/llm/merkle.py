"""Merkle manifest of a dataset by higher-order SQL over blocks.

A row's digest is a leaf.  The leaves of a group in their order are cut into blocks of ``2 ** BITS``; a block is one row
with an ordered array, and ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse all its levels at once.  The
roots of blocks are the leaves of the next round, until a group has one block; the roots of groups, in the order of their
keys, are the leaves of the same climb once more.  The way down hands each block the path above it, so a row's path comes
from blocks alone and no join meets a group's rows: every key is a block.

Positions come from a range sort: a partition's rows are numbered in order, and the counts of the partitions before are
added.  Rows that are equal in everything can stand for each other, and a stored number of the row spreads them over
partitions however many there are.

Every round is a table in the shared folder.  The driver sees one number a round, the most blocks of a group.

Defined results: a null field is ``-``, an empty text ``0:``, texts are hashed whole whatever their length; rows with a
null key come first in their group, rows that repeat a key are ordered by their leaf; a null group is the first one; an
empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import drop_written, spread, written

#: Levels that a block has; its leaves are at most 2 ** BITS.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: ``-`` for null, else its number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the path of its siblings (left, digest) lead to; a level without a sibling has a null digest."""
    side = lambda x, left: F.when(x["left"] if left else ~x["left"], F.coalesce(x["digest"], F.lit(""))).otherwise(F.lit(""))
    return F.aggregate(path, start, lambda acc, x: digest(side(x, True), acc, side(x, False)))


def proof(path: Column) -> Column:
    """The digest of a path's siblings."""
    return F.sha2(F.array_join(F.transform(path, lambda x: x["digest"]), ""), 256)


def numbered(rows: DataFrame, by: list[str], group: str, name: str) -> DataFrame:
    """The ``rows``, a written table, with ``pos`` (from 0) in their group, in the order ``by``, and the group's size ``n``."""
    ordered = written(rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by).withColumn("at", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy(group, "part").agg(F.min("at").alias("low"), F.count("*").alias("m"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "part", "low", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(whole).alias("n"))
    return ordered.join(counts, [group, "part"]).withColumn("pos", F.col("at") - F.col("low") + F.col("base")).drop("at", "part", "low", "base")


def _collapsed(node: Column, height: Column) -> Column:
    """All levels over an array of nodes, the nodes first: each holds the digests of two neighbours, or of the last alone."""
    kind = "array<array<string>>"
    up = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: F.sha2(F.array_join(F.slice(a, 2 * i + 1, 2), ""), 256))
    steps = F.slice(F.sequence(F.lit(1), F.lit(BITS)), F.lit(1), height)
    return F.aggregate(steps, F.array(node).cast(kind), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))).cast(kind))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """A row for each block of nodes (g, pos, n, node, held): its members in order, its levels and its root."""
    height = F.when(F.col("n") > 1 << BITS, BITS).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    rows = nodes.groupBy("g", F.shiftright("pos", BITS).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "held"))).alias("members"))
    rows = rows.withColumn("height", height).withColumn("levels", _collapsed(F.transform("members", lambda m: m["node"]), F.col("height")))
    return written(rows.withColumn("top", F.element_at(F.element_at("levels", -1), 1)).withColumn("n_blocks", F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS)), name)


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of every round; a group's last block is that with n_blocks = 1."""
    rounds = [_blocks(nodes, name)]
    while (rounds[-1].agg(F.max("n_blocks")).first()[0] or 0) > 1:
        over = rounds[-1].filter("n_blocks > 1").select("g", F.col("block").alias("pos"), F.col("n_blocks").alias("n"), F.col("top").alias("node"), F.struct("block").alias("held"))
        rounds.append(_blocks(over, name))
    return rounds


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """g, held, node, path, subroot and root of the first round's members; ``tops`` has (g, above, root) of every group."""

    def members(blocks: DataFrame) -> DataFrame:
        at = lambda m, j: F.call_function("shiftright", (m["pos"] % (1 << BITS)).cast("int"), j)
        steps = F.slice(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(1), F.col("height"))
        sibling = lambda m: F.transform(steps, lambda j: F.struct((at(m, j) % 2 == 1).alias("left"), F.get(F.get("levels", j), at(m, j).bitwiseXOR(F.lit(1))).alias("digest")))
        each = F.explode(F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["node"].alias("node"), m["held"].alias("held"), sibling(m).alias("path"))))
        rows = blocks.select("g", "subroot", "root", "above", each.alias("m"))
        return rows.select("g", "m.pos", "m.node", "m.held", F.concat("m.path", "above").alias("path"), "subroot", "root")

    lower = None
    for blocks in reversed(rounds):
        last = blocks.filter("n_blocks <= 1").join(tops, "g").withColumn("subroot", F.col("top"))
        if lower is not None:
            over = lower.select("g", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
            last = last.unionByName(blocks.filter("n_blocks > 1").join(over, ["g", "block"]))
        lower = members(last)
    return lower


def manifest(leaves: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """node, subroot, root and path of every row of ``leaves``, with the columns ``keep`` of it.

    ``leaves`` has ``g`` (the group, not null), ``k`` (the order in it) and ``node`` (the leaf's digest).  ``path`` lists,
    upwards from the leaf, (left, digest): whether the sibling stands to the left, and its digest, null where a run is one.
    """
    stored = written(leaves.select("g", "k", "node", *keep).withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    nodes = numbered(stored, ["k", "node", "row"], "g", "ordered")
    rounds = _climb(nodes.select("g", "pos", "n", "node", F.struct(F.col("k").alias("k"), *keep).alias("held")), "blocks")
    drop_written(stored)
    subroots = written(_groups(rounds), "subroots")
    above = _climb(numbered(subroots, ["k"], "g", "groups").select("g", "pos", "n", "node", F.struct("k").alias("held")), "groupblocks")
    none = F.array().cast("array<struct<left:boolean,digest:string>>")
    roots = above[-1].filter("n_blocks <= 1").select("g", none.alias("above"), F.col("top").alias("root"))
    tops = written(_descend(above, roots).select(F.col("held.k").alias("g"), F.col("path").alias("above"), "root"), "tops")
    return _descend(rounds, tops).select("held.*", "node", "subroot", "root", "path")


def _groups(rounds: list[DataFrame]) -> DataFrame:
    """The root of every group as a node of one group more, in the order of their keys."""
    some = [r.filter("n_blocks <= 1").select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("top").alias("node")) for r in rounds]
    out = some[0]
    for x in some[1:]:
        out = out.union(x)
    return out


def group_key(value: Column) -> Column:
    """A group's name as a text that is never null; null comes first and the others are in the order of their bytes."""
    return F.coalesce(F.concat(F.lit(":"), value), F.lit("-"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` by language, in the order of ids, and ``tampered``: the leaf after an attack on some rows.

    The attack adds one to n_chars where 7 divides the CRC-32 of the id in decimal; rows with a null id stay.
    """
    rows = spread(docs.select(*FIELDS))
    whole = leaf(*[F.col(c) for c in FIELDS])
    changed = leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = rows.select(group_key(F.col("lang")).alias("g"), F.col("doc_id").alias("k"), whole.alias("node"), F.when(hit & F.col("n_chars").isNotNull(), changed).alias("changed"))
    return rows.select("g", "k", "node", F.coalesce("changed", "node").alias("tampered"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the digest of the path, and the root that the tampered leaf leads to."""
    rows = manifest(document_leaves(docs), ("tampered",))
    rows = rows.select(F.col("k").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
