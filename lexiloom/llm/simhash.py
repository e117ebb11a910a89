"""SimHash near-duplicates with BK-trees.

1. A fingerprint per document, from the XXH64 of its word shingles (numpy, one pass over the texts).
2. Equal fingerprints collapse to one node, so exact copies cost nothing further.
3. Two fingerprints that differ in at most ``radius`` of 64 bits agree in one of radius + 1 bands of bits.  Each band
   value is a shard: its fingerprints form a BK-tree, whose children are keyed by their Hamming distance to the
   parent, and a search follows only edges within the radius of the query's distance.  A shard over a size bound is
   cut into slices (``links``).  The trees of all shards together grow with the corpus, so a tree is sent to the tasks
   that ask it and not to all.
4. A task returns a star per linked set, not its pairs; stars are joined to components with large-star and
   small-star steps on written tables.  Centres of large stars are joined by broadcast, at most a thousand of them.

Nothing about single documents reaches the driver.  Only band values over the size bound are broadcast, which are at
most ``MAX_HOT`` by the choice of the bound.

Defined results: null and empty texts have fingerprint zero and link like any others.  Rows of equal id are one
document: whatever their texts are linked to is linked.  A row with a null id gets the component of a row with an id
that has its fingerprint, else null.  An empty table gives an empty result; columns other than the id and the text are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import drop_written, join_by_key, prepare, spread, text_of, written

MAX_HOT, SHARD_ROWS = 65_536, 1024
#: Shards of a node at most, for the bound on hot shards.
MOST_SHARDS = 20
#: Words of the wide fingerprint, and MinHash bands and rows, of ``similar_documents``.
WIDE, MIN_BANDS, MIN_ROWS = 4, 20, 4
#: (query, node) pairs looked at together.
FRONTIER = 1 << 20
#: Pairs with one set that a salt of it gets.
PAIRS_OF_SALT = 1024


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set."""
    rows = -(-len(h) // 255)
    padded = np.zeros(rows * 255, dtype=np.uint64)
    padded[: len(h)] = h
    lanes = np.uint64(0x0101010101010101)
    out = np.empty((8, 8), dtype=np.int64)  # [byte, bit of the byte]
    for k in range(8):
        sums = ((padded >> np.uint64(k)) & lanes).reshape(rows, 255).sum(axis=1, dtype=np.uint64)
        out[:, k] = sums.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts), seed)] if parts else [], dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text, as a signed 64-bit integer."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    bits = (_bit_counts(h) * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp`` (long) of every row.  Narrow: no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, type=pa.int64())], names=[id_col, "fp"])

    return spread(docs.select(F.col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of many groups, built and searched level by level for all of them at once."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """``group`` is sorted; the first row of each group is the root of its tree.  ``fp`` is [rows, words]."""
        self.fp, self.far = fp, 64 * fp.shape[1]
        first = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=bool)
        self.roots = np.flatnonzero(first)
        self.root_group = group[self.roots]
        rest = np.flatnonzero(~first)
        parent = self.roots[np.cumsum(first)[rest] - 1]
        edges, kids = [], []
        while len(rest):
            key = parent * (self.far + 1) + distance(fp[rest], fp[parent])
            key, at, back = np.unique(key, return_index=True, return_inverse=True)
            edges.append(key)
            kids.append(rest[at])  # the first of those at this distance is the child, the others go below it
            child = rest[at][back]
            stay = child != rest
            rest, parent = rest[stay], child[stay]
        edge = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        order = np.argsort(edge, kind="stable")
        self.edge = edge[order]
        self.kid = np.concatenate(kids)[order] if kids else np.zeros(0, dtype=np.int64)

    def within(self, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) for all nodes within the radius, equal ones included."""
        row, node = np.arange(len(query)), root
        rows, nodes = [], []
        while len(row):
            d = distance(query[row], self.fp[node])
            near = d <= radius
            rows.append(row[near])
            nodes.append(node[near])
            low = np.searchsorted(self.edge, node * (self.far + 1) + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, node * (self.far + 1) + np.minimum(d + radius, self.far), side="right") - low
            row = np.repeat(row, n)
            node = self.kid[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.concatenate(rows) if rows else row, np.concatenate(nodes) if nodes else row


def least_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (an index of a smaller or the same row, each) after the rows ``a`` and ``b`` are linked."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        la, lb, a, b = la[differ], lb[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _stars(group: np.ndarray, fp: np.ndarray, node_id: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, smallest id linked to it in its group, group) of the rows that are not the smallest."""
    order = np.lexsort((node_id, group))
    group, fp, node_id, role = group[order], fp[order], node_id[order], role[order]
    label = np.arange(len(group))
    tree = np.flatnonzero(role != 1)
    forest = Forest(fp[tree], group[tree])
    if not len(tree):
        return node_id[:0], node_id[:0], group[:0]
    query = np.flatnonzero(role != 0)
    at = np.minimum(np.searchsorted(forest.root_group, group[query]), len(forest.root_group) - 1)
    has = forest.root_group[at] == group[query]
    query, at = query[has], at[has]
    sizes = np.diff(np.append(forest.roots, len(tree)))[at]
    cut = np.searchsorted(np.cumsum(sizes), np.arange(FRONTIER, sizes.sum() + FRONTIER, FRONTIER), side="right")
    start = 0
    for end in np.maximum(cut, 1).tolist():
        if end > start:
            row, node = forest.within(fp[query[start:end]], forest.roots[at[start:end]], radius)
            label = least_labels(label, query[start:end][row], tree[node])
            start = end
    if start < len(query):
        row, node = forest.within(fp[query[start:]], forest.roots[at[start:]], radius)
        label = least_labels(label, query[start:][row], tree[node])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return node_id[moved], node_id[label[moved]], group[moved]


def bands(radius: int) -> Column:
    """Shards of column ``fp``: one for each of radius + 1 bands of nearly equal width over its 64 bits.

    Fingerprints that differ in at most ``radius`` bits agree in a band, so no link is lost.
    """
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    part = lambda i, lo, hi: F.lit(i << 40).cast("long") + F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1)
    return F.array(*[part(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _searched(rows: DataFrame, words: tuple[str, ...], radius: int) -> DataFrame:
    """Stars (shard, ``a``, ``b``), b < a, of the links in each group (shard, i, j) of ``rows``.

    A group's rows of role 0 make its tree, those of role 1 ask it, and those of role 2 do both.
    """
    dealt = rows.select("shard", "i", "j", "low", "role", *words).repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            shard, i, j, low, role, *fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            fp = np.stack(fp, axis=1).view(np.uint64)
            new = np.concatenate(([True], (shard[1:] != shard[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            group = np.cumsum(new) - 1
            more = np.bincount(group)[group] > 1
            a, b, of = _stars(group[more], fp[more], low[more], role[more], radius)
            return pa.RecordBatch.from_arrays([pa.array(shard[new][of]), pa.array(a), pa.array(b)], names=["shard", "a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            # The last group may go on in the next batch.
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))
            if cut == 0 and held and all(held[-1][x][-1] == cols[x][-1] for x in range(3)):
                held.append(cols)
                continue
            held.append([c[:cut] for c in cols])
            if sum(len(x[0]) for x in held):
                yield flush(held)
            held = [[c[cut:] for c in cols]]
        if held and sum(len(x[0]) for x in held):
            yield flush(held)

    return dealt.mapInArrow(run, "shard long, a long, b long")


def links(nodes: DataFrame, total: int, radius: int = 2, shard_rows: int = SHARD_ROWS, words: tuple[str, ...] = ("fp",), shards: Column | None = None) -> DataFrame:
    """Stars (``a``, ``b``), b < a, that join all nodes with a link inside a shard.

    ``nodes`` has an id ``low`` and the ``words`` of a fingerprint; ``shards`` is an array of each node's shards, the
    bands of its only word by default.

    A shard over the size bound goes in slices.  First each slice asks one node of the shard, its pivot: near copies are
    linked to it and through it to each other.  Then those that are far from it make trees, in slices too, and every
    slice of the shard asks each of them, so no link is lost and near copies are not compared among themselves.
    """
    shards = bands(radius) if shards is None else shards
    rows = nodes.select(*words, "low", F.explode(shards).alias("shard"))
    limit = max(shard_rows, -(-MOST_SHARDS * total // MAX_HOT))
    hot = written(rows.groupBy("shard").count().filter(F.col("count") > limit).select("shard", F.ceil(F.col("count") / limit).cast("long").alias("k")), "hot")
    searched = lambda some: _searched(some, words, radius)
    placed = lambda some, i, j, role: some.withColumns({"i": F.lit(i) if isinstance(i, int) else i, "j": F.lit(j) if isinstance(j, int) else j, "role": F.lit(role)})
    found = searched(placed(rows.join(F.broadcast(hot), "shard", "left_anti"), 0, 0, 2)).select("a", "b")
    if hot.isEmpty():
        return found.distinct()
    large = written(rows.join(F.broadcast(hot), "shard").withColumn("s", F.pmod(F.xxhash64("low"), F.col("k")).cast("int")), "large")
    node = F.struct("low", *words)
    pivot = written(large.groupBy("shard").agg(F.min_by(node, "low").alias("p"), F.first("k").alias("k")).select("shard", "k", "p.*"), "pivots")
    slices = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    asked = placed(pivot.withColumn("s", slices("k")), F.col("s"), 0, 0)
    askers = placed(large.join(F.broadcast(pivot.select("shard", F.col("low").alias("pivot"))), "shard").filter("low <> pivot").drop("pivot"), F.col("s"), 0, 1)
    near = written(searched(asked.unionByName(askers)), "near")
    linked = near.select("shard", F.col("a").alias("low")).union(near.select("shard", F.col("b").alias("low"))).union(pivot.select("shard", "low")).distinct()
    far = written(large.join(linked, ["shard", "low"], "left_anti"), "far")
    many = F.broadcast(far.groupBy("shard").agg(F.ceil(F.count("*") / limit).cast("long").alias("m")))
    trees = far.join(many, "shard").withColumn("t", slices("k"))
    trees = placed(trees, F.pmod(F.xxhash64("low", F.lit(1)), F.col("m")).cast("int"), F.col("t"), 0)
    askers = placed(large.join(many, "shard").withColumn("t", slices("m")), F.col("t"), F.col("s"), 1)
    rest = searched(trees.unionByName(askers)).select("a", "b")
    return found.unionByName(near.select("a", "b")).unionByName(rest).distinct()


def least_of_component(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``a``, ``root``): the smallest id of the component of every id in ``edges`` (a, b) but the roots.

    Each round is one large-star and one small-star step; the number of rounds grows with the logarithm of the
    longest path.  Every step is written to the shared folder, so no plan grows and a lost executor costs one step.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = sign(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_by_key(both.filter("b > a"), least, ["a"], "n", 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        small = written(small, "small")
        for old in (least, large, edges):
            drop_written(old)
        edges, after = small, sign(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select("a", F.col("b").alias("root"))


def links_of_ids(rows: DataFrame, nodes: DataFrame, key: str, total: int) -> DataFrame:
    """(``a``, ``b``): an id whose rows (low, key) have several keys, and the id of each of their nodes (key, low)."""
    several = rows.filter("low is not null").groupBy("low").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n")).filter("least <> most")
    several = written(several.select("low", "n"), "several")
    mine = join_by_key(rows, several, ["low"], "n", total).select(F.col("low").alias("a"), key).distinct()
    return mine.join(nodes.select(key, F.col("low").alias("b")), key).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, ``fingerprint`` (hex) and ``component_id`` (the smallest id reachable over links) of every row."""
    marks = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = written(marks.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "nodes")
    total, rows = nodes.agg(F.count("*"), F.sum("n")).first()
    found = links(nodes.filter("low is not null"), total or 0, radius, shard_rows)
    same = links_of_ids(marks.select(F.col(id_col).alias("low"), "fp"), nodes, "fp", rows or 0)
    roots = least_of_component(found.unionByName(same))
    named = nodes.join(roots.withColumnRenamed("a", "low"), "low", "left").select("fp", "n", F.coalesce("root", "low").alias("component_id"))
    out = join_by_key(marks, named, ["fp"], "n", rows or 0)
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    """Other 64-bit values, as good as independent, made from hashes."""
    z = h + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_sketch(text: str, words: int = 5) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(SimHash of WIDE words over the distinct shingles, the keys of MIN_BANDS MinHash bands, both signed 64-bit; the set's digest)."""
    h = np.unique(shingle_hashes(text, words))
    mark = hashlib.md5(h.tobytes(), usedforsecurity=False).digest()
    if not len(h):
        return np.zeros(WIDE, dtype=np.int64), np.arange(MIN_BANDS, dtype=np.int64), mark
    bits = [(_bit_counts(_mixed(h, j)) * 2 > len(h)).astype(np.uint8) for j in range(1, WIDE + 1)]
    odd = (np.arange(1, MIN_BANDS * MIN_ROWS + 1, dtype=np.uint64) * np.uint64(2 * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF) + np.uint64(1))[:, None]
    mixed = h ^ (h >> np.uint64(31))
    parts = [(mixed[i : i + 2048] * odd).min(axis=1) for i in range(0, len(mixed), 2048)]
    least = np.minimum.reduce(parts).reshape(MIN_BANDS, MIN_ROWS)
    key = np.arange(MIN_BANDS, dtype=np.uint64)
    for r in range(MIN_ROWS):
        key = _mixed(key ^ least[:, r], r + 1)
    return np.packbits(np.concatenate(bits), bitorder="little").view("<i8"), key.view(np.int64), mark


@lru_cache
def candidate_radius(similarity: float, bits: int = 64 * WIDE) -> int:
    """Four standard deviations over the bits that sets of at least this similarity differ in, small sets included."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    over = lambda n, least: sum(math.comb(n, k) for k in range(max(least, 0), n + 1)) / 2**n
    for common in range(1, 33):
        for more in range(math.floor(common * (1 - similarity) / similarity + 1e-9) + 1):
            for a in range(more // 2 + 1):
                b, differ = more - a, 0.0
                for x in range(common + 1):
                    one, other = (over(n, (common + n) // 2 + 1 - x) for n in (a, b))
                    differ += math.comb(common, x) / 2**common * (one * (1 - other) + other * (1 - one))
                share = max(share, differ)
    return math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, low, ``n`` and the sorted distinct shingle hashes ``hs`` of each row (node, low, root, text).

    The hashes are mixed with the root, so that only texts of one component of candidates have any in common.  A node
    is 64 bits of the set's digest; sets that agree in them are still told apart by their size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = batch.column(2).to_numpy().astype(np.int64).view(np.uint64)
            sets = [np.sort(_mixed(np.unique(shingle_hashes(t, words)) ^ _mixed(r, 1), 1)).view(np.int64) for r, t in zip(roots[:, None], batch.column(3).to_pylist(), strict=True)]
            n = np.array([len(x) for x in sets], dtype=np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            hs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), hs], names=["node", "low", "n", "hs"])

    return texts.select("node", "low", F.col("root").cast("long"), "text").mapInArrow(run, "node long, low long, n long, hs array<bigint>")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """Postings (h, node, n, own, pos): the hashes among the rarest of each set that another set has too; ``own`` no other has.

    Two sets of the Jaccard similarity have a hash in common among the first n - ceil(similarity n) + 1 of each, in any
    order that is the same for both.  Here the rarest come first, so what thousands of texts share is not among them,
    unless a text has little else.  Hashes of a single set come before all others and need no row.
    """
    tokens = sets.select("node", "n", F.explode("hs").alias("h"))
    counts = written(tokens.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    total = sets.agg(F.sum("n")).first()[0]
    common = join_by_key(tokens, counts, ["h"], "c", total or 0)
    ranked = common.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("s"))
    own = F.col("n") - F.size("s")
    lead = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - own
    first = ranked.withColumn("own", own).withColumn("s", F.slice("s", F.lit(1), F.greatest(lead, F.lit(0)).cast("int")))
    return first.select("node", "n", "own", F.posexplode("s").alias("i", "t")).select(F.col("t.h").alias("h"), "node", "n", "own", (F.col("own") + F.col("i")).alias("pos"))


def _may_be_similar(n: Column, pos: Column, other_n: Column, other_pos: Column, similarity: float) -> Column:
    """Whether two sets whose first common hash is at these places can have the similarity, by length and by what is left."""
    needed = (n + other_n) * (similarity / (1 + similarity)) - 1e-9
    return (F.least(n, other_n) >= F.greatest(n, other_n) * similarity - 1e-9) & (F.least(n - pos, other_n - other_pos) >= needed)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets have the similarity, with the ids ``low_a`` and ``low_b``.

    A node that is in many pairs as ``b`` is salted: each of its salts gets the set once and PAIRS_OF_SALT pairs.
    """
    weights = written(pairs.groupBy("b").agg(F.count("*").alias("w")), "weights")
    total = weights.agg(F.sum("w")).first()[0]
    salts = F.ceil(F.col("w") / PAIRS_OF_SALT)
    dealt = join_by_key(pairs, weights, ["b"], "w", total or 0).select("a", "b", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    one = dealt.join(sets.select(F.col("node").alias("a"), F.col("low").alias("low_a"), F.col("n").alias("n_a"), F.col("hs").alias("hs_a")), "a")
    other = sets.join(weights.withColumnRenamed("b", "node"), "node").select(F.col("node").alias("b"), F.col("low").alias("low_b"), F.col("n").alias("n_b"), F.col("hs").alias("hs_b"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    both = F.size(F.array_intersect("hs_a", "hs_b"))
    met = one.join(other, ["b", "salt"]).select("a", "b", "low_a", "low_b", both.alias("both"), (F.col("n_a") + F.col("n_b")).alias("sum"))
    return met.filter(F.col("both") >= F.lit(similarity) * (F.col("sum") - F.col("both"))).select("a", "b", "low_a", "low_b")


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ids (``a``, ``b``) of a Jaccard similarity or more that join all sets which such pairs join.

    First each set meets one pivot: of the postings' pivots that may be similar to it the one with the fewest hashes of its
    own.  A group's other texts are that one with changes, each nearer to it than to each other; so that joins near copies.
    Of each posting with several components then only the rows outside its pivot's component meet
    the others, and only those of other components.  So a group of near copies costs a pair a row, not its square.
    """
    postings = written(prefixes(sets, similarity), "postings")
    pivots = written(postings.groupBy("h").agg(F.min(F.struct("own", "node", "n", "pos")).alias("p"), F.count("*").alias("g")).filter("g > 1"), "pivots")
    total = postings.count()
    asked = join_by_key(postings, pivots, ["h"], "g", total).filter(F.col("node") != F.col("p.node"))
    asked = asked.filter(_may_be_similar(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), similarity))
    first = written(asked.groupBy(F.col("node").alias("a")).agg(F.min_by("p.node", F.struct("p.own", "p.node")).alias("b")), "pairs")
    near = written(similar_pairs(first, sets, similarity), "near")
    labels = least_of_component(near.select("a", "b")).select(F.col("a").alias("node"), "root")
    labelled = written(postings.join(labels, "node", "left").select("h", "node", "n", "own", "pos", F.coalesce("root", "node").alias("label")), "labelled")
    mixed = labelled.groupBy("h").agg(F.min_by("label", F.struct("own", "node")).alias("pl"), F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("g")).filter("least <> most")
    rest = written(join_by_key(labelled, written(mixed.select("h", "pl", "g"), "mixed"), ["h"], "g", total).drop("g"), "rest")
    x, y = rest.filter("label <> pl").alias("x"), rest.alias("y")
    c = F.col
    differ = (c("x.h") == c("y.h")) & (c("x.label") != c("y.label")) & ((c("y.label") == c("y.pl")) | (c("x.node") > c("y.node")))
    met = x.join(y, differ & _may_be_similar(c("x.n"), c("x.pos"), c("y.n"), c("y.pos"), similarity))
    second = written(met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), "pairs")
    found = similar_pairs(second, sets, similarity)
    return near.unionByName(found).select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 4 * SHARD_ROWS) -> DataFrame:
    """id and ``component_id`` of every row, linking texts of a Jaccard ``similarity`` or more in their distinct word shingles.

    At 0.8 fingerprints lie too far apart for bands of their bits.  Here the shards are MinHash bands, of which texts
    that similar share one but for 3 in 100,000, and the BK-tree of a shard finds candidates by wide fingerprints.  Within
    each component of candidates an exact join on the rarest shingles (``similar_links``) links those of the similarity.
    Nulls, empty texts and repeated ids are as in ``near_duplicates``.
    """
    prepare(docs.sparkSession)
    names = [f"f{i}" for i in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_sketch(t, words) for t in batch.column(1).to_pylist()]
            fp = np.array([x[0] for x in found], dtype=np.int64).reshape(-1, WIDE)
            keys = np.array([x[1] for x in found], dtype=np.int64).reshape(-1, MIN_BANDS)
            mark = [x[2] for x in found]
            shards = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, MIN_BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark, type=pa.binary()), shards, *(pa.array(fp[:, i]) for i in range(WIDE)), batch.column(1)], names=[id_col, "mark", "shards", *names, "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, mark binary, shards array<bigint>, " + ", ".join(f"{n} long" for n in names) + ", text string"
    sketches = written(spread(docs.select(F.col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, schema), "sketches")
    nodes = written(sketches.groupBy("mark").agg(F.min(id_col).alias("low"), F.count("*").alias("n"), F.first("shards").alias("shards"), *[F.first(n).alias(n) for n in names]), "nodes")
    total, rows = nodes.agg(F.count("*"), F.sum("n")).first()
    radius = candidate_radius(similarity)
    near = least_of_component(links(nodes.filter("low is not null"), total or 0, radius, shard_rows, tuple(names), F.col("shards")))
    near = written(near.unionByName(near.select(F.col("root").alias("a"), "root").distinct()), "candidates")
    # A row of each node; the texts of candidates only.
    chosen = nodes.select("mark", F.col("low").alias("a")).join(near, "a").hint("shuffle_hash")
    texts = sketches.select("mark", F.col(id_col).alias("a"), "text").join(chosen, ["mark", "a"]).dropDuplicates(["mark", "a"])
    sets = written(shingle_sets(texts.select(F.xxhash64("mark").alias("node"), F.col("a").alias("low"), "root", "text"), words), "sets")
    found = similar_links(sets, similarity)
    roots = least_of_component(found.unionByName(links_of_ids(sketches.select(F.col(id_col).alias("low"), "mark"), nodes, "mark", rows or 0)))
    named = nodes.join(roots.withColumnRenamed("a", "low"), "low", "left").select("mark", "n", F.coalesce("root", "low").alias("component_id"))
    return join_by_key(sketches.select(id_col, "mark"), named, ["mark"], "n", rows or 0).select(id_col, "component_id")
