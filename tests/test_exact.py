"""Counts of all chains of which only hashes and repeats are shuffled, against plain models."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_index import LINES, model_chains, norm, prefixes

from lexiloom.operators import exact as E
from lexiloom.operators import frequent as Q
from lexiloom.operators import index as I

WORDS = ["a", "the", "of", "it's", "x" * 39, "y" * 40, "z" * 41, "w" * 81, "é"]


def corpus(seed, count):
    rng = random.Random(seed)
    return LINES + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(count)]


def counted(lines):
    return Counter(c for x in lines for c in model_chains(norm(x)))


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_chains_of_groups_in_packs_of_any_size(monkeypatch, most):
    plain = corpus(1, 80)
    groups = ["g", None, "", "é"]
    rows = pa.table({"line": [x or "" for x in plain], "g": [groups[i % 4] for i in range(len(plain))]})
    for name in ("KEYS_AT_ONCE", "CHAINS_AT_ONCE", "BYTES_AT_ONCE"):
        monkeypatch.setattr(Q, name, most)
    batches = lambda: iter(rows.to_batches(7))
    packs = pa.Table.from_batches(list(E._hash_packs(batches(), E.of_lines, 3))).sort_by("part")
    slices = [(x["part"], x["count"], x["pack"]) for b in E._repeated_bits(iter(packs.to_batches(5)), 3) for x in b.to_pylist()]
    want = Counter((g, c) for x, g in rows.select(["line", "g"]).to_pandas().replace({float("nan"): None}).itertuples(index=False) for c in model_chains(norm(x)))
    once = [((x["g"], x["chain"]), x["n"]) for b in E._once(batches(), E.of_lines, slices) for x in b.to_pylist()]
    assert len(dict(once)) == len(once) and dict(once).items() <= {k: n for k, n in want.items() if n == 1}.items()
    met = list(Q.group_texts(E._repeat_packs(batches(), E.of_lines, slices, 3)))
    met = pa.Table.from_batches(met).sort_by([("g", "ascending"), ("t", "ascending")])
    for size in (1, 2, 1000):
        runs = [((x["g"], x["chain"]), x["n"]) for b in E.added_runs(iter(met.to_batches(size))) for x in b.to_pylist()]
        assert len(dict(runs)) == len(runs) and dict(runs) | dict(once) == want and len(runs) + len(once) == len(want)


def test_chains_that_share_a_bit_are_counted_apart(monkeypatch):
    """All chains have one key, so all go to the packs, and none is mixed up with another."""
    plain = corpus(2, 40)
    monkeypatch.setattr(E.Block, "keys", lambda self, marks: np.zeros(len(self.starts), dtype=np.uint64))
    rows = pa.table({"line": [x or "" for x in plain]})
    packs = list(E._hash_packs(iter(rows.to_batches()), E.of_lines, 2))
    slices = [(x["part"], x["count"], x["pack"]) for b in E._repeated_bits(iter(packs), 2) for x in b.to_pylist()]
    met = pa.Table.from_batches(list(Q.group_texts(E._repeat_packs(iter(rows.to_batches()), E.of_lines, slices, 2)))).sort_by("t")
    assert {x["chain"]: x["n"] for b in E.added_runs(iter(met.to_batches())) for x in b.to_pylist()} == counted(plain)


def test_chain_counts_shuffle_hashes_and_repeats_only(spark):
    plain = [f"w{i % 7} x{i} y{i} z{i} the end" for i in range(3000)] + corpus(3, 100)
    df = spark.createDataFrame([(x,) for x in plain], "line string").repartition(3).persist()
    df.count()
    got = I.chain_counts(df)
    place = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    size = lambda: sum(x.stat().st_size for x in place.rglob("shuffle_*.data"))
    before = size()
    rows = got.collect()
    # Every chain in a shuffle takes more than 20 bytes.
    assert len(rows) == len({r.chain for r in rows}) and {r.chain: r.n for r in rows} == counted(plain)
    assert size() - before < 4 * len(rows)
    df.unpersist()


def test_chain_counts_of_weights_and_windows(spark):
    df = spark.createDataFrame([("a b a", 2), ("a b", None), ("c", None)], "line string, w long")
    assert {r.chain: r.n for r in I.chain_counts(df, weight=F.col("w")).collect()} == {"a b a ": 2, "b a ": 2, "a ": 2, "a b ": None, "b ": None, "c ": None}
    assert {r.chain: r.n for r in I.chain_counts(df, window=2).collect()} == {"a ": 3, "b ": 2, "c ": 1}
    assert I.chain_counts(df.limit(0)).count() == 0


def test_streamed_batches_add_up(spark, tmp_path):
    """A batch is stored as its counts, compressed, and shuffles no chains that occur once; a batch more is added to it."""
    from lexiloom.streaming.incremental import current_counts, stream_counts

    source, counts = tmp_path / "lines", (tmp_path / "counts").as_uri()
    source.mkdir()
    place = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    left = lambda: {x.name for x in place.rglob("shuffle_*.data")}
    plain, before = [], left()
    for i in range(3):
        new = [x for x in corpus(i, 60) if x and "\n" not in x and "\0" not in x]
        (source / f"{i}.txt").write_text("\n".join(new) + "\n")
        plain += new
        lines = spark.readStream.text(source.as_uri()).withColumnRenamed("value", "line")
        stream_counts(lines, counts, (tmp_path / "progress").as_uri()).awaitTermination()
        assert left() <= before
        got = current_counts(spark, counts)
        assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (i > 0)
        rows = got.collect()
        assert len(rows) == len({r.chain for r in rows}) and {r.chain: r.n for r in rows} == counted(plain)
        before |= left()
    files = list((tmp_path / "counts").rglob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_stored_chains_merge_as_all_chains_do(spark):
    """Chains of any table: the pairs after the first are no chains of it, and counts may be taken away or missing."""
    rng = random.Random(8)
    rows = [("".join(rng.choice(["a ", "b ", "the ", "x" * 12 + " ", "c"]) for _ in range(rng.randint(0, 5)))[:40], rng.choice([1, 1, 2, 9, -2, None])) for _ in range(2000)]
    rows += [(f"r{i} s{i} t ", 1) for i in range(500)] + [(f"w s{i} t ", 1) for i in range(500)] + [(None, 3), ("", 2)]
    df = spark.createDataFrame(rows, "chain string, n long")
    for cutoff in (1, 5, 60):
        want = {(r.text, r.c) for r in I.merge([df, df.limit(0)], cutoff).collect()}
        got = I.merge([df, df.limit(0)], cutoff, stored=True)
        assert sorted((r.text, r.c) for r in got.collect()) == sorted(want)
    with pytest.raises(Exception, match="at most 40"):
        I.merge([df.select(F.repeat(F.lit("a "), 21).alias("chain"), "n")], 5, stored=True).collect()
    rows = spark.createDataFrame([("a b c d ", 1), ("a b c e ", 1), ("a b d e ", 1)], "chain string, n long")
    assert {r.t for r in Q.Frequent(rows, 2, "chain", F.col("n"), chained=True).chains().collect()} == {"a b c d ", "a b c e ", "a b "}
    sent = {r.t for r in Q.Frequent(df, 5, "chain", F.col("n"), chained=True).chains().collect()}
    assert "w " in sent and not any(t.startswith(("r", "w s")) for t in sent)


def test_stored_shards_take_little_place(spark, tmp_path):
    """Stored by group without a shuffle of the chains that occur once, and compressed."""
    from lexiloom.sources import readers as R

    plain = [f"w{i % 7} x{i} y{i} z{i} the end" for i in range(500)]
    df = spark.createDataFrame([(x, f"g{i % 3}") for i, x in enumerate(plain)], "line string, g string")
    path = tmp_path / "shards"
    R.save_shards(E.counts_of_lines(df, "line", "g"), path.as_uri(), "g")
    for k in range(3):
        assert {r.chain: r.n for r in R.read_shards(spark, f"{path.as_uri()}/shard=g{k}").collect()} == counted(plain[k::3])
    files = list(path.rglob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


def test_two_stages_over_lines_shuffle_no_rare_chains(monkeypatch):
    """Prefixes pruned in their groups and added up over them, from packs of chains without the rare ones."""
    groups = ["g", None, "", "é"]
    plain = corpus(6, 200) + [f"w x{i} y{i} the end" for i in range(100)]
    rows = pa.table({"line": [x or "" for x in plain], "n": pa.array([1] * len(plain), pa.int64()), "g": [groups[i % 4] for i in range(len(plain))]})
    monkeypatch.setattr(I, "RUNS_AT_ONCE", 20)
    monkeypatch.setattr(Q, "CHAINS_AT_ONCE", 100)
    batches = lambda: iter(rows.to_batches(70))
    of_group = Counter((groups[i % 4], p) for i, x in enumerate(plain) for c in model_chains(norm(x)) for p in prefixes(c))
    for first, second in ((2, 5), (7, 3), (3, 40)):
        want = Counter()
        for (_, p), n in of_group.items():
            want[p] += n if n >= first else 0
        slices = [(x["part"], x["count"], x["pack"]) for b in Q._bit_slices(Q._key_packs(batches(), 4), max(first, second), 4) for x in b.to_pylist()]
        sent = pa.Table.from_batches(list(Q.group_texts(Q._group_packs(batches(), slices, 1)))).sort_by([("g", "ascending"), ("t", "ascending")])
        assert not any("x1 " in t or t.startswith("y") for t in sent["t"].to_pylist())
        runs = [x for b in I._over_groups(I._sorted_runs(iter(sent.to_batches(30)), first), second) for x in b.to_pylist()]
        longer = {x["text"]: x["c"] for x in runs if x["text"].count(" ") > 1}
        assert longer == {p: n for p, n in want.items() if n >= second and p.count(" ") > 1} and longer
        words = Counter()
        for (_, p), n in Counter({(x["g"], x["text"]): 0 for x in runs}).items():
            c = sum(x["c"] for x in runs if (x["g"], x["text"]) == (_, p))
            words[p] += c if p.count(" ") == 1 and c >= first else 0
        assert {p: n for p, n in words.items() if n >= second} == {p: n for p, n in want.items() if n >= second and p.count(" ") == 1}


def test_tables_of_unknown_size_have_the_usual_partitions(spark):
    """Also where columns were taken from them."""
    from lexiloom import session

    df = spark.createDataFrame(spark.sparkContext.parallelize([("a", "b", 1)]), "x string, y string, n long")
    assert session.parts(df) == session.parts(df.select("x")) == session.parts(df.select("n")) == 4
