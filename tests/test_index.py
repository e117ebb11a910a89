"""Normalisation, chains, counts, pruning and inspection against small plain models."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import frequent as Q
from lexiloom.operators import index as I
from lexiloom.sources import readers as R

LINES = ["I'm Jack's", "Fleur-de-lis", "", "!!!", "  -- lead", "café ’tis K İx", "a" * 39, "b" * 40, "c" * 41 + " d", "e" * 80, "f" * 81 + " g", "The quick brown fox jumps over the lazy dog again and again", "x\0y z", None]


def norm(line):
    out = ""
    for ch in (line or "").split("\0")[0] + "\n":
        if ch.isascii() and ch.isalnum():
            out += ch.lower()
        elif ch != "'" and out and not out.endswith(" "):
            out += " "
    return out


def model_chains(t):
    out, i, fresh = [], 0, True
    starts = []
    for i, ch in enumerate(t):
        if ch != " " and (i == 0 or t[i - 1] == " "):
            end = t.find(" ", i) if " " in t[i:] else len(t)
            starts += range(i, end, 40)
    return [t[s : s + 40] for s in starts]


def prefixes(t):
    return [t[: i + 1] for i, ch in enumerate(t) if ch == " "]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(4)
    extra = [" ".join(rng.choice(["a", "bc", "the", "of", "x" * 45, "d" * 40]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    return spark.createDataFrame([(x,) for x in LINES + extra], "line string"), LINES + extra


def test_normalize(spark, lines):
    df, plain = lines
    got = [r[0] for r in df.select(T.normalize(F.col("line"))).collect()]
    assert got == [norm(x) for x in plain]


def test_chains_and_prefix_counts(lines):
    df, plain = lines
    want = Counter(c for x in plain for c in model_chains(norm(x)))
    counted = I.chain_counts(df).persist()
    assert {r.chain: r.n for r in counted.collect()} == want
    up = Counter()
    for c, n in want.items():
        for p in prefixes(c):
            up[p] += n
    assert {r.text: r.c for r in I.prefix_counts(counted, 3).collect()} == {p: n for p, n in up.items() if n >= 3}


def roll_up(counts, cutoff):
    """Leaf first: a phrase stays with enough of its own or with a longer one below it that stays; else its count goes up."""
    total, kept = Counter(), {}
    for t, n in counts.items():
        p = t[: t.rfind(" ") + 1]
        if p:
            total[p] += n
    nodes = {p for t in total for p in prefixes(t)}
    for t in sorted(nodes, key=lambda p: -p.count(" ")):
        n = total[t]
        if n >= cutoff or n > 0 and any(k.startswith(t) for k in kept):
            kept[t] = n
        else:
            up = t[: t[:-1].rfind(" ") + 1]
            if up:
                total[up] += n
    return kept


def test_pruning_is_the_roll_up(spark):
    rng = random.Random(9)
    for _ in range(6):
        counts = Counter()
        for _ in range(60):
            counts["".join(rng.choice(["a ", "b ", "c"]) for _ in range(rng.randint(1, 4)))] += rng.randint(1, 3)
        df = spark.createDataFrame(list(counts.items()), "chain string, n long")
        cutoff = rng.randint(1, 6)
        got = {r.text: r.n for r in I.terminals(I.prefix_counts(df, cutoff)).collect()}
        assert got == {t: n for t, n in roll_up(counts, cutoff).items() if n}


def test_two_stages_differ_from_one(spark):
    rows = [("g1", "a b ", 1), ("g2", "a b ", 1), ("g3", "a b ", 4), ("g1", "c ", 3), ("g2", "c ", 2), ("g1", "lost", 9)]
    df = spark.createDataFrame(rows, "g string, chain string, n long")
    assert {r.text: r.c for r in I.merge_two_stage(df, "g", 2, 5).collect()} == {"c ": 5}
    assert {r.text: r.c for r in I.merge([df.drop("g")], 5).collect()} == {"a ": 6, "a b ": 6, "c ": 5}


@pytest.mark.parametrize("cutoff", [0, -1, "x", True, 2.5])
def test_cutoff_is_checked(spark, cutoff):
    with pytest.raises(ValueError):
        I.prefix_counts(spark.createDataFrame([], "chain string, n long"), cutoff)
    with pytest.raises(ValueError):
        I.merge([], 5)


def test_inspection(spark):
    df = spark.createDataFrame([("the ", 7), ("the cat ", 3), ("to ", 2), ("a ", 1)], "text string, c long")
    assert [r[0] for r in I.dump(df).collect()] == ["    1 [a ]", "    4 [the ]", "    3 [the cat ]", "    2 [to ]"]
    assert [tuple(r) for r in I.explore(df, "t", 2).collect()] == [("", 10), ("t", 9), ("th", 7), ("to", 2)]
    assert [tuple(r) for r in I.explore(df, "").collect()] == [("", 10)]
    assert [tuple(r) for r in I.explore(df, "tx", 2).collect()] == [("", 10), ("t", 9)]
    assert len(I.explore(df, "", -1).collect()) == 1 + len({t[:i] for t in ("the ", "the cat ", "to ", "a ") for i in range(1, len(t) + 1)})
    with pytest.raises(ValueError):
        I.explore(df, "t", 0)
    assert {r.ch: r.c for r in I.children(df, "t", "a", "i").collect()} == {"h": 7}
    assert I.corpus_total(df).first()[0] == 10


def test_framing(spark):
    text = ["BEGIN ARTICLE: One", "body", "END ARTICLE: One", "<doc id=1>", "Two", "more", "</doc>", "<doc id=2>", "</doc>", "x", "<doc id=3>", "", "y", "<doc 4>", "END ARTICLE: z", "Late", "<doc 5>", "<doc 6>", "Six"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no int, line string")
    got = [(r.line, r.is_title, r.weight) for r in R.frame_articles(df).orderBy("line_no").collect()]
    assert got == [(" One", True, 10), ("body", False, 1), ("Two", True, 10), ("more", False, 1), ("</doc>", True, 10), ("x", False, 1), ("", True, 10), ("y", False, 1), ("Late", True, 10), ("Six", True, 10)]


def test_framing_in_blocks_of_files(spark, tmp_path):
    """Files cut into many blocks frame as whole ones do."""
    rng = random.Random(11)
    kinds = ["BEGIN ARTICLE: t", "END ARTICLE: t", "<doc 1>", "</doc>", "", "some words here", "x"]
    want = []
    for name in ("a.txt", "b.txt"):
        lines = [rng.choice(kinds) for _ in range(300)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        df = spark.createDataFrame([(name, i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
        want += [(name, r.line, r.is_title) for r in R.frame_articles(df).orderBy("line_no").collect()]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        lines = R.read_numbered_lines(spark, tmp_path.as_uri())
        assert lines.select("file", "block").distinct().count() > 20
        rows = R.frame_articles(lines, block_col="block").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    rows.sort(key=lambda r: (r.file, r.block, r.line_no))
    assert [(r.file.rsplit("/", 1)[1], r.line, r.is_title) for r in rows] == want


def test_shards(spark, tmp_path):
    counted = spark.createDataFrame([("x", "a b ", 3), ("y", "a b ", 4), ("y", "c ", 9)], "s string, chain string, n long")
    path = (tmp_path / "shards").as_uri()
    R.save_shards(counted, path, "s")
    assert {(r.text, r.c) for r in I.merge([R.read_shards(spark, path)], 5).collect()} == {("a ", 7), ("a b ", 7), ("c ", 9)}
    assert {(r.chain, r.n) for r in R.read_shards(spark, f"{path}/shard=x", f"{path}/shard=y").collect()} == {("a b ", 3), ("a b ", 4), ("c ", 9)}
    with pytest.raises(Exception, match="(?i)exists"):
        R.save_shards(counted, path, "s")
    none = (tmp_path / "none").as_uri()
    counted.filter("n > 99").select("chain", "n").write.parquet(none)
    with pytest.warns(UserWarning, match="no chains"):
        assert R.read_shards(spark, path, none).count() == 3
    with pytest.raises(ValueError):
        R.read_shards(spark)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from lexiloom import session

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)
    Context.master = "local[2]"
    assert session.shared_dir(Session).startswith("file:")


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "line string")
    index = I.build_index(none)
    assert index.count() == 0 and I.corpus_total(index).first()[0] == 0


def test_save_refuses_to_overwrite(spark, tmp_path):
    index = I.build_index(spark.createDataFrame([("the cat",)] * 5, "line string"))
    path = (tmp_path / "i").as_uri()
    R.save_index(index, path)
    assert {(r.text, r.c) for r in R.load_index(spark, path).collect()} == {("the ", 5), ("the cat ", 5), ("cat ", 5)}
    with pytest.raises(Exception, match="(?i)exists"):
        R.save_index(index, path)


def test_readers(spark, tmp_path):
    (tmp_path / "x.txt").write_text("<doc id=1 url=u>\nTitle one\nline a\nline b\n</doc>\n<doc id=2>\nTwo\n</doc>\n")
    rows = [(r.title, r.text) for r in R.read_doc_blocks(spark, (tmp_path / "x.txt").as_uri()).collect()]
    assert rows == [("Title one", "line a\nline b\n"), ("Two", "")]
    (tmp_path / "d.xml").write_text('<m><page><title>A</title><revision><text xml:space="preserve">hello [[B|c]]</text></revision></page><page><title>R</title><revision><text bytes="1">#redirect [[A]]</text></revision></page><page><title></title><revision><text a="b">x</text></revision></page></m>')
    pages = R.read_xml_dump(spark, (tmp_path / "d.xml").as_uri())
    assert [(r.title, r.text) for r in pages.collect()] == [("A", "hello [[B|c]]")]
    assert sorted((r.line, r.weight) for r in R.articles_to_lines(pages).collect()) == [("A", 10), ("hello B", 1)]
    assert R.read_lines(spark, (tmp_path / "x.txt").as_uri()).count() == 8


def test_prefix_runs_go_on_over_batches():
    texts = sorted(["of the cat ", "of the cat s", "of the dog ", "of thin ", "a b c d", "a b c d", "of", "é of ", "of the cat "])
    rows = pa.table({"g": ["x"] * len(texts) + ["y"] * len(texts), "t": texts * 2, "n": [2] * (2 * len(texts))})
    want = Counter()
    for g, t, n in zip(*rows.to_pydict().values(), strict=True):
        want.update({(g, t[: i + 1]): n for i, c in enumerate(t) if c == " "})
    for cutoff in (1, 5):
        for size in range(1, len(rows) + 1):
            got = [x for b in I._sorted_runs(iter(rows.to_batches(size)), cutoff) for x in b.to_pylist()]
            assert len(got) == len({(x["g"], x["text"]) for x in got})
            assert {(x["g"], x["text"]): x["c"] for x in got} == {k: c for k, c in want.items() if c >= cutoff or k[1].count(" ") == 1}


def test_prefixes_are_shuffled_as_chains_and_frequent_prefixes(spark):
    """Not as every prefix of every chain, of which there are five times as many."""
    lines = spark.range(2000).selectExpr("concat('w', id % 7, ' x', id, ' y', id, ' z', id, ' w', id, ' end') AS line")
    plan = I.prefix_counts(I.chain_rows(lines), 5)._jdf.queryExecution().executedPlan().toString()
    assert "word_prefixes" not in plan and plan.count("explode(") == 1
    got = {r.text: r.c for r in I.prefix_counts(I.chain_rows(lines), 5).collect()}
    assert got == {**{f"w{i} ": len(range(i, 2000, 7)) + 1 for i in range(7)}, "end ": 2000}


def test_rare_chains_are_not_shuffled(spark, lines):
    """What is shuffled is cut to words and pairs that are frequent, and the index is that of all chains."""
    df, _ = lines
    some = spark.range(400).selectExpr("concat('w', id % 7, ' x', id, ' y', id, ' z', id, ' the end, the end') AS line")
    for table, cutoff in ((df, 1), (df, 3), (some, 5), (some, 100)):
        want = {(r.text, r.c) for r in I.prefix_counts(I.chain_rows(table), cutoff).collect()}
        built = I.build_index(table, cutoff)
        assert sorted((r.text, r.c) for r in built.collect()) == sorted(want)
        assert "explode(" not in built._jdf.queryExecution().executedPlan().toString()
    assert {r.t for r in Q.frequent_chains(some, 5).collect()} == {*(f"w{i} " for i in range(7)), "the end the end ", "the end ", "end the end ", "end "}
    weighted = df.select("line", (F.length(F.coalesce("line", F.lit(""))) % 4).alias("w"))
    want = {(r.text, r.c) for r in I.prefix_counts(I.chain_rows(weighted, weight=F.col("w")), 4).collect()}
    assert {(r.text, r.c) for r in I.frequent_prefixes(weighted, 4, weight=F.col("w")).collect()} == want


def test_stored_ranges_do_not_overlap(spark, tmp_path):
    words = ["a", "b", "the", "of", "zz", "0"]
    df = spark.createDataFrame([(" ".join(random.Random(i).choices(words, k=9)),) for i in range(300)], "line string")
    path = (tmp_path / "ranged").as_uri()
    R.save_ranged_index(I.build_index(df, 2), path)
    files = R.load_index(spark, path).groupBy(F.input_file_name()).agg(F.min("text").alias("a"), F.max("text").alias("b")).orderBy("a").collect()
    assert len(files) > 6 and all(x.b < y.a for x, y in zip(files, files[1:]))


def test_packs_of_any_size(monkeypatch):
    """Lines are normalised as the expression does it, and packs of few or many words come to the same."""
    rng = random.Random(5)
    plain = [x or "" for x in LINES] + ["".join(rng.choice("aB'\0 é.9\n") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = pa.table({"line": plain, "n": pa.array([1 + i % 3 for i in range(len(plain))], pa.int64())})
    data = [x.encode() for x in plain]
    got, line = Q.normalized(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([len(x) for x in data]))
    assert [bytes(got[line == i]).decode() for i in range(len(plain))] == [norm(x) for x in plain]
    want = Counter()
    for x, n in zip(plain, rows["n"].to_pylist(), strict=True):
        want.update({p: 0 for p in prefixes(norm(x))})
        for c in model_chains(norm(x)):
            for p in prefixes(c):
                want[p] += n
    want = {p: c for p, c in want.items() if c >= 4}
    for most, size in ((1, 7), (100, 50), (1 << 20, 1000)):
        for name in ("KEYS_AT_ONCE", "CHAINS_AT_ONCE", "BYTES_AT_ONCE"):
            monkeypatch.setattr(Q, name, most)
        batches = lambda: iter(rows.to_batches(size))  # noqa: E731, B023
        slices = [(x["part"], x["count"], x["pack"]) for b in Q._bit_slices(Q._key_packs(batches(), 4), 4, 4) for x in b.to_pylist()]
        found = Counter()
        for b in Q._chain_texts(Q._chain_packs(batches(), slices, 3)):
            for x in b.to_pylist():
                for p in prefixes(x["t"]):
                    found[p] += x["n"]
        assert {p: c for p, c in found.items() if c >= 4} == want


def test_rounds_of_an_index(spark, tmp_path):
    """An index stored range by range is the whole one, its files do not overlap, and no round leaves shuffle files."""
    rng = random.Random(7)
    words = ["a", "b", "the", "of", "zz", "0", "transmission", "transmit", "it's", "an" * 25]
    df = spark.createDataFrame([(" ".join(rng.choices(words, k=9)),) for _ in range(Q.RANGE_LINES + 500)], "line string").repartition(3)
    rounds = I.index_rounds(df, 3)
    assert len(rounds) == I.ROUNDS
    path = (tmp_path / "rounds").as_uri()
    place = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    left = lambda: {x.name for x in place.rglob("shuffle_*.data")}
    before = left()
    R.save_index_rounds(rounds, path)
    assert left() <= before
    got = R.load_index(spark, path)
    want = {(r.text, r.c) for r in I.prefix_counts(I.chain_rows(df), 3).collect()}
    assert sorted((r.text, r.c) for r in got.collect()) == sorted(want)
    files = got.groupBy(F.input_file_name()).agg(F.min("text").alias("a"), F.max("text").alias("b")).orderBy("a").collect()
    assert len(files) > I.ROUNDS and all(x.b < y.a for x, y in zip(files, files[1:]))
    with pytest.raises(FileExistsError):
        R.save_index_rounds(rounds, path)


def test_stored_index_takes_little_place(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([(x,) for x in ["the quick brown fox", "the quick red fox"] * 3], "line string")
    R.save_index_rounds(I.index_rounds(df, 3), path)
    files = list(Path(path).rglob("*.parquet"))
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}


@pytest.mark.parametrize("stop", ["", "spark.stop()"])
def test_index_of_a_session_goes_with_the_program(tmp_path, stop):
    """Else every program leaves an index in the shared folder."""
    shared = tmp_path / "shared"
    script = f"""
import pathlib
from pyspark.sql import SparkSession
from lexiloom import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "{shared.as_uri()}").getOrCreate()
spark.createDataFrame([(i, "the quick brown fox") for i in range(9)], "doc_id long, text string").write.parquet("{tmp_path}/documents.parquet")
assert queries.queries()["find_literal"](spark, "{tmp_path}").collect()
assert list(pathlib.Path("{shared}").glob("index-*"))
{stop}
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=180, cwd=Path(__file__).resolve().parents[1])
    assert not list(shared.glob("index-*"))


def test_hashes_of_words_by_sums_over_all_bytes():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts = np.concatenate((r.integers(0, 4960, 200), [0, 1023, 1024, 4960]))
    ends = starts + np.concatenate((r.integers(0, T.WINDOW, 200), [0, 1, 2, 40]))
    want = []
    for a, b in zip(starts, ends, strict=True):
        h = 0
        for c in data[a:b].tolist():
            h = (h + c + 1) * int(Q._BASE) % (1 << 64)
        want.append(h)
    assert Q._hashes(data, starts, ends).tolist() == want
