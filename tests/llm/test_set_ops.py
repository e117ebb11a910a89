"""Packing, Merkle manifest and spelling variants against their definitions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import merkle, packing, spelling
from lexiloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")


def sql(spark, text, **tables):
    db = duckdb.connect()
    for name, rows in tables.items():
        db.register(name, rows.toArrow())
    return Counter(db.sql(text).fetchall()), db.sql(text).columns


def rows_of(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))


ODD = ["", " \t\n", "a", "Ünïcode NFC: é Å", "x<|endoftext|> y<|startoftext|>z", "don't we'll 1234 ---", "  wide　blanks\x1c\x1d\x85", "İΣΑΣ ﬁ ß", "\0 zero", "👩‍👩‍👧 ́alone \ńagain", "a" * 200]


def test_runs_have_the_ids_of_whole_texts(spark, tokenizer):
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect())]
    r = random.Random(2)
    texts += ["".join(r.choice(" \n\t.,'aAbZé1_-́Σß") for _ in range(r.randint(0, 60))) for _ in range(400)]
    # Contractions, special tokens, letters that lower-casing makes longer, separators and fractions.
    texts += ["".join(r.choice("ab'stdSLlMm.,-<|>1²½ªé Éİŉſž\x00\x1c\x7f\x85\xa0ćß") for _ in range(40)) for _ in range(1000)]
    texts += ["it's IT'S we'll <|startoftext|>x a<|endoftext|>b", "'S''s 'LL!'ll don't", "日本語 ｶﾞ"]
    encode = packing.Encoder(Q.tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):  # learnt, then remembered
        ids, n = encode(texts)
        cut = np.split(ids, np.cumsum(n)[:-1])
        assert [c.tolist() for c in cut] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(k) <= packing.CACHE_BYTES for k in encode.number)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=6), st.integers(30, 60), st.booleans())
def test_no_combination_is_fuller(counts, capacity, seeded):
    longest = max(counts) if seeded else 0
    taken = packing.fullest(counts, capacity, longest)
    sums = [sum(a * n for a, n in zip(counts, times, strict=True)) for times in itertools.product(*(range(n + 1) for n in counts.values())) if not seeded or times[list(counts).index(longest)]]
    assert sum(a * n for a, n in taken.items()) == max(x for x in sums if x <= capacity)
    assert all(0 < n <= counts[a] for a, n in taken.items()) and (not seeded or taken[longest])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=20))
def test_plans_use_all_pieces(counts):
    plan = packing.best_plan(counts, 64)
    used = Counter()
    for times, taken in plan:
        assert sum(a * n for a, n in taken.items()) <= 64
        used.update({a: n * times for a, n in taken.items()})
    assert used == counts
    # Every piece has a place of its own.
    places = packing.Places.of(plan)
    for a, n in counts.items():
        at, offset = places(np.full(n, a), np.arange(n))
        assert len(set(zip(at.tolist(), offset.tolist(), strict=True))) == n and at.max() < sum(t for t, _ in plan)


def check_packed(spark, docs, tokenizer, capacity):
    stored = packing.written(packing.pieces(docs, Q.tokenizer_path("word_bpe_49k.json"), capacity), "pieces")
    got = packing.pack(stored, capacity).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END]
        for k in range(0, len(ids), capacity):
            want[r.doc_id, k // capacity, k, len(ids[k : k + capacity]), np.array(ids[k : k + capacity], dtype="<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    for parts in held.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids) // 4
        assert at <= capacity
    filled = {r.sequence_id: (bytes(r.ids), r.n_tokens) for r in packing.sequences(packing.pack(stored, capacity)).collect()}
    assert filled == {k: (b"".join(i for _, i in sorted(v)), sum(len(i) for _, i in v) // 4) for k, v in held.items()}
    return held, sum(len(i) for v in held.values() for _, i in v) // 4


def test_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    held, tokens = check_packed(spark, docs, tokenizer, 4096)
    assert len(held) == -(-tokens // 4096)
    held, tokens = check_packed(spark, docs, tokenizer, 512)
    assert len(held) <= 1.01 * tokens / 512 + 1


def test_packing_of_unusual_rows(spark, none, tokenizer):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, None, None, "hot " * 3] + ["hot"] * 80)]
    rows += [(5, "hot", "x", 1), (None, "no id", "x", 1), (None, None, "x", 1), (500, "one two " * 20_000, "x", 1), (501, "z" * 30_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, part int").repartition(4)
    check_packed(spark, docs, tokenizer, 64)
    assert packing.packed_documents(none, Q.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert packing.sequences(packing.pack(packing.written(packing.pieces(none, Q.tokenizer_path("word_bpe_49k.json")), "pieces"))).count() == 0


# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, the path of every node) by the definition."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            paths[i].append((a % 2 == 1, nodes[a ^ 1] if a ^ 1 < len(nodes) else None))
        nodes, at = [H(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)], [a // 2 for a in at]
    return nodes[0], paths


def manifest_of(rows):
    """The query's rows for documents by the definition; rows that repeat an id come by their leaf."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: H(*[part(v) for v in (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + add, r.text)])
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[lang]]) for lang in langs]
    root, above = tree([t[0] for t in trees]) if trees else (None, [])
    out = Counter()
    for lang, (subroot, paths), over in zip(langs, trees, above, strict=True):
        for r, path in zip(groups[lang], paths, strict=True):
            now = leaf(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            for left, x in path + over:
                now = H(x or "", now) if left else H(now, x or "")
            out[r.doc_id, leaf(r), subroot, root, H(*[x for _, x in path + over if x]), now, now == root] += 1
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    docs = docs.filter("lang <> 'de' OR doc_id % 3 = 0") if bits < 10 else docs
    want = manifest_of(docs.collect())
    assert rows_of(merkle.document_manifest(docs), MANIFEST) == want
    assert 0 < sum(n for r, n in want.items() if not r[-1]) < 60


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_manifest_of_few(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BITS", 2)
    docs = spark.createDataFrame([(7 * i, "s", "en", 3, "t") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(merkle.document_manifest(docs), MANIFEST) == manifest_of(docs.collect())


def test_manifest_of_unusual_rows(spark, none):
    rows = [(i, "s", lang, 5, "é" * i, "g") for i, lang in enumerate(["en", "de", None, "", "é", "-", ":", "en", "EN", "\U0001f600", "￿"] * 4)]
    rows += [(3, "s", None, None, "t", "g")] * 2 + [(3, None, None, None, None, "g"), (None, "s", "en", 1, "", "g"), (None, "s", "en", 1, "x" * 300_000, "g"), (-7, "", "", 0, "", "g")]
    rows += [(9, "s", "en", 9, "copy", "g")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, node string").repartition(6)
    got = merkle.document_manifest(docs)
    want = manifest_of(docs.collect())
    assert rows_of(got, MANIFEST) == want
    assert rows_of(merkle.document_manifest(none), MANIFEST) == Counter()
    assert not re.search("ArrowEval|MapInArrow|BatchEvalPython|Cartesian", got._jdf.queryExecution().toString())


def test_manifest_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.document_manifest(docs)
    want, columns = sql(spark, Q.OP12_SQL, documents=docs)
    assert rows_of(got, columns) == want


# --- spelling variants


def variants_of(counts):
    """word -> the query's row, by generating and comparing everything."""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    by = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n, len(by[w]), words.get(form.get(w))] += 1
    return out


VARIANTS = ("word", "form", "root", "n", "n_near", "form_n")


def counted(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    out = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            out[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return out


def test_variants_of_random_words(spark):
    r = random.Random(5)
    words = Counter({"".join(r.choice("abñ") for _ in range(r.randint(5, 8))): r.choice([4, 5, 6, 30, 31, 160, 900]) for _ in range(500)})
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaab": 624, "x" * 5000: 7, "x" * 4999: 40, "x" * 2000 + "y" + "x" * 2999: 8}
    df = spark.createDataFrame([(w, n) for w, n in words.items() if len(w) >= 6 and n >= 5], "word string, n long").repartition(3)
    assert rows_of(spelling.variants(df), VARIANTS) == variants_of(words)


@pytest.mark.parametrize("bits", [16, 4])
def test_neighbours_are_complete_and_distinct(spark, bits):
    """All of a word's neighbours pass a bitmap that has them, each once; a small bitmap lets others through as well."""
    letters = "abÿ"
    for word in ["abba", "aab", "ÿ", "bbbbb", "abÿabÿ"]:
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + a + word[i + k :] for k in (0, 1) for i in range(len(word) + 1 - k) for a in letters}
        want = sorted(want - {word})
        bitmap = spelling.bitmap_of(spark.createDataFrame([(w,) for w in want if w] or [("b",)], "word string"), bits)
        got = [x for _, found in spelling.Neighbours(letters, bitmap, bits)([word, "abab"]) for x in found]
        # "abab" asks too: its neighbours in the set are few.
        mine = [x for of, found in spelling.Neighbours(letters, bitmap, bits)([word]) for x in found]
        assert len(mine) == len(set(mine)) and set(w for w in want if w) <= set(mine) <= set(want)
        assert set(mine) <= set(got)


def test_spelling_variants(spark, none):
    texts = ["Wörter wörter wOrter", None, "", "ABCDEF abcdef abcdeg " * 40, "short", "naïvely" * 2 + "Ānaïvely÷xyz", "Über" + "x" * 50_000] + ["planet " * 9 + "planets plänet planer, PLANET"] * 300 + ["plane-tarium"] * 9
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, "planets planets", "c", 1)] * 6 + [(12, "planet", "c", 1)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(5)
    want = variants_of(counted(docs.collect()))
    assert rows_of(spelling.spelling_variants(docs), VARIANTS) == want and any(w[1] for w in want)
    assert spelling.spelling_variants(none).count() == 0


def test_spelling_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, columns = sql(spark, Q.OP13_SQL, documents=docs)
    assert rows_of(spelling.spelling_variants(docs), columns) == want


def test_long_chains_of_forms(spark):
    words = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(25)], "word string, form string")
    got = spelling.roots(words)
    assert {tuple(r) for r in got.collect()} == {(f"w{i:02d}", "w25") for i in range(25)}
    assert spelling.roots(words.filter(F.lit(False))).count() == 0


def test_encoder_keeps_what_it_learned(monkeypatch):
    """Tasks of a process share it; a run is numbered once, and a call that fails leaves no numbers without ids."""
    encode = packing.encoder(Q.tokenizer_path("word_bpe_49k.json"))
    assert packing.encoder(Q.tokenizer_path("word_bpe_49k.json")) is encode
    want, _ = encode(["several naïve words, words"])
    count = encode.number.count
    got, _ = packing.encoder(Q.tokenizer_path("word_bpe_49k.json"))(["several naïve words, words"])
    assert list(got) == list(want) and encode.number.count == count

    def fails(runs):
        raise RuntimeError

    monkeypatch.setattr(encode, "_learn", fails)
    with pytest.raises(RuntimeError):
        encode(["words unheard-of"])
    monkeypatch.undo()
    got, _ = encode(["words unheard-of"])
    assert list(got) == packing.Encoder(Q.tokenizer_path("word_bpe_49k.json"))(["words unheard-of"])[0].tolist()
