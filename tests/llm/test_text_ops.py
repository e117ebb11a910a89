"""Token counts, BPE, SimHash, media columns and the language model against their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lexiloom.llm import bpe, jpeg, lm, media, simhash, token_counts

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(8)
TEXTS = [None, "", " ", "a", "Hello  world\n\n'tis don't I'll", "thereinating thereinating", "x" * 3000, "word " * 4000, " " * 200 + "the", "é漢😀\0\x85　", "<s></s><unk><0x41>", "a<|endoftext|>b", "▁▁a ▁b"]
TEXTS += ["".join(rng.choice("theinr  .\né") for _ in range(rng.randint(1, 120))) for _ in range(150)]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, a null id and columns whose names clash with results."""
    rows = [(i, t, "n", "k", 1) for i, t in enumerate(TEXTS)] + [(3, "a", "n", "k", 1), (None, "a b c d", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id string, fp int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = token_counts.token_counts(docs, PIECE, limit=10).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = ("a b c d" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 10), t[:40]
    assert token_counts.token_counts(none, PIECE).count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rows = bpe.round_trip(docs, BPE).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = ("a b c d" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        ids = tok.encode(t, add_special_tokens=False).ids
        want = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want), t[:40]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BPE), BPE).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.round_trip(none, BPE).count() == 0


def test_bpe_pairs_are_tested_exactly():
    v = bpe.Vocabulary(BPE)
    some = np.random.default_rng(1).integers(0, 20000, (4000, 2))
    some = some[np.array([bool(v.bytes[a] and v.bytes[b]) for a, b in some])]
    good = v.compatible(some[:, 0], some[:, 1])
    raw = [v.bytes[a] + v.bytes[b] for a, b in some]
    from lexiloom.llm.ragged import merge_lowest

    ids, n = merge_lowest(v.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.array([len(x) for x in raw]), v.table)
    ends = np.cumsum(n)
    want = [ids[e - k : e].tolist() == pair.tolist() for e, k, pair in zip(ends, n, some, strict=True)]
    assert good.tolist() == want and any(want) and not all(want)


def shingle_print(t, words=3):
    import xxhash

    w = WORDS.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(marks, linked):
    """Smallest id of each component by comparing all pairs."""
    up = {i: i for i in marks}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(marks[a], marks[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shard_rows", [1024, 2])
def test_simhash(docs, none, shard_rows):
    rows = simhash.near_duplicates(docs, shard_rows=shard_rows).collect()
    assert len(rows) == len(TEXTS) + 2
    marks = {i: shingle_print(t) for i, t in enumerate(TEXTS)}
    want = components(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (int(r.fingerprint, 16), r.component_id) == (marks[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_chains(spark):
    """Fingerprints one or two bits apart in long chains, more than a shard holds."""
    r = random.Random(2)
    marks, at = {}, 0
    for i in range(400):
        at = at ^ (1 << r.randrange(64)) if r.random() < 0.97 else r.getrandbits(64)
        marks[i] = at
    nodes = {m: i for i, m in sorted(marks.items(), reverse=True)}  # equal fingerprints are one node, its smallest id
    want = components(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m, i) for m, i in nodes.items()], "fp long, low long")
    for shard_rows in (1024, 8):
        got = {r.a: r.root for r in simhash.least_of_component(simhash.links(df, df.count(), shard_rows=shard_rows)).collect()}
        assert {i: got.get(i, i) for i in nodes.values()} == {i: want[i] for i in nodes.values()}


def similar_components(texts, words=5):
    """The component of every id by all pairs with a Jaccard similarity of 0.8 or more in their word shingles."""

    def shingles(t):
        w = WORDS.findall(lower(t or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    def near(a, b):
        both = len(a & b)
        return a == b or 5 * both >= 4 * (len(a) + len(b) - both)

    return components({i: shingles(t) for i, t in texts.items()}, near)


def test_rows_of_an_id_are_one_document(spark):
    """Id 5 has two texts, each with another id; null ids link nothing."""
    a, b = "one two three four five six", "alpha beta gamma delta epsilon zeta eta"
    df = spark.createDataFrame([(5, a), (5, b), (1, a), (7, b), (9, "other words here"), (None, a), (None, "alone")], "doc_id long, text string")
    want = {(5, 1), (1, 1), (7, 1), (9, 9), (None, 1), (None, None)}
    assert {(x.doc_id, x.component_id) for x in simhash.near_duplicates(df).collect()} == want
    assert {(x.doc_id, x.component_id) for x in simhash.similar_documents(df).collect()} == want


def test_similar_documents(spark, docs, none):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    texts = {}
    for family in range(6):
        base = [r.choice(words) for _ in range(400)]
        for k in range(8):
            copy = base[:]
            for _ in range(k):
                copy[r.randrange(400)] = "edit"
            texts[family * 8 + k] = " ".join(copy)
    texts |= {48: None, 49: "", 50: "one two", 51: texts[0]}

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for shard_rows in (1024, 3):
        assert {x.doc_id: x.component_id for x in simhash.similar_documents(df, shard_rows=shard_rows).collect()} == similar_components(texts)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(docs).collect()}
    assert len(got) and simhash.similar_documents(none).count() == 0


def plain_pixels(payload, width, height):
    """A payload's picture by definition: block by block, every sample a sum of cosines, chroma repeated."""
    across, down = width // 16, height // 16
    blocks = [list(payload[i : i + 64]) for i in range(0, len(payload), 64)]
    planes = [np.full((height, width), 128.0), np.full((height // 2, width // 2), 128.0), np.full((height // 2, width // 2), 128.0)]
    zigzag = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    one = lambda k, x: (math.sqrt(1 / 8) if k == 0 else 0.5) * math.cos((2 * x + 1) * k * math.pi / 16)
    wave = {(k, x): one(k, x) for k in range(8) for x in range(8)}
    for n, block in enumerate(blocks):
        unit, place = divmod(n, 6)
        y, x = divmod(unit, across)
        plane = planes[max(place - 3, 0)]
        top, left = (16 * y + 8 * (place // 2), 16 * x + 8 * (place % 2)) if place < 4 else (8 * y, 8 * x)
        out = np.zeros((8, 8))
        for (r, c), v in zip(zigzag, block, strict=True):
            out += (v - 128) * np.outer([wave[r, i] for i in range(8)], [wave[c, i] for i in range(8)])
        plane[top : top + 8, left : left + 8] = out + 128
    assert unit < across * down
    y, b, r = (np.clip(np.floor(p + 0.5), 0, 255) for p in planes)
    b, r = (np.repeat(np.repeat(p, 2, axis=0), 2, axis=1) - 128 for p in (b, r))
    return np.clip(np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), axis=2), 0, 255)


@pytest.mark.parametrize("parts", [1, 3])
def test_media(docs, none, monkeypatch, parts):
    """Every column: the payload by definition, the file as the operator stores it, the feature of a picture made by definition."""
    if parts > 1:
        monkeypatch.setattr(media, "PART_BYTES", 0)
        monkeypatch.setattr(media, "PARTS", parts)
        monkeypatch.setattr(media, "_few", lambda size: parts)
    got = media.media_digests(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen = {}
    for x in got:
        raw = texts[x.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (x.n_bytes, x.payload_bytes) == (len(raw), len(payload))
        assert (x.payload_sha256, x.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert seen.setdefault(raw, x[1:]) == x[1:]
    for raw in sorted(seen, key=len)[:12]:
        payload = media.payload_of(raw.decode())
        (files,) = media.files_of([raw.decode()])
        ((digests, tensors),) = media.read_back([files])
        row = seen[raw]
        assert digests[3:] == (sum(map(len, files)), hashlib.sha256(b"".join(files)).hexdigest()) == (row[4], row[5])
        assert row[6] == media.feature_of(tensors) and len(tensors) == 1
        t = tensors[0]
        rgb = np.frombuffer(t["rgb"], dtype=np.uint8).reshape(t["height"], t["width"], 3)
        assert row[6] == f"{t['width']}x{t['height']}:{','.join(str(int(rgb[:, :, c].astype(int).sum())) for c in range(3))}:{zlib.crc32(rgb.tobytes()):08x}"
        assert np.abs(rgb - plain_pixels(payload, t["width"], t["height"])).max() <= 2
    assert media.media_digests(none).count() == 0


def test_media_in_sheets(monkeypatch):
    text = "é long text " * 400
    whole = media.read_back(media.files_of([text, "b"]))
    monkeypatch.setattr(media, "SHEET", 576)
    monkeypatch.setattr(media, "WRITTEN", 1000)
    monkeypatch.setattr(media, "READ", 3000)
    files = media.files_of([text, "b"])
    again = media.read_back(files)
    assert [d[:3] for d, _ in again] == [d[:3] for d, _ in whole] and len(files[0]) == len(again[0][1]) == 10


def test_jpeg_round_trips_any_coefficients():
    r = np.random.default_rng(3)
    for _ in range(12):
        images = [jpeg.Geometry(int(r.integers(1, 70)), int(r.integers(1, 70)), [((2, 2), (1, 1), (1, 1)), ((1, 1),) * 3, ((2, 1), (1, 1), (1, 1))][int(r.integers(3))]) for _ in range(4)]
        c = r.integers(-300, 300, (sum(g.blocks for g in images), 64)) * (r.random((sum(g.blocks for g in images), 64)) < r.choice([0.02, 0.3, 1]))
        c[r.random(c.shape) < 0.2] //= 200
        got, bases = jpeg.coefficients([jpeg.parse(x) for x in jpeg.encode(c, images, restart=int(r.integers(0, 9)))])
        for g, base in zip(images, bases, strict=False):
            for p in range(3):
                at = g.order((p,))[0] + base
                assert (got[at] == c[at]).all()


def test_jpeg_is_read_alike_elsewhere(spark):
    """The pixels of another decoder, where chroma needs no upsampling."""
    jvm = spark.sparkContext._jvm
    g = jpeg.Geometry(70, 45, ((1, 1),) * 3)
    r = np.random.default_rng(2)
    c = np.zeros((g.blocks, 64), dtype=np.int64)
    c[:, :10] = r.integers(-3, 4, (g.blocks, 10)) * np.array([20, 6, 6, 3, 3, 2, 2, 1, 1, 1])
    raw = jpeg.encode(c, [g], quant=[np.full(64, 4), np.full(64, 5)])[0]
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    a = np.array(list(image.getRGB(0, 0, 70, 45, None, 0, 70)), dtype=np.int64).reshape(45, 70)
    other = np.stack([a >> 16 & 255, a >> 8 & 255, a & 255], axis=2)
    # Planes may round by one each, which the conversion makes up to three of.
    apart = np.abs(other - jpeg.decode(raw))
    assert apart.max() <= 3 and apart.mean() < 0.1
    with pytest.raises(ValueError):
        jpeg.parse(b"no image")


def test_half_size_chroma_is_read_alike_elsewhere(spark):
    """Another decoder's pixels of a file with chroma of half the resolution, each plane of one colour: no upsampling shows."""
    jvm = spark.sparkContext._jvm
    g = jpeg.Geometry(80, 48, media.SAMPLING)
    r = np.random.default_rng(6)
    c = np.zeros((g.blocks, 64), dtype=np.int64)
    luma, cb, cr = (g.order((p,))[0] for p in range(3))
    c[luma, :12] = r.integers(-3, 4, (len(luma), 12)) * 4
    c[cb, 0], c[cr, 0] = 37, -22
    raw = jpeg.encode(c, [g], quant=[np.full(64, 4), np.full(64, 5)])[0]
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    a = np.array(list(image.getRGB(0, 0, 80, 48, None, 0, 80)), dtype=np.int64).reshape(48, 80)
    apart = np.abs(np.stack([a >> 16 & 255, a >> 8 & 255, a & 255], axis=2) - jpeg.decode(raw))
    assert apart.max() <= 3 and apart.mean() < 0.2


def test_scans_select_and_approximate_all_planes():
    """Every coefficient of every plane comes in two bands and two bits of precision."""
    for p in range(3):
        mine = [x for x in jpeg.SCRIPT if p in x[0]]
        assert {(low, high) for _, low, high, was, _ in mine if not was} == {(0, 0), (1, 5), (6, 63)}
        assert all(any(low <= k <= high and was == 1 for _, low, high, was, _ in mine) for k in range(64))
    assert len(jpeg.SCRIPT) == 11


def test_lm(spark, docs, none):
    known = "the cat sat on the mat and the dog sat on the cat".split()
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(known) for _ in range(r.randint(1, 60)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "the " * 5000), (1003, "Unseen wörds \x85 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in lm.lm_scores(df, BPE, block_bytes=4000).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update(WORDS.findall(lower(t)) + ["\n"])
    n, v = sum(c.values()), len(c)
    gain = 0
    for i, t in rows:
        w, x = WORDS.findall(lower(t)) + ["\n"], out[i]
        base = sum(math.log10((c[y] + 0.1) / (n + 0.1 * (v + 1))) for y in w)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(w), sum(c[y] > 0 for y in w), n)
        assert x.base_score == pytest.approx(base, rel=1e-9)
        assert x.score <= 0 and math.isfinite(x.score)
        gain += (x.score - base) * held[i]
    assert gain > 0
    assert len(lm.lm_scores(docs, BPE).collect()) == len(TEXTS) + 2
    assert lm.lm_scores(none, BPE).count() == 0


def test_windows_score_each_token_once():
    lengths = np.array([1, 16, 17, 100, 3])
    tokens = np.arange(lengths.sum()) + 10
    x, y = lm.lay_out(tokens, lengths, 1, 2)
    assert y[y >= 0].tolist() == tokens.tolist()
    first = {int(t) for t in np.cumsum(lengths) - lengths + 10}
    for a, b in zip(x[y >= 0].tolist(), y[y >= 0].tolist(), strict=True):
        assert a == (1 if b in first else b - 1)


def test_windows_overlap_by_half():
    """Behind a text's start every scored subword sees at least 16 others before it, besides itself, and none of another text."""
    x, y = lm.lay_out(np.arange(130) + 10, np.array([30, 100]), 1, 2)
    windows = lm._windows(np.ascontiguousarray(x[None, :, :, None]))[0, :, :, 0]
    for window, targets in zip(windows.tolist(), y[1:].tolist(), strict=True):
        for k, t in enumerate(targets):
            seen = [s for s in window[: lm.STRIDE + k + 1] if s >= 10]
            assert t < 0 or len(seen) >= min(t - 10 - 30 * (t >= 40), 17) and all((s >= 40) == (t >= 40) for s in seen)


def _random_weights(seed, scale=1.0):
    r, sub = np.random.default_rng(seed), lm.subwords(BPE)
    size = sub.size + 2
    w = lm.initial(r.integers(-9, 9, (size, lm.TRAITS)), r.integers(0, 9, (size + 1, size)).astype(float), r.integers(0, 9, (size, size)).astype(float), sub)
    w.flat[:] = r.normal(size=len(w.flat)) * scale
    return w, sub


@pytest.mark.parametrize("scale", [0.3, 6.0])
def test_attention_by_definition(scale):
    """The score of every token, one query and key at a time."""
    w, sub = _random_weights(4, scale)
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abthe") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (0, 1, 7, 40)]
    numbers, lengths, words = lm.numbered(pa.array(texts))
    lexicon = lm.Speller(sub).lexicon_of(words)
    counts = np.arange(len(words) + 1)
    known, base, score = lm.score_block(numbers, lengths, lexicon, counts, 100, 20, w, sub)
    ends = np.cumsum(lengths)
    for i, n in enumerate(lengths):
        mine = numbers[ends[i] - n : ends[i]].tolist()
        flat, of = [sub.end], []
        for word, k in enumerate(mine):
            flat += lexicon.ids[lexicon.at[k] : lexicon.at[k] + lexicon.n[k]].tolist()
            of += [word] * int(lexicon.n[k])
        inside = [0.0] * len(mine)
        for j in range(len(flat) - 1):
            q = w.query[flat[j]].astype(float)
            keys = range(max(0, (j // lm.STRIDE - 1) * lm.STRIDE), j + 1)
            s = np.array([q @ w.key[flat[k]] + w.near[j - k] for k in keys])
            a = np.exp(s - s.max())
            h = (a / a.sum()) @ w.value[[flat[k] for k in keys]].astype(float)
            z = h @ w.mix + w.own[flat[j]]
            t = flat[j + 1]
            inside[of[j]] += z[w.class_of[t]] - z.max() - math.log(np.exp(z - z.max()).sum()) + w.inside[flat[j], t]
        want = [math.log((counts[k] + 0.1) / (100 + 0.1 * 21)) for k in mine]
        assert base[i] == pytest.approx(sum(want) / math.log(10), rel=1e-9) and known[i] == sum(counts[k] > 0 for k in mine)
        assert score[i] == pytest.approx(sum(np.logaddexp(math.log(lm.SHARE) + b, math.log(1 - lm.SHARE) + p) for b, p in zip(want, inside, strict=True)) / math.log(10), rel=1e-3)


def test_every_target_is_learned_from(monkeypatch):
    sub = lm.subwords(public_tokenizers.path("byte_bpe_50k.json"))
    size, rng = sub.size + 2, np.random.default_rng(4)
    lengths = np.array([40, 1, 700, 3, 90] * 20)
    tokens = rng.integers(0, sub.size, lengths.sum())
    w = lm.initial(np.zeros((size, lm.TRAITS), dtype=np.int64), np.ones((size + 1, size)), np.ones((size, size)), sub)
    seen, gradient = [], lm.gradient

    def counted(w, x, y, pad, rows=slice(None)):
        seen.append(y[:, :, rows][y[:, :, rows] >= 0])
        return gradient(w, x, y, pad, rows)

    monkeypatch.setattr(lm, "gradient", counted)
    lm.Descent(w, 0.02, sub.pad, 1).feed(*lm.lay_out(tokens, lengths, sub.end, sub.pad))
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(tokens))


def test_gradient_by_differences():
    w, sub = _random_weights(5, 0.3)
    r = np.random.default_rng(3)
    x, y = r.integers(0, 60, (2, 4, lm.STRIDE)).astype(np.int16), r.integers(-1, 60, (2, 3, lm.STRIDE)).astype(np.int16)
    x[:, 0] = sub.pad
    rows = slice(1, None, 2)
    t = y[:, :, rows].ravel()

    def loss(flat):
        v = w.with_flat(flat.astype(np.float32))
        z = v.attend(x, v.tables(sub.pad), rows)[-1].astype(float)
        p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -(p[np.arange(len(t)), w.class_of[np.maximum(t, 0)]] * (t >= 0)).sum() / (t >= 0).sum()

    got = lm.gradient(w, x, y, sub.pad, rows)
    for i in [*np.argsort(-np.abs(got))[r.integers(0, 2000, 40)], *range(len(got) - lm.WINDOW, len(got), 5)]:
        step = np.zeros(len(got))
        step[i] = 1e-2
        assert got[i] == pytest.approx((loss(w.flat + step) - loss(w.flat - step)) / 2e-2, rel=0.02, abs=2e-5)


def test_words_are_parted_as_defined():
    """By the words of a plain scan, for all ASCII characters and blanks of other kinds."""
    texts = ["", " ", "\x85a b", "\u00a0x\u2003y Z", *(f"{chr(i)}A{chr(i)}{chr(i)}b{chr(i)}" for i in range(128))]
    numbers, lengths, words = lm.numbered(pa.array(texts))
    names, ends = ["\n", *words.to_pylist()], np.cumsum(lengths)
    for t, n, end in zip(texts, lengths, ends, strict=True):
        assert [names[k] for k in numbers[end - n : end]] == [*WORDS.findall(lower(t)), "\n"]


def test_spelling_does_not_depend_on_earlier_blocks():
    sub = lm.subwords(BPE)
    blocks = [pa.array(x, type=pa.string()) for x in (["the", "cat"], ["cat", "thé", "the", "hat"], [], ["hat", "x" * 300])]
    speller = lm.Speller(sub)
    for words in blocks:
        a, b = speller.lexicon_of(words), lm.Speller(sub).lexicon_of(words)
        assert a.ids.tolist() == b.ids.tolist() and a.n.tolist() == b.n.tolist()


def test_equal_rows_do_not_meet(spark):
    df = spark.createDataFrame([(None, "the same text again", 1)] * 500, "doc_id long, text string, score int").repartition(4)
    out = lm.lm_scores(df, BPE, block_bytes=500)
    assert {(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens) for x in out.collect()} == {(None, False, 5, 5, 2500)}
    assert out.count() == 500


def test_lm_learns_context_from_all_documents(spark):
    """Every text repeats one of twenty sentences."""
    r = random.Random(8)
    letters = "abcdefghijklmnopqrst"
    sentences = [[a + b for b in r.sample(letters, 8)] for a in letters]
    rows = [(i, " ".join(r.choice(sentences) * 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [x for x in lm.lm_scores(df, BPE, block_bytes=40000).collect() if x.held_out]
    gain = sum(x.score - x.base_score for x in out) / sum(x.n_tokens for x in out)
    assert gain > 0.1


def test_similar_documents_by_exact_similarity(spark):
    """Pairs at and around 0.8, short and long, against all pairs."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for k in range(60):
        short = [word() for _ in range(8)]
        texts += [" ".join(short), " ".join([*short, word()])]  # 4 of 5 shingles
        n = r.choice([40, 80, 160])
        base = [word() for _ in range(n + 4)]
        for share in (0.8, 0.7):
            cut = round(n * (1 - share))
            texts.append(" ".join(base[cut:]))  # share * n of n shingles
        texts.append(" ".join(base))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = components(dict(enumerate(sets)), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard_rows in (1024, 3):
        assert {x.doc_id: x.component_id for x in simhash.similar_documents(df, shard_rows=shard_rows).collect()} == want


def test_similar_documents_with_boilerplate(spark):
    """Texts that share three quarters of their words, some of them copies with an edit: only those are linked."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    shared = [word() for _ in range(150)]
    texts = {}
    for k in range(300):
        own = [word() for _ in range(50)]
        texts[k] = " ".join(shared[:75] + own + shared[75:])
        if k % 10 == 0:
            texts[1000 + k] = " ".join(shared[:75] + own[:-1] + [word()] + shared[75:])
    for k in range(40):  # a group of near copies around one text
        edited = texts[7].split()
        edited[r.randrange(200)] = word()
        texts[2000 + k] = " ".join(edited)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = similar_components(texts)
    assert {x.doc_id: x.component_id for x in simhash.similar_documents(df).collect()} == want
    assert len(set(want.values())) == 300


def test_near_copies_meet_their_original(spark, monkeypatch):
    """Copies that are similar to one text only, whatever its id: a pair a copy is compared, not all pairs."""
    rng, base = random.Random(6), list(range(150))
    rows = [(1000, 1000, 150, base)]
    for i in range(40):
        gone = set(rng.sample(base, 12))
        rows.append((i, i, 150, [x for x in base if x not in gone] + [10_000 + 100 * i + k for k in range(12)]))
    sets, written, seen = spark.createDataFrame(rows, "node long, low long, n long, hs array<bigint>"), simhash.written, []

    def counted(df, name, *more):
        out = written(df, name, *more)
        seen.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "written", counted)
    found = {(r.a, r.b) for r in simhash.similar_links(sets, 0.8).collect()}
    assert found == {(i, 1000) for i in range(40)} and sum(seen) == 40
