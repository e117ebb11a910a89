"""Exact duplicates, pseudonyms, mixing, quality, web archives and the pipeline against their definitions."""

import base64
import datetime
import hashlib
import inspect
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, mixing, pii, quality, warc
from lexiloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


# --- exact duplicates


@pytest.mark.parametrize("capacity", [1024, 2])
def test_exact_duplicates(spark, none, capacity):
    r = random.Random(1)
    texts = ["hot"] * 60 + [None, "", "", "é", "é", "long " * 30000, "long " * 30000] + [r.choice("abcdefgh") * r.randint(1, 4) for _ in range(120)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(64, texts[64], "x", 1), (None, "only", None, None), (None, "hot", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, h int").repartition(5)
    got = exact_dedup.exact_duplicates(df, capacity=capacity).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for x in got:
        ids = by_sha[x.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert x.doc_id in ids and (x.keep_id, x.group_size, x.kept) == (keep, len(ids), x.doc_id == keep)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_colliding_hashes_are_chained(spark):
    """All hashes are 0 or 1, so that the bytes alone decide."""
    texts = ["a", "b", "cc", "a", None, "", "dd", "cc", "b", "a", "\x80", "ee", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    hash_of = lambda t: F.pmod(F.length(t), F.lit(2)).cast("long")
    placed, index, directory, total = exact_dedup.build_index(df, hash_of=hash_of)
    assert total == len(texts) and len(directory.buckets) == 1
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    held = index.collect()
    assert sorted((x.h, x.keep_id, x.group_size) for x in held) == sorted((len(t) % 2, max(ids), len(ids)) for t, ids in groups.items())
    assert sorted((x.h, x.place) for x in held) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3)]
    for x in exact_dedup.exact_duplicates(df, hash_of=hash_of).collect():
        ids = groups[texts[x.doc_id] or ""]
        assert (x.keep_id, x.group_size, x.kept) == (max(ids), len(ids), x.doc_id == max(ids))


@pytest.mark.parametrize(("keys", "capacity"), [(range(3000), 100), ([5] * 50, 4), ([], 3), ([1 << 15, 0, 1, 2, 3], 1), ([0, 0, 0, 1 << 9], 2)])
def test_directory_doubles_until_buckets_fit(spark, keys, capacity):
    mask = (1 << exact_dedup.MAX_DEPTH) - 1
    cells = {}
    for k in keys:
        cells[k & mask] = cells.get(k & mask, 0) + 1
    d = exact_dedup.Directory.grown(cells, capacity)
    pointers = {x.cell: x.bucket for x in d.table(spark).collect()}
    assert sorted(pointers) == list(range(1 << d.depth)) and set(pointers.values()) == set(range(len(d.buckets)))
    held = {}
    for c, n in cells.items():
        held.setdefault(pointers[c & ((1 << d.depth) - 1)], []).append((c, n))
    for bucket in held.values():
        assert sum(n for _, n in bucket) <= capacity or len(bucket) == 1  # that one cell cannot split further
    assert d.depth == max(depth for depth, _ in d.buckets)


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (*exact_dedup.build_index(docs)[:2], exact_dedup.exact_duplicates(docs), pii.pseudonymise(docs), mixing.mix(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    for module in (exact_dedup, pii, mixing):
        assert not re.search(r"udf|mapIn|applyIn|\.rdd|toPandas|import pandas|pyarrow", inspect.getsource(module))


# --- pseudonyms


def luhn(d):
    x = [int(c) for c in d][::-1]
    return sum(x[0::2] + [2 * y - 9 * (y > 4) for y in x[1::2]]) % 10 == 0


def move(key, kind, a, b, size_a, size_b, *tweak):
    for i in range(8):
        other = a if i % 2 else b
        h = int(hashlib.sha256("|".join(map(str, (key, kind, size_a, size_b, i, other, *tweak))).encode()).hexdigest()[:15], 16)
        a, b = (a, (b + h) % size_b) if i % 2 else ((a + h) % size_a, b)
    return a, b


def move_string(key, kind, x, letters, *tweak):
    """A string over ``letters`` as two numbers."""
    base, u = len(letters), len(x) // 2
    number = lambda t: sum(letters.index(c) * base**i for i, c in enumerate(reversed(t)))
    text = lambda n, size: "".join(letters[n // base**i % base] for i in reversed(range(size)))
    a, b = move(key, kind, number(x[:u]), number(x[u:]), base**u, base ** (len(x) - u), *tweak)
    return text(a, u) + text(b, len(x) - u)


def move_digits(key, kind, d, *tweak):
    return move_string(key, kind, d, "0123456789", *tweak)


def walk_digits(key, kind, d, valid):
    d = move_digits(key, kind, d)
    while not valid(d):
        d = move_digits(key, kind, d)
    return d


def reshaped(text, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in text)


def plain_phone(text):
    d = re.sub("[^0-9]", "", text)
    valid = lambda x: x[0] >= "2" and x[3] >= "2"
    if re.fullmatch(pii.PHONE, text):
        return reshaped(text, d[:-10] + walk_digits("k", "phone", d[-10:], valid)) if valid(d[-10:]) else text
    code = re.match("[+]?([0-9]+)", text)[1]
    return reshaped(text, code + move_digits("k", "phone abroad", d[len(code) :], code)) if 8 <= len(d) <= 15 else text


def plain_ssn(text):
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = re.sub("[^0-9]", "", text)
    return reshaped(text, walk_digits("k", "ssn", d, valid)) if valid(d) else text


def plain_ip(text):
    o = [int(x) for x in text.split(".")]
    if max(o) > 255:
        return text
    a, b = move("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return ".".join(map(str, (a // 256, a % 256, b // 256, b % 256)))


def plain_date(text):
    parts = [int(x) for x in re.split("[-/.]", text)]
    iso = len(text.split("-")[0]) == 4
    ways = [(0, 1, 2)] if iso else [(2, 1, 0), (2, 0, 1)]
    for way in ways:
        try:
            day = datetime.date(*(parts[i] for i in way))
        except ValueError:
            continue
        n = (day - datetime.date(1900, 1, 1)).days
        if not 0 <= n < 73049:
            return text
        while True:
            a, b = move("k", "date", n // 271, n % 271, 270, 271)
            n = a * 271 + b
            if n < 73049:
                break
        new = datetime.date(1900, 1, 1) + datetime.timedelta(days=n)
        if iso:
            return new.isoformat()
        at = {way[0]: f"{new.year:04d}", way[1]: f"{new.month:02d}", way[2]: f"{new.day:02d}"}
        short = (lambda x: x.lstrip("0")) if len(text) < 10 else (lambda x: x)
        return ("/" if "/" in text else ".").join(short(at[i]) for i in range(3))
    return text


def plain_iban(text):
    c = text.replace(" ", "")
    mod = lambda t: int("".join(str(int(x, 36)) for x in t)) % 97
    if mod(c[4:] + c[:4]) != 1:
        return text
    d = re.sub("[^0-9]", "", c[4:])
    body = reshaped(c[4:], (move_digits("k", "iban", d[:16]) if d else "") + (move_digits("k", "iban tail", d[16:]) if d[16:] else ""))
    new = iter(f"{c[:2]}{98 - mod(body + c[:2] + '00'):02d}{body}")
    return "".join(" " if x == " " else next(new) for x in text)


def plain_email(text):
    who, host = text.split("@")
    abc = "abcdefghijklmnopqrstuvwxyz"

    def changed(x, kind, tweak):
        letters, digits = re.sub("[^a-z]", "", x.lower()), re.sub("[^0-9]", "", x)
        some = iter("".join(move_string("k", kind, letters[i : i + 12], abc, i // 12, tweak) for i in range(0, len(letters), 12)))
        more = iter("".join(move_digits("k", kind, digits[i : i + 16], i // 16, tweak) for i in range(0, len(digits), 16)))
        return "".join(next(more) if c.isdigit() else c if not c.isalpha() else next(some).upper() if c.isupper() else next(some) for c in x)

    return f"{changed(who, 'email', host.lower())}@{changed(host, 'host', 'host')}.invalid"


def test_every_kind_follows_the_network(spark):
    r = random.Random(5)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    ibans = ["GB82WEST12345698765432", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606", "NO9386011117947", "DE88370400440532013000", "MT84MALT011000012345MTLCAST001S"]
    kinds = {
        "phone": (plain_phone, ["+49 30 1234567", "+44 20 7946 0958", "06 12 34 56 78", "06.12.34.56.78", "555 234 4567", "(000) 000-0000", "155-234-4567", "+1 (743) 555-3824", "+33 6 12 34 56 78", *(f"({r.randint(2, 9)}{d(2)}) {r.randint(1, 9)}{d(2)}-{d(4)}" for _ in range(30))]),
        "ssn": (plain_ssn, ["123-45-6789", "123 45 6789", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-6789", *(f"{d(3)}-{d(2)}-{d(4)}" for _ in range(30))]),
        "ip": (plain_ip, ["10.20.30.255", "256.1.1.1", "0.0.0.0", *(".".join(str(r.randint(0, 255)) for _ in range(4)) for _ in range(30))]),
        "date": (plain_date, ["2001-02-28", "28/02/2001", "02/28/2001", "28.02.2001", "1/5/2020", "31.1.1999", "30/02/2001", "2001-13-01", "1899-12-31", "1900-01-01", "2099-12-31", *(f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1900, 2099)}" for _ in range(30))]),
        "iban": (plain_iban, ibans),
        "email": (plain_email, ["Jo.x9@a-b.example.com", "a@b.co", "A1b2C3@X.org", "averyveryverylongname.with.parts+12345678901234567890@some-long-host.name.example.net", *(f"{c}@x.yz" for c in "abcdefghij")]),
    }
    for kind, (plain, texts) in kinds.items():
        got = one(spark, *(f"x {t}, y" for t in texts))
        for t, x in zip(texts, got, strict=True):
            want = plain(t)
            assert x.text == f"x {want}, y", (kind, t)
            assert x[f"n_{kind}"] == x.n_found == (want != t), (kind, t)
        if kind != "date":
            assert len({x.text for x in got}) == len(set(texts)), kind  # no two values meet


def one(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, k string, n_found int")
    return sorted(pii.pseudonymise(df, key=key).collect(), key=lambda x: x.doc_id)


def test_cards_and_phones_follow_the_network(spark):
    cards = ["4785380592391139", "4111111111111111", "378282246310005", "6011000990139424"]
    got = one(spark, *cards, "+1 (743) 555-3824", "743.555.3824")
    for c, x in zip(cards, got, strict=False):
        body = move_digits("k", "card", c[:-1])
        check = next(k for k in "0123456789" if luhn(body + k))
        assert (x.text, x.n_card, x.n_found) == (body + check, 1, 1)
    p = walk_digits("k", "phone", "7435553824", lambda x: x[0] >= "2" and x[3] >= "2")
    assert got[4].text == f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}" and got[5].text == f"{p[:3]}.{p[3:6]}.{p[6:]}"


def test_formats_hold_and_values_stay_linked(spark):
    text = "c 4785-3805-9239-1139, 4785 3805 9239 1139 4785380592391139; ip 10.20.30.255. born 2001-02-28, 28/02/2001 28.02.2001 02/28/2001 ssn 123-45-6789 GB82WEST12345698765432 mail Jo.x9@a-b.example.com!"
    x, again, other = one(spark, text, "x " + text)[0], one(spark, text)[0], one(spark, text, key="z")[0]
    assert x.text == again.text != other.text
    assert (x.n_card, x.n_ip, x.n_date, x.n_ssn, x.n_iban, x.n_email, x.n_phone) == (3, 1, 4, 1, 1, 1, 0)
    a, b, c = re.search(r"c ([0-9-]+), ([0-9 ]+) ([0-9]+);", x.text).groups()
    assert a.replace("-", "") == b.replace(" ", "") == c and luhn(c) and c != "4785380592391139"
    assert all(int(o) <= 255 for o in re.search(r"ip ([0-9.]+)\. ", x.text)[1].split("."))
    iso, dmy, dots, mdy = re.search(r"born (\S+), (\S+) (\S+) (\S+)", x.text).groups()
    y, m, d = iso.split("-")
    assert (dmy, dots) == (f"{d}/{m}/{y}", f"{d}.{m}.{y}") and mdy == f"{m}/{d}/{y}"
    iban = re.search(r"GB[0-9A-Z]{20}", x.text)[0]
    assert int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1 and iban[4:8] == "WEST"
    assert re.search(r" [A-Z][a-z]\.[a-z][0-9]@[a-z]-[a-z]\.[a-z]{7}\.[a-z]{3}\.invalid!$", x.text)


def test_what_fails_validation_stays(spark):
    texts = ["4785380592391138", "999.1.1.1", "2001-02-29", "000-12-3456", "GB83WEST12345698765432", "1234567", "a@b", "x4111111111111111", "41111111111111111111111", "1.2.3.4.5", "plain | text", "", None, "2250-01-01"]
    for t, x in zip(texts, one(spark, *texts), strict=True):
        assert (x.text, x.n_found) == (t or "", 0), t


def test_permutations_are_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = df.select(F.expr(pii.permuted_digits("d", "k", "t")).alias("x")).collect()
    assert len({r.x for r in out}) == 1000 and all(len(r.x) == 3 for r in out)
    days = spark.range(0, 73049, 7).select(F.expr("date_format(date_add(DATE'1900-01-01', cast(id AS INT)), 'yyyy-MM-dd')").alias("d"))
    out = [r[0] for r in days.select(F.expr(pii._date("d", "k"))).collect()]
    assert len(set(out)) == len(out) and min(out) >= "1900-01-01" and max(out) <= "2099-12-31"


def test_pii_edges(spark, none):
    assert pii.pseudonymise(none).count() == 0
    (x,) = one(spark, ("4785380592391139 word " * 3000))
    assert x.n_card == 3000 and "4785380592391139" not in x.text


# --- mixing


def rake(cells, goals, rounds=mixing.ROUNDS):
    f = [dict.fromkeys(g, 1.0) for g in goals]
    for _ in range(rounds):
        for d in range(3):
            for k in goals[d]:
                f[d][k] = goals[d][k] / sum(m * math.prod(f[o][c[o]] for o in range(3) if o != d) for c, m in cells.items() if c[d] == k)
    return {c: math.prod(f[d][c[d]] for d in range(3)) for c in cells}


def test_mixing(spark, none):
    r = random.Random(6)
    rows = []
    for i in range(400):
        text = " ".join(["w"] * r.choice([3, 50, 150, 1200])) + r.choice(["", "", " | x", " Licensed under y"])
        rows.append((i, r.choice([text, text, text, "", None]), r.choice(["hot", "hot", "hot", "b", None]), r.choice(["en", "en", "de", None]), "c"))
    rows += [(5, "w w", "b", "de", "c"), (None, "w", "b", "de", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)

    def topic(t):
        n = len(t.split())
        return "table" if " | " in t else "licensed" if "Licensed under" in t else "note" if n < 100 else "article" if n < 1000 else "long"

    cells = {}
    for _, t, s, g, _ in rows:
        c = (s or "(none)", g or "(none)", topic(t or ""))
        cells[c] = cells.get(c, 0) + len((t or "").split())
    cells = {c: m for c, m in cells.items() if m}
    total = sum(cells.values())
    goals = []
    for d, power in enumerate(mixing.TEMPER.values()):
        raw = {}
        for c, m in cells.items():
            raw[c[d]] = raw.get(c[d], 0) + m
        raw = {k: (m / total) ** power for k, m in raw.items()}
        goals.append({k: total * x / sum(raw.values()) for k, x in raw.items()})
    weight = rake(cells, goals)
    for d in range(3):  # the marginals are met
        for k, goal in goals[d].items():
            assert sum(m * weight[c] for c, m in cells.items() if c[d] == k) == pytest.approx(goal, rel=0.02)
    scale = mixing.KEEP
    for _ in range(mixing.SCALE_ROUNDS):
        scale *= mixing.KEEP * total / sum(m * min(1, scale * weight[c]) for c, m in cells.items())
    for x in got:
        c = (x.source, x.lang, x.topic)
        chance = min(1, scale * weight[c]) if c in weight else 1
        assert x.probability == pytest.approx(chance, abs=2e-6)
        u = int(hashlib.md5(("" if x.doc_id is None else str(x.doc_id)).encode()).hexdigest()[:8], 16) / 2**32
        assert x.sampled == (u < x.probability)
    assert sum(m * min(1, scale * weight[c]) for c, m in cells.items()) == pytest.approx(mixing.KEEP * total, rel=1e-3)
    assert mixing.mix(none).count() == 0


def test_every_source_has_its_own_marginal(spark, monkeypatch):
    """More sources and languages than any bound there was, over several partitions of cells."""
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 40), f"s{i % 1000 if i % 3 else 0}", f"l{i % 130}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one = mixing.mix(docs).collect()
    monkeypatch.setattr(mixing, "TOGETHER", 1500)
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(one) and len({x.source for x in got}) == 1000 and len({x.lang for x in got}) == 130
    for d in ("source", "lang"):
        own, fitted = {}, {}
        for x in got:
            own[x[d]] = own.get(x[d], 0) + x.n_tokens
            fitted[x[d]] = fitted.get(x[d], 0) + x.n_tokens * x.weight
        raw = {k: (n / sum(own.values())) ** mixing.TEMPER[d] for k, n in own.items()}
        for k in raw:
            assert fitted[k] == pytest.approx(sum(own.values()) * raw[k] / sum(raw.values()), rel=0.02)
    named = mixing.mix(docs, topic=lambda text, n: F.when(n > 20, "x")).select("topic").distinct().collect()
    assert {x.topic for x in named} == {"x", "(none)"}


# --- quality


def test_quality(spark, none):
    docs, labels = Q.read(spark, "/root/testdata/sf0.01", "documents"), Q.read(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(r.quality, out[r.doc_id].score) for r in labels.collect() if r.doc_id in out and out[r.doc_id].held_out]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8 and np.mean([s >= 0.3 for s in good]) > 0.98
    again = quality.fit(docs.repartition(7), labels.repartition(3))
    assert (again.weight == model.weight).all() and again.bias == model.bias
    edge = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "x", 5), (2, "the " * 30000, 5)], "doc_id long, text string, score int")
    rows = quality.score(edge, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.accepted(edge, model).columns == edge.columns
    assert quality.score(none, model).count() == 0


@pytest.mark.parametrize(("labels", "low", "high"), [([], 0.49, 0.51), ([1, 1], 0.9, 1), ([0], 0, 0.1)])
def test_quality_with_few_labels(labels, low, high):
    model = quality.train(["a text"] * len(labels), labels)
    assert all(low <= s <= high for s in model.scores(["", "a text"]))


def plain_features(text):
    """Hashes of words, pairs of words and character 3- and 4-grams, one at a time."""
    raw, mask = text.encode(), (1 << 64) - 1
    odd, shift = 0x9E3779B97F4A7C15, 64 - quality.BITS
    words = [sum((c + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(w)) * odd & mask for w in raw.split()]
    words = [w ^ w >> 29 for w in words]
    out = [(w * odd & mask) >> shift for w in words]
    out += [((a * 3 + b * 7) * odd & mask) >> shift for a, b in zip(words, words[1:], strict=False)]
    for n in (3, 4):
        for i in range(len(raw) - n + 1):
            g = 0
            for c in raw[i : i + n]:
                g = (g * 257 + c + 1) & mask
            out.append(((g + (n << 40)) * odd & mask) >> shift)
    return out


def test_quality_by_definition(spark):
    """Every document of a table: vectors looked up and averaged one by one, the softmax taken as it is defined."""
    docs, labels = Q.read(spark, SF, "documents"), Q.read(spark, SF, "labels")
    rows = {r.doc_id: r.text or "" for r in docs.collect()} | {-1: "", -2: "a", -3: " \u00e9 ab"}
    texts, marks = quality.training_rows(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert sorted(texts) == sorted(rows[i] for i in known if i in rows) and sum(marks) == sum(q for i, q in known.items() if i in rows)
    model = quality.train_embeddings(texts, marks)
    more = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(more, quality.fit(docs, labels)).collect()}
    for i, t in rows.items():
        vectors = [model.table[f].astype(float) for f in plain_features(t)]
        mean = sum(vectors) / len(vectors) if vectors else np.zeros(quality.WIDTH)
        z = mean @ model.layer.astype(float) + model.bias
        p = math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))
        assert got[i].score == pytest.approx(p, abs=1e-5) and got[i].predicted == (got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_training_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(1, 40)] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] * 2, "doc_id long, quality int")
    assert len(quality.training_rows(docs, labels, max_bytes=1000)[0]) <= 10
    assert len(quality.training_rows(docs, labels, max_bytes=10)[0]) == 1
    assert 1 < len(quality.training_rows(docs, labels, max_train=7)[0]) <= 7


def test_quality_features_do_not_depend_on_place():
    words = lambda t: set(quality.features(t).tolist())
    assert words("alpha") <= words("xx alpha yy") and len(quality.features("")) == 0
    assert len(quality.features("ab cd")) == 2 + 1 + 3 + 2


# --- web archives


def test_warc(spark, tmp_path):
    r = random.Random(4)
    payloads = ["<p>hot</p>"] * 40 + [None, "", "x" * 200_000] + [f"<html>{r.random()} é</html>" for _ in range(60)]
    rows = [(i, r.choice([f"http://x.org/a b\r\n/{i}", None]), p, "c") for i, p in enumerate(payloads)] + [(39, "http://again", "<p>hot</p>", "c"), (None, "u", "<p>hot</p>", "c"), (None, "u", "lone", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(4)
    archives = warc.write_archives(pages, archive_bytes=20_000).persist()
    got = warc.read_archives(archives, with_payload=True).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, _, p, _ in rows:
        groups.setdefault(p or "", []).append(i)
    for x in got:
        mine = [p for p in groups if x.page_id in groups[p] and len(p.encode()) == x.payload_bytes and base64.b32encode(hashlib.sha1(p.encode()).digest()).decode() == x.payload_digest]
        assert len(mine) == 1
        last = max((i for i in groups[mine[0]] if i is not None), default=None)
        revisit = last is not None and x.page_id != last
        assert (x.record_type, x.refers_to) == (("revisit", last) if revisit else ("response", None))
        assert bytes(x.payload) == (b"" if revisit else mine[0].encode())
    files = warc.export(archives, str(tmp_path))
    assert len(files) > 3 and sum(1 for f in files for _ in warc.unpack(open(f, "rb").read())) == len(rows)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {x.page_id: x.record_type for x in warc.read_archives(warc.write_archives(pages, min_bytes=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archive_is_checked():
    import zstandard

    rows = [warc.record(i, "http://u", b"body %d" % i * 50, None, warc.sha1_base32(b"body %d" % i * 50)) for i in range(30)]
    raw = warc.pack(rows)
    assert list(warc.unpack(raw)) == rows and raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    # The first record can be read by itself with the dictionary in front.
    size = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    assert d.decompressobj().decompress(raw[8 + size :]) == rows[0]
    with pytest.raises(ValueError):
        warc.parse(rows[0].replace(b"body 0", b"body X", 1))
    with pytest.raises(ValueError):
        list(warc.unpack(b"\0" * 40))


# --- the pipeline


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    docs = Q.read(spark, SF, "documents")
    stages = {}
    now = docs
    for name, stage in C.STAGES:
        out = stage(spark, now, SF)
        stages[name] = (now, C.written(out, name))
        now = stages[name][1]
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        before, after = stages[name]
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    before, after = map(texts, stages["quality"])
    model = quality.fit(docs, Q.read(spark, SF, "labels"))
    assert after.keys() == {i for i, t in before.items() if model.scores([t])[0] >= 0.3}
    before, after = map(texts, stages["exact_dedup"])
    assert after.keys() == set({t: i for i, t in sorted(before.items())}.values())
    from test_text_ops import similar_components

    before, after = map(texts, stages["near_dedup"])
    assert after.keys() == {i for i, c in similar_components(before).items() if i == c}
    before, after = map(texts, stages["mixing"])
    assert after.keys() == {r.doc_id for r in mixing.mix(stages["mixing"][0]).collect() if r.sampled}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in now.collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in after.items()}
    assert C.run(spark, SF).exceptAll(now).count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, an empty table."""
    import corpus_pipeline as C

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7)))
    long = " ".join(word() for _ in range(30000))
    texts = [None, "", "", long, long, *(" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(40))]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1, "x", i % 2) for i, t in enumerate(texts)] + [(None, "no id at all", "en", "s", 1, "x", 0), (7, texts[7], "en", "s", 1, "x", 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, kept string, n_tokens int"
    labels = "doc_id long, quality int, toxic int"
    for name, some, marks in (("some", rows, [(i, i % 2, 0) for i in range(5, 40)]), ("none", [], [])):
        folder = tmp_path / name
        spark.createDataFrame(some, kinds).write.parquet((folder / "documents.parquet").as_uri())
        spark.createDataFrame(marks, labels).write.parquet((folder / "labels.parquet").as_uri())
        docs = Q.read(spark, folder.as_uri(), "documents")
        for stage, function in C.STAGES:
            after = C.written(function(spark, docs, folder.as_uri()), stage)
            if stage != C.STAGES[-1][0]:
                assert after.columns == docs.columns and after.exceptAll(docs).count() == 0
                docs = after
        ids = [x.doc_id for x in after.collect()]
        assert len(ids) == docs.count() and (name == "none") == (not ids)
        assert not {1, 3} & set(ids)  # of equal texts the largest id stays
        assert ids.count(7) in (0, 2)


@pytest.mark.parametrize(
    ("text", "shape", "found"),
    [
        ("jörg@web.de", r"[a-z]ö[a-z]{2}@[a-z]{3}\.[a-z]{2}\.invalid", 1),
        ("müller.é9@x.org", r"[a-z]ü[a-z]{4}\.é[0-9]@[a-z]\.[a-z]{3}\.invalid", 1),
        ("0171/1234567", r"0171/[0-9]{7}", 1),
        ("+4930123456789", r"\+49[0-9]{11}", 1),
        ("+14155552671", r"\+1[0-9]{10}", 1),
        ("score +10 20 30 40", r"score \+10 20 30 40", 0),
        ("é4111111111111111", "é4111111111111111", 0),
    ],
)
def test_pii_in_other_letters_and_forms(spark, text, shape, found):
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key="k").first()
    assert re.fullmatch(shape, got.text) and got.n_found == found and (got.text != text) == bool(found)


def test_rounds_of_raking_broadcast_nothing(spark, monkeypatch):
    """Each broadcast would stay in the driver until it collects its garbage."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    written = mixing.written
    monkeypatch.setattr(mixing, "written", kept)
    cells = spark.createDataFrame([("a", "x", "t", 5), ("a", "y", "u", 3), ("b", "x", "u", 9)], "source string, lang string, topic string, m long")
    mixing.rake(cells, rounds=2)
    rounds = [plan for name, plan in plans if name in ("factors", "weights")][1:]
    assert rounds and all("ShuffledHashJoin" in plan and "Broadcast" not in plan and "Exchange" not in plan for plan in rounds)
