"""Search and splicing against a plain best-first search, and what a plan pushes down."""

import heapq
import html
import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import markup
from lexiloom.functions import text as T
from lexiloom.operators import index as I
from lexiloom.operators import search as S
from lexiloom.plans.pattern import Matcher, PatternSyntaxError
from lexiloom.sources import readers as R
from lexiloom.streaming.incremental import compact, current_counts, stream_counts


def index_of(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "text string, c long")
    return I.indexed(df).persist()


def best_first(counts, matcher, total, restart=1e-6, most=3000):
    """Pops the highest score; a new accepted text is returned before its path may start again at the root."""
    a = matcher.automaton()
    nodes = {p for t in counts for p in (t[:i] for i in range(len(t) + 1))}
    c = {p: sum(n for t, n in counts.items() if t == p) or max((n for t, n in counts.items() if t.startswith(p)), default=0) for p in nodes}
    heap, seen, out, k = [(-float("inf"), 0, "", "", a.start, 1.0, True)], set(), [], 0
    while heap and k < most:
        neg, _, text, node, state, scale, fresh = heapq.heappop(heap)
        k += 1
        if node == "" or not fresh:
            pass
        for ch in {p[len(node)] for p in nodes if len(p) == len(node) + 1 and p.startswith(node)}:
            s = a.step(state, ch)
            if s != a.none and s is not None:
                heapq.heappush(heap, (-scale * c[node + ch], k * 64 + ord(ch), text + ch, node + ch, s, scale, True))
        if node and node.endswith(" "):
            score = scale * c[node]
            if a.nullable(state) and text not in seen:
                seen.add(text)
                out.append((score, text.rstrip()))
                continue
            heapq.heappush(heap, (-(score / total * restart) * max(c.values()), k * 64, text, "", state, score / total * restart, False))
    return out


QUERIES = ['"(a|b|ab)( (a|b|c))?( (b|c))?"', "<abc>", "a[bc]*&___", '"a (b|c) a"', "(a&_)(b|c){1,2}"]


@pytest.mark.parametrize("query", QUERIES)
def test_splice_is_best_first(spark, query):
    rng = random.Random(len(query))
    counts = {}
    for t in ("a ", "b ", "c ", "ab ", "a b ", "a c ", "b c ", "c a ", "a b c "):
        up = t[: t[:-1].rfind(" ") + 1]
        counts[t] = rng.randint(2, counts.get(up, 60)) if up in counts or not up else rng.randint(1, 3)
    total = sum(n for t, n in counts.items() if t.count(" ") == 1)
    m = Matcher("pattern", query)
    want = {}
    for score, text in best_first(counts, m, total):
        want.setdefault(text, score)
    got = {r.text: r.score for r in S.splice(index_of(spark, counts), m, total, limit=None, max_words=6).collect()}
    assert got.keys() == want.keys()
    assert all(got[t] == pytest.approx(want[t], rel=1e-12) for t in got)


def test_splice_joins_phrases(spark):
    index = index_of(spark, {"new ": 20, "new york ": 10, "york ": 9, "york city ": 4, "city ": 6})
    got = S.splice(index, Matcher("pattern", '"new york york city"'), 35).collect()
    assert [(r.text, r.score) for r in got] == [("new york york city", 10 / 35 * 1e-6 * 4)]
    assert S.splice(index, Matcher("pattern", '"new york york city"'), 35, restart=0).count() == 0
    assert S.splice(index, Matcher("pattern", "foo&bar"), 35).count() == 0
    assert S.splice(index, Matcher("anagram", "X"), 35).count() == 0
    top = S.splice(index, Matcher("pattern", ".*"), 35, limit=5).collect()
    assert [r.score for r in top] == [20, 10, 9, 6, 4]


def test_first_accepted_path_is_not_extended(spark):
    counts = {"a ": 8, "b ": 6, "a b ": 4}
    index = index_of(spark, counts)
    m = Matcher("pattern", '"a( b)?( a)?"')
    # The accepted "a" is not extended, so "a a" has no path at all; "a b a" has one by "a b" only if that is not first.
    got = {r.text for r in S.splice(index, m, 14, limit=None).collect()}
    free = {r.text for r in S.splice(index, m, 14, limit=None, quirk=False).collect()}
    assert got == {"a", "a b"} and free == {"a", "a b", "a a", "a b a"}


def test_find(spark):
    index = index_of(spark, {"the ": 9, "the cat ": 4, "then ": 4, "cat ": 5, "act ": 5, "t he ": 1})
    rows = lambda df: [(r.score, r.text) for r in df.collect()]
    assert rows(S.find(index, "the_*")) == [(9.0, "the"), (4.0, "the cat"), (4.0, "then"), (1.0, "t he")]
    assert rows(S.find(index, "the_*", limit=2, offset=1)) == [(4.0, "the cat"), (4.0, "then")]
    assert rows(S.find_anagrams(index, "tca")) == [(5.0, "act"), (5.0, "cat")] == rows(S.find(index, "<cat>"))
    assert rows(S.find_anagrams(index, "TCA")) == [] == rows(S.find_anagrams(index, ""))
    assert rows(S.find_phone_words(index, "843")) == [(9.0, "the"), (1.0, "t he")]
    assert rows(S.find(index, "(c?a?t?&_{3})")) == [(5.0, "cat")]
    assert rows(S.find(index, "<(ca)t>|foo")) == [(5.0, "cat")]
    with pytest.raises(PatternSyntaxError):
        S.find(index, "a**")
    assert [S.explain(q)["form"] for q in ("the_*", "<cat>", "<(ca)t>")] == ["regex", "key", "automaton"]


def test_pages(spark):
    index = index_of(spark, {f"a{c} ": 30 - i for i, c in enumerate("bcdefg")})
    one = S.search_page(index, " a_ ", 0, 4)
    assert one.outcome == "next" and one.next_start == 4 and [r.text for r in one.rows.collect()] == ["ab", "ac", "ad", "ae"]
    assert S.search_page(index, "a_", 4, 4).outcome == "done"
    assert S.search_page(index, "zz").outcome == "none"
    assert S.search_page(index, "a**").outcome == "error"
    spliced = S.search_page(index, '"ab ac"', n_total=165)
    assert spliced.outcome == "done" and [(r.text, r.score) for r in spliced.rows.collect()] == [("ab ac", 30 / 165 * 1e-6 * 29)]
    assert S.search_page(index, '"ab xx"', n_total=165).outcome == "none"


def test_budget_can_be_doubled(spark):
    """A search whose budget is spent says so, and a larger one finds the rest."""
    index = index_of(spark, {f"a{c} ": 30 - i for i, c in enumerate("bcdefg")})
    query = '"a_( a_){2}|a_( a_)*x"'
    one = S.search_page(index, query, 0, 1000, n_total=165, budget=50)
    assert (one.outcome, one.next_budget, one.rows.count()) == ("budget", 100, 0)
    more = S.search_page(index, query, 0, 1000, n_total=165, budget=4 * one.next_budget)
    assert (more.outcome, more.next_budget, more.rows.count()) == ("done", None, 6**3)
    short = S.search_page(index, query, 0, 1000, n_total=165, max_words=1, budget=None)
    assert (short.outcome, short.next_budget) == ("budget", None)


def test_progress_is_told(spark):
    index = index_of(spark, {"a ": 8, "b ": 6, "a b ": 4})
    told = []
    got = S.splice_search(index, Matcher("pattern", "<abb>"), 14, progress=lambda *x: told.append(x))
    assert got.complete and {r.text for r in got.rows.collect()} == {"b a b", "a b b", "b b a"} and [x[0] for x in told] == [1, 2, 3] and told[-1][2] == 3
    assert S.splice_search(index, Matcher("pattern", "<abb>"), 14, max_words=2).complete is False


def test_large_queries_are_killed(spark, monkeypatch):
    index = index_of(spark, {"a ": 8})
    monkeypatch.setattr("lexiloom.plans.pattern.Automaton.MOST_NODES", 50)
    assert S.search_page(index, "<abcdefghijk>&_*&__*", n_total=8).outcome == "killed"


def test_slow_searches_are_stopped(spark):
    index = spark.range(0, 1 << 40, 1, 4).selectExpr("concat('a', id, ' ') AS text", "id AS c", "'a' AS first_ch", "6 AS n_letters")
    assert S.search_page(index, "a_*b", seconds=3.0).outcome == "killed"
    assert spark.range(5).count() == 5


def test_range_reaches_the_scan(spark, tmp_path):
    path = (tmp_path / "i").as_uri()
    R.save_index(index_of(spark, {"the ": 9, "then ": 4, "cat ": 5}), path)
    found = S.find(R.load_index(spark, path), '"the_*"')
    several = S.find(R.load_index(spark, path), '"(the|tha|c)_*"')._jdf.queryExecution().executedPlan().toString()
    assert "IN (c,t)" in several.split("PartitionFilters")[1].split("PushedFilters")[0] and "Or(And(GreaterThanOrEqual(text,c),LessThan(text,d))" in several
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(text,the)" in plan and "LessThan(text,thf)" in plan
    assert "PartitionFilters: [isnotnull(first_ch" in plan and "Python" not in plan
    assert [r.text for r in found.collect()] == ["the", "then"]


def test_scores_as_printed(spark):
    values = [0.0, 1.0, 12345678.0, 123456789.0, 0.1, 1.23456789e-5, 9.99999999e-5, 99999999.9, 3.0e-18, 1.5e100, 0.00012345678, 1234.5]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert [r[0] for r in df.select(T.formatted_score(F.col("s"))).collect()] == ["%.8g" % v for v in values]
    sizes = [r[0] for r in df.select(T.font_size(F.col("s"))).collect()]
    assert sizes[0] == 0.4 and sizes[1] == 1.5 and min(sizes) == 0.4


def test_page_texts(spark):
    df = spark.createDataFrame([("<a href=\"x\">'&</a> b~*+%é",)], "t string")
    row = df.select(T.html_escape(F.col("t")).alias("h"), T.url_quote(F.col("t")).alias("u")).first()
    text = df.first()[0]
    assert row.h == html.escape(text) and row.u == quote(text, safe="")
    found = S.find(index_of(spark, {"the ": 1234567, "then ": 3}), "the_*")
    assert [r[0] for r in found.select(R.result_lines(found)).collect()] == ["1234567 the", "3 then"]


@pytest.mark.parametrize(
    ("raw", "plain"),
    [
        ("a<!-- x\ny -->b", "ab"), ("a<ref>x</ref>b<ref name=y/>c", "ab c"), ("a<gallery>p</gallery>b", "ab"), ("[[File:x [[y]] z]]b", "b"), ("{| t | u |}x", "x"), ("a{{b{{c}}d}}e", "ae"),
        ("a<br/>b</p >c", "a b c"), ("x&nbsp;y&AMP;z", "x y z"), ("[[a|b]]", "a"), ("[[a]]", "a"), ("[http://x.y z w]", " z w"), ("[https://x]", ""), ("plain", "plain"), ("", ""), (None, None),
    ],
)
def test_markup(spark, raw, plain):
    df = spark.createDataFrame([(raw,)], "t string")
    assert markup.strip_markup(df, "t").first()[0] == plain


MARKS = ["<!--", "-->", "<ref>", "</ref>", "<ref name=x/>", "<Gallery a=b>", "</gallery>", "[[", "]]", "|", "file:", "{{", "}}", "{|", "|}", "<br/>", "<b>", "&amp;", "&x;", "[http://a.b c]", "[", "]", "a b", "c", "\n", "/", ">", "<imagemap>", "</imagemap>", "[ftp://x]", "\u017f"]


def test_native_markup_is_the_loop(spark):
    """Texts of random marks, nested and overlapping."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for kind in markup.LINK_TEXTS:
        got = {r.i: r.o for r in markup.strip_markup(df.withColumn("o", F.col("t")), "o", kind).collect()}
        assert all(got[i] == markup.strip_text(t, kind) for i, t in enumerate(texts))


def test_markup_label_and_marks(spark):
    df = spark.createDataFrame([("[[a|b]] BEGIN ARTICLE end article",)], "t string")
    assert markup.strip_markup(df, "t", "label").first()[0].startswith("b ")
    assert df.select(markup.escape_article_marks(F.col("t"))).first()[0] == "[[a|b]] >BEGIN ARTICLE >end article"
    with pytest.raises(ValueError):
        markup.strip_markup(df, "t", "x")


def test_streaming_counts_once(spark, tmp_path):
    src, base = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    run = lambda: stream_counts(spark.readStream.text(src.as_uri()).withColumnRenamed("value", "line"), (base / "c").as_uri(), (base / "p").as_uri()).awaitTermination()
    (src / "1.txt").write_text("the cat\nthe dog\n")
    run()
    (src / "2.txt").write_text("the cat\n")
    run()
    run()
    got = {r.chain: r.n for r in current_counts(spark, (base / "c").as_uri()).collect()}
    assert got == {"the cat ": 2, "cat ": 2, "the dog ": 1, "dog ": 1}
    compact(spark, (base / "c").as_uri(), (base / "all").as_uri())
    assert spark.read.parquet((base / "all").as_uri()).count() == 4


def test_markup_that_a_later_rule_opens_stays_native(spark):
    """A link inside a link into a namespace goes first, and the loop back to the first rule with what is left."""
    texts = ["[[File:a|x [[b]] y]]c", "{{t|{{u}}}}[[File:a|x [[b|d]] y]] <b>e</b> &nbsp;[http://x.org/a f]", "[[a:[[b:[[c]]]]]] d", "&<b>lt;", "<<b>b>", "[[[[a]]]]", "{{{{{{{{{{a}}}}}}}}}}", "plain", "", "[http://[[x]] y]"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r.t, r.same) for r in df.select(markup._natively(F.col("text"), "target").alias("s")).select("s.*").collect()]
    assert [same for _, same in got[:2]] == [True, True]
    for text, (native, same) in zip(texts, got, strict=True):
        assert not same or native == markup.strip_text(text)
    assert [r.text for r in markup.strip_markup(df).collect()] == [markup.strip_text(t) for t in texts]


def test_streamed_chains_are_shuffled_once(spark, tmp_path):
    src, counts, done = tmp_path / "in", (tmp_path / "c").as_uri(), (tmp_path / "p").as_uri()
    src.mkdir()
    (src / "1.txt").write_text("the cat\nthe cat\nthe dog\n")
    lines = spark.readStream.text(src.as_uri()).withColumnRenamed("value", "line")
    query = stream_counts(lines, counts, done)
    query.awaitTermination()
    # A row a chain of the text: nothing was brought together for the batch.
    assert spark.read.parquet(counts).count() == 6
    plan = current_counts(spark, counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert {r.chain: r.n for r in current_counts(spark, counts).collect()} == {"the cat ": 2, "cat ": 2, "the dog ": 1, "dog ": 1}


def test_added_chains_are_not_held_before_their_shuffle(spark):
    """A map of chains before it, of which nearly all are different, spilled."""
    plan = I.chain_counts(spark.range(9).selectExpr("concat('a ', id) AS line"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "HashAggregate" not in below
