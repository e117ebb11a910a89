"""Search: phrases of an index that match a query, most frequent first, alone or spliced from several.

The score of a phrase is its prefix count.  Splicing joins phrases at spaces; a spliced text scores
``C(last) * product of C(earlier) / N * restart``.  A search picks the cheapest form that is exact: key equality for
anagrams of letters and for telephone digits, native regular expressions where the query has no inner intersection or
anagram, and else the automaton over Arrow batches, behind a range filter that reaches the Parquet scan.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import text as T
from lexiloom.plans import pattern as P

RESTART = 1e-6
#: Results on a page (fixed value).
PAGE_SIZE = 100
#: Seconds after which a page's search is stopped (fixed value).
SECONDS = 30.0
#: Paths that a page's search may look at before it asks whether to go on with twice as many (fixed value).
BUDGET = 1_000_000
#: Distinct automaton states that one round of splicing may bring to the driver.
MAX_STATES = 100_000


@dataclass
class Plan:
    """How a query is evaluated: a native condition, and whether the automaton must still confirm."""

    condition: Column | None
    confirm: bool
    form: str
    tree: tuple = field(default=())


def _within_beginnings(texts: list[str]) -> Column | None:
    """Phrases that start with one of the texts; None for all of them."""
    if "" in texts:
        return None
    if not texts:
        return F.lit(False)
    ranges = [(F.col("text") >= t) & (F.col("text") < t[:-1] + chr(ord(t[-1]) + 1)) for t in texts]
    # The first character prunes the partitions, the ranges reach the row groups.
    return F.col("first_ch").isin(sorted({t[0] for t in texts})) & reduce(lambda x, y: x | y, ranges)


def _all_of(terms: list[Column | None]) -> Column | None:
    some = [t for t in terms if t is not None]
    return reduce(lambda x, y: x & y, some) if some else None


def plan(query: str) -> Plan:
    """The plan of a query; raises PatternSyntaxError."""
    tree = P.parse(query)
    letters = P.letters_of(tree)
    if letters:
        return Plan((F.col("n_letters") == len(letters)) & (F.col("letters_key") == letters), False, "key", tree)
    least, most = P.letter_bounds(tree)
    a = P.Matcher("pattern", query).automaton()
    terms = [_within_beginnings(P.beginnings(a, a.start)), F.col("n_letters") >= least if least else None, F.col("n_letters") <= most if most is not None else None]
    regexes = P.to_regexes(tree)
    terms += [F.col("text").rlike(x) for x in regexes or ()]
    return Plan(_all_of(terms), not regexes, "regex" if regexes else "automaton", tree)


def explain(query: str) -> dict:
    """What a query is turned into, with the size of its automaton for texts seen so far."""
    p = plan(query)
    a = P.Matcher("pattern", query).automaton()
    return {"form": p.form, "regexes": P.to_regexes(p.tree), "prefix": P.literal_prefix(P.with_end(p.tree))[0], "letters": P.letter_bounds(p.tree), "states": len(a.nodes), "moves": len(a.moves)}


def accepted(matcher: P.Matcher) -> Column:
    """Whether a column of texts matches, by the automaton in Arrow batches."""

    @F.pandas_udf("boolean")
    def accepts(texts):
        import pandas as pd

        a = matcher.automaton()
        given = texts.tolist()
        order = sorted(range(len(given)), key=given.__getitem__)
        out = [False] * len(given)
        for i, state in P.walk(a, a.start, [given[i] for i in order]):
            out[order[i]] = a.nullable(state)
        return pd.Series(out, dtype=bool)

    return accepts(F.col("text"))


def matches(index: DataFrame, query: str) -> DataFrame:
    """The rows of the index that a query matches."""
    p = plan(query)
    rows = index if p.condition is None else index.filter(p.condition)
    return rows.filter(accepted(P.Matcher("pattern", query))) if p.confirm else rows


def _results(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    out = rows.select(F.col("c").cast("double").alias("score"), F.rtrim("text").alias("text")).orderBy(F.desc("score"), "text")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def find(index: DataFrame, query: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """score and text of the matching phrases, by falling score, then by text."""
    return _results(matches(index, query), limit, offset)


def find_anagrams(index: DataFrame, letters: str, limit: int | None = None) -> DataFrame:
    """Phrases with exactly these letters, spaces free; letters in upper case or spaces match nothing."""
    good = bool(letters) and set(letters) <= P.LETTERS | P.DIGITS
    key = "".join(sorted(letters))
    rows = index.filter((F.col("n_letters") == len(key)) & (F.col("letters_key") == key)) if good else index.filter(F.lit(False))
    return _results(rows, limit)


def find_phone_words(index: DataFrame, digits: str, limit: int | None = None) -> DataFrame:
    """Phrases that a telephone's keys spell with these digits, spaces free."""
    good = bool(digits) and set(digits) <= P.DIGITS
    rows = index.filter((F.col("n_letters") == len(digits)) & (F.col("phone_key") == digits)) if good else index.filter(F.lit(False))
    return _results(rows, limit)


# ---------------------------------------------------------------------------------------------------------------------
# Splicing


def _usable(index: DataFrame, matcher: P.Matcher) -> DataFrame:
    """The phrases that may be part of a match: no more letters than it, none that it cannot have."""
    if matcher.kind == "pattern":
        tree = P.parse(matcher.query)
        most, chars = P.letter_bounds(tree)[1], P.characters(tree)
    else:
        most = len(matcher.query)
        chars = frozenset(matcher.query) if matcher.kind == "anagram" else frozenset(c for c, d in P.KEY_OF.items() if d in matcher.query)
    some = "".join(sorted(chars - P.SPACE))
    terms = [F.col("n_letters") <= most if most is not None else None, F.col("text").rlike(f"^[{some} ]+$") if some and len(some) < len(P.ALL) - 1 else None, F.col("first_ch").isin(*some) if some else None]
    condition = _all_of(terms)
    rows = index if condition is None else index.filter(condition)
    return rows.select("text", "first_ch", F.col("c").cast("long").alias("c"), F.col("n_words").cast("int").alias("n_words"))


def _transitions(index: DataFrame, matcher: P.Matcher, states: list[tuple[str, str]]) -> DataFrame:
    """(from_key, phrase, c, n_words, to_key, accept) of every phrase that keeps a state alive.

    A state is known by a text that leads to it; workers build it again from that text.  Only phrases that begin as one
    of the states allows are read.
    """
    a = matcher.automaton()
    starts = {t for _, text in states for t in P.beginnings(a, a.run(text))}
    starts = starts if len(starts) <= 64 else {t[:1] for t in starts}
    condition = _within_beginnings(sorted(starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = matcher.automaton()
        begun = [(key, a.run(text)) for key, text in states]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            texts = [r[0] for r in rows]
            out = [(key, *rows[i], a.name(s), a.nullable(s)) for key, state in begun for i, s in P.walk(a, state, texts)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["from_key", "phrase", "c", "n_words", "to_key", "accept"])

    rows = index if condition is None else index.filter(condition)
    return rows.select("text", "c", "n_words").mapInArrow(run, "from_key string, phrase string, c long, n_words int, to_key string, accept boolean")


@dataclass
class Spliced:
    """What a splicing search found, whether that is all of it, and how many paths it looked at."""

    rows: DataFrame
    complete: bool
    paths: int


def splice_search(index: DataFrame, matcher: P.Matcher, n_total: int, limit: int | None = None, max_words: int | None = None, restart: float = RESTART, quirk: bool = True, budget: int | None = None, progress: Callable[[int, int, int], None] | None = None) -> Spliced:
    """Single and spliced phrases, (score, text) by falling score.

    Rounds go by number of words: once all shorter texts are extended, every path to a text of ``w`` words is known.
    With ``quirk`` the best path to an accepted text is a result and is not extended, as in a best-first search that
    returns before it restarts; its other paths are.  Scores never rise along a path, so paths below the worst of
    ``limit`` results go.  Queries that match without end need ``limit``, ``max_words`` or a ``budget`` of paths, which
    is looked at between rounds.  ``progress`` is told words, paths and results after each.

    Each round's tables are in the shared folder and replace the ones before.
    """
    spark = index.sparkSession
    a = matcher.automaton()
    if a.start is None or a.start == a.none:
        return Spliced(spark.createDataFrame([], "score double, text string"), True, 0)
    known = {a.name(a.start): ""}
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(session.written(df, "splice"))
        return kept[-1]

    def best_of(rounds: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.filter("accept AND rank = 1").select("score", "text") for r in rounds])

    usable = keep(_usable(index, matcher).hint("rebalance"))
    moves = [keep(_transitions(usable, matcher, list(known.items())))]
    pending = moves[0].select(F.col("phrase").alias("text"), F.col("c").cast("double").alias("score"), F.col("to_key").alias("key"), "accept", "n_words")
    rounds: list[DataFrame] = []
    step, worst, paths, complete = F.lit(float(n_total)), 0.0, 0, False
    while True:
        waiting = {r["n_words"]: r["count"] for r in pending.groupBy("n_words").count().collect()}
        if not waiting:
            complete = True
            break
        words = min(waiting)
        if max_words is not None and words > max_words or budget is not None and paths + sum(waiting.values()) > budget:
            break
        paths += waiting[words]
        ranked = keep(pending.filter(F.col("n_words") == words).withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "key"))))
        rounds.append(ranked)
        further = (ranked.filter("NOT (accept AND rank = 1)") if quirk else ranked) if restart > 0 else ranked.filter(F.lit(False))
        if limit is not None:
            last = best_of(rounds).orderBy(F.desc("score")).offset(limit - 1).limit(1).collect()
            worst = last[0]["score"] if last else 0.0
            further = further.filter(F.col("score") * F.lit(restart) >= worst)
        found = further.groupBy("key").agg(F.min("text").alias("text")).limit(MAX_STATES + len(known) + 1).collect()
        fresh = [(r["key"], r["text"]) for r in found if r["key"] not in known]
        if len(fresh) > MAX_STATES:
            raise P.QueryTooLargeError(f"the query reaches more than {MAX_STATES} states")
        if fresh:
            known.update(fresh)
            moves.append(keep(_transitions(usable, matcher, fresh)))
        rest = pending.filter(F.col("n_words") > words) if len(waiting) > 1 else None
        if found:
            longer = further.select("text", "score", F.col("key").alias("from_key"), F.col("n_words").alias("had")).join(reduce(DataFrame.unionByName, moves), "from_key")
            longer = longer.select(F.concat("text", "phrase").alias("text"), (F.col("score") / step * F.lit(restart) * F.col("c")).alias("score"), F.col("to_key").alias("key"), "accept", (F.col("had") + F.col("n_words")).alias("n_words"))
            rest = longer if rest is None else rest.unionByName(longer)
        if progress is not None:
            progress(words, paths, best_of(rounds).count())
        if rest is None:
            complete = True
            break
        pending = keep(rest.filter(F.col("score") >= worst) if worst else rest)
    results = session.written(best_of(rounds), "spliced") if rounds else spark.createDataFrame([], "score double, text string")
    for old in kept:
        session.drop_written(old)
    out = results.groupBy("text").agg(F.max("score").alias("score")).select("score", F.rtrim("text").alias("text")).orderBy(F.desc("score"), "text")
    return Spliced(out if limit is None else out.limit(limit), complete, paths)


def splice(index: DataFrame, matcher: P.Matcher, n_total: int, limit: int | None = None, max_words: int | None = None, restart: float = RESTART, quirk: bool = True) -> DataFrame:
    """The rows of ``splice_search``."""
    return splice_search(index, matcher, n_total, limit, max_words, restart, quirk).rows


@dataclass
class Page:
    """A page of results and how the search went: ``done``, ``none``, ``next``, ``budget``, ``killed`` or ``error``."""

    outcome: str
    rows: DataFrame | None = None
    start: int = 0
    num: int = PAGE_SIZE
    next_start: int | None = None
    next_budget: int | None = None
    message: str = ""


def _within(spark: SparkSession, seconds: float | None, job):
    """The result of ``job``, or None if its Spark jobs took longer than ``seconds`` and were cancelled."""
    if seconds is None:
        return job()
    group, late = f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "search", interruptOnCancel=True)
    timer.start()
    try:
        return job()
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def search_page(index: DataFrame, query: str, start: int = 0, num: int = PAGE_SIZE, n_total: int | None = None, max_words: int | None = None, seconds: float | None = SECONDS, budget: int | None = BUDGET) -> Page:
    """Rows ``start`` to ``start + num`` of a query's results, with the font size that shows each score.

    With ``n_total`` spliced phrases count too.  If ``budget`` paths or ``max_words`` words ended the search before it
    was complete, the outcome of a short page is ``budget``, and ``next_budget`` is what to ask for next.  A search that
    takes longer than ``seconds``, or whose automaton outgrows its memory, is ``killed``.
    """
    query = query.strip()
    spark = index.sparkSession
    complete = True

    def job() -> list:
        nonlocal complete
        if n_total is None:
            return _results(matches(index, query), num + 1, start).collect()
        got = splice_search(index, P.Matcher("pattern", query), n_total, start + num + 1, max_words, budget=budget)
        complete = got.complete
        return got.rows.collect()[start:]

    try:
        plan(query)
        rows = _within(spark, seconds, job)
    except P.PatternSyntaxError as e:
        return Page("error", message=str(e))
    except P.QueryTooLargeError as e:
        return Page("killed", start=start, num=num, message=str(e))
    if rows is None:
        return Page("killed", start=start, num=num, message=f"stopped after {seconds} s")
    shown = spark.createDataFrame(rows[:num], "score double, text string").withColumn("font_size", T.font_size(F.col("score")))
    more = len(rows) > num
    short = "budget" if not complete else "done" if rows or start else "none"
    return Page("next" if more else short, shown, start, num, start + num if more else None, None if complete or more or budget is None else 2 * budget)
