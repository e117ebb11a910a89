"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Every document falls into a cell by source, language and topic.  The cells' token counts are raked: in turn the
sources, languages and topics are scaled so that their totals meet the target marginals, until nothing moves any more
or ``ROUNDS`` times.  The fitted count of a cell over its own count is its documents' weight.  Probabilities are
``min(1, scale * weight)``, with the scale calibrated so that the expected tokens kept are ``KEEP`` of all; a document
is drawn if a number made from its id falls below its probability, so a draw repeats in every run and on every cluster.

Targets: each marginal's own shares raised to ``TEMPER`` and normalised; less than 1 lifts small categories.
The topic of a text is its form (``topic_of``) unless the caller gives a column of topics.

The cells, the factors and the goals are tables, and every category has a marginal of its own however many there are.
A round is one job over them: sources are fitted inside their own cells, languages and topics over their sums by both.
Tables of up to ``TOGETHER`` cells are one partition, so their rounds shuffle nothing.

Defined results: null sources, languages and topics are categories of their own (``(none)``); null and empty texts have
no tokens and take their cell's probability, 1 in a cell without tokens; a null id is drawn as an empty one; rows that
repeat an id are drawn together; an empty table gives an empty result; columns other than the id, the text, the source
and the language are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import drop_written, join_by_key, text_of, written

ROUNDS, SCALE_ROUNDS, KEEP = 40, 40, 0.5
#: Cells of one partition, and the largest relative move of a factor that ends the rounds.
TOGETHER, STILL = 200_000, 1e-12
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
TOPICS = ("table", "licensed", "note", "article", "long")
DIMS = ("source", "lang", "topic")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The form of a text."""
    return F.when(text.contains(" | "), "table").when(text.contains("Licensed under"), "licensed").when(n_tokens < 100, "note").when(n_tokens < 1000, "article").otherwise("long")


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """id, source, lang, topic and n_tokens of every row, without the text."""
    none = lambda c: F.coalesce(c, F.lit("(none)"))
    rows = docs.select(F.col(id_col), none(F.col("source")).alias("source"), none(F.col("lang")).alias("lang"), text_of(text_col).alias("t"))
    rows = rows.withColumn("n_tokens", F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    return rows.select(id_col, "source", "lang", none(topic(F.col("t"), F.col("n_tokens"))).alias("topic"), "n_tokens")


def _goals(cells: DataFrame, d: str, total: float, temper: float) -> DataFrame:
    """The target of every category of a dimension."""
    raw = cells.groupBy(d).agg(F.pow(F.sum("m") / total, F.lit(float(temper))).alias("raw"))
    every = raw.agg(F.sum("raw")).first()[0]
    return raw.select(d, (F.lit(total) * F.col("raw") / F.lit(every)).alias(f"goal_{d}"))


def rake(cells: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """source, lang, topic, weight and probability of every cell (source, lang, topic, m) with tokens."""
    temper = temper or TEMPER
    cells = cells.filter("m > 0").select(*DIMS, F.col("m").cast("double").alias("m"))
    count, total = cells.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0.0))).first()
    parts = max(1, -(-count // TOGETHER))

    def together(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if parts == 1 else df

    cells = together(cells)
    held = together(written(cells.join(_goals(cells, "source", total, temper["source"]), "source"), "cells"))
    factors = cells.select("lang", "topic").distinct().join(_goals(cells, "lang", total, temper["lang"]), "lang").join(_goals(cells, "topic", total, temper["topic"]), "topic")
    table = written(factors.select("lang", "topic", "goal_lang", "goal_topic", F.lit(1.0).alias("was"), F.lit(1.0).alias("f")), "factors")
    factors = together(table)
    by = lambda d: Window.partitionBy(d)

    def by_source(f: str) -> DataFrame:
        """The cells with the factor of their source, given the others' factors."""
        # Tables of one partition meet where they are; a broadcast would leave a table of its own in the driver every round.
        near = factors.hint("shuffle_hash") if parts == 1 else factors
        return held.join(near, ["lang", "topic"]).withColumn("f_source", F.col("goal_source") / F.sum(F.col("m") * F.col(f)).over(by("source")))

    for _ in range(rounds):
        sums = by_source("f").groupBy("lang", "topic").agg(F.sum(F.col("m") * F.col("f") * F.col("f_source")).alias("s"), *[F.first(c).alias(c) for c in ("goal_lang", "goal_topic", "f")])
        sums = sums.withColumn("f_lang", F.col("goal_lang") / F.sum("s").over(by("lang")))
        sums = sums.withColumn("f_topic", F.col("goal_topic") / F.sum(F.col("s") * F.col("f_lang")).over(by("topic")))
        new = written(sums.select("lang", "topic", "goal_lang", "goal_topic", F.col("f").alias("was"), (F.col("f") * F.col("f_lang") * F.col("f_topic")).alias("f")), "factors")
        drop_written(table)
        table, factors = new, together(new)
        if (factors.agg(F.max(F.abs(F.col("f") / F.col("was") - 1))).first()[0] or 0) < STILL:
            break
    # The sources' factors are those of the last round, before it moved the others'.
    fitted = together(written(by_source("was").select(*DIMS, "m", (F.col("f_source") * F.col("f")).alias("weight")), "weights"))
    scale = keep
    for _ in range(SCALE_ROUNDS):
        # The kept tokens are linear in the scale but where cells come to be kept whole, so this ends exactly.
        whole = F.col("weight") * scale >= 1
        full, slope = fitted.agg(F.coalesce(F.sum(F.when(whole, F.col("m"))), F.lit(0.0)), F.sum(F.when(~whole, F.col("m") * F.col("weight")))).first()
        new = (keep * total - full) / slope if slope else scale
        if new <= scale:
            break
        scale = new
    return fitted.select(*DIMS, "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("probability"))


def drawn(key: Column) -> Column:
    """A number in [0, 1) made from an id."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, temper: dict[str, float] | None = None, topic: Callable[[Column, Column], Column] = topic_of) -> DataFrame:
    """id, source, lang, topic, n_tokens, weight, probability and sampled of every row; ``topic`` is made from (text, n_tokens)."""
    rows = written(marks(docs, id_col, text_col, topic), "marks")
    cells = written(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("m"), F.count("*").alias("n")), "cells")
    fitted = written(cells.drop("m").join(rake(cells, keep, temper), list(DIMS), "left"), "fitted")
    out = join_by_key(rows, fitted, list(DIMS), "n", fitted.agg(F.sum("n")).first()[0] or 0)
    chance = F.round(F.coalesce("probability", F.lit(1.0)), 6)
    return out.select(id_col, *DIMS, "n_tokens", F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight"), chance.alias("probability"), (drawn(F.col(id_col)) < chance).alias("sampled"))
