"""Removal of encyclopaedia markup.

The rules apply until none changes anything, starting again at the first after every change.  ``strip_markup`` takes a
few rounds of them in native expressions; a row whose rounds are not the same as those of the loop, because it still has
markup or because a later rule made work for an earlier one, goes through the loop itself in Arrow batches.
"""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a link may hold: no two brackets in a row, and a lone one takes the next character with it.
_HELD = r"(?:[\[\]]?[^\[\]])*?"
#: The constructs of the markup language that go whole, by name.
BLOCKS = {
    "comment": r"<!--.*?-->",
    "element with content": r"<(ref|gallery|imagemap)(?:[^>]*[^/>])?>.*?</\1>",
    "link into a namespace": rf"\[\[[a-z-]*:{_HELD}\]\]",
    "table": r"\{\|(?:[^{|]|\{[^|]|\|[^}])*?\|+\}",
    "innermost template": r"\{\{[^{}]*\}\}",
}
#: What is replaced.
TAG = r"</?[a-z][a-z0-9]*(?: [^>]*|/)?>"
ENTITY = r"&[a-z]+;"
LINK = rf"\[\[((?:[\[\]]?[^\[\]|]|[\[\]]\|)*)(?:\|{_HELD})?\]\]"
LABEL = r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]"
ADDRESS = r"\[(?:https?|ftp)://[^\] ]*((?: [^\]]*)?)\]"
ARTICLE_MARK = r"(?:begin|end) article"
REDIRECT = "#redirect"
#: What any of the blocks begins with, for a look before the search.
OPENINGS = ("<!--", "[[", "{|", "{{")
OPENED = r"<(?:ref|gallery|imagemap)"
LINK_TEXTS = ("target", "label")
#: What a find of each rule but the first begins with.
BEGINNINGS = ("", "<", "&", "[[", "[")
#: What any of the rules' finds begins with: the search of an alternation passes over all else.
MARKS = r"(?=[<&\[{])"
#: How often a round of the native form applies the first rule at most, which nests (the others come once), and how many rounds.
NESTED, TIMES = 3, 3


def rules(link_text: str = "target") -> list[tuple[str, str]]:
    """(pattern, what stays: empty, a blank or the first group), in the order of the loop."""
    if link_text not in LINK_TEXTS:
        raise ValueError(f"link_text must be one of {LINK_TEXTS}")
    # One alternation, so that of constructs that overlap the one that begins first goes.
    blocks = "|".join(BLOCKS.values())
    return [(blocks, ""), (TAG, " "), (ENTITY, " "), (LINK if link_text == "target" else LABEL, "$1"), (ADDRESS, "$1")]


def _replaced(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, f"(?is){pattern}", to)


def remove_blocks(text: Column) -> Column:
    """Without comments, references, galleries, image maps, links into namespaces, tables and innermost templates."""
    return _replaced(text, *rules()[0])


def strip_tags(text: Column) -> Column:
    return _replaced(text, TAG, " ")


def strip_entities(text: Column) -> Column:
    return _replaced(text, ENTITY, " ")


def strip_wiki_links(text: Column, link_text: str = "target") -> Column:
    """Links as their target (the part before the first bar) or their label (the last part)."""
    return _replaced(text, *rules(link_text)[3])


def strip_url_links(text: Column) -> Column:
    return _replaced(text, *rules()[4])


def escape_article_marks(text: Column) -> Column:
    return _replaced(text, ARTICLE_MARK, ">$0")


def is_redirect(text: Column) -> Column:
    return F.lower(F.substring(text, 1, len(REDIRECT))) == REDIRECT


def strip_text(text: str, link_text: str = "target") -> str:
    """The loop over one text."""
    compiled = [(re.compile(p, re.IGNORECASE | re.DOTALL | re.ASCII), to.replace("$", "\\")) for p, to in rules(link_text)]
    rule = 0
    while rule < len(compiled):
        pattern, to = compiled[rule]
        text, n = pattern.subn(to, text)
        rule = 0 if n else rule + 1
    return text


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _has(text: Column, *marks: str) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(m)) for m in marks])


def _opened_beyond_links(text: Column) -> Column:
    """Whether a block other than a link can begin in a text."""
    return _has(text, *(o for o in OPENINGS if o != "[[")) | (_has(text, "<") & text.rlike(f"(?i){OPENED}"))


def _without_blocks(text: Column) -> Column:
    """The first rule, by no more of its alternatives than can begin in the text."""
    links = _replaced(text, BLOCKS["link into a namespace"], "")
    every = _replaced(text, f"{MARKS}(?:{'|'.join(BLOCKS.values())})", "")
    return F.when(_opened_beyond_links(text), every).when(_has(text, "[["), links).otherwise(text)


def _blocked(text: Column) -> Column:
    """Whether a text has a block."""
    every = text.rlike(f"(?is){MARKS}(?:{'|'.join(BLOCKS.values())})")
    return F.when(_opened_beyond_links(text), every).otherwise(_has(text, "[[") & text.rlike(f"(?is){BLOCKS['link into a namespace']}"))


def _natively(text: Column, link_text: str) -> Column:
    """(t, same): the text after a few rounds of the rules, and whether the loop ends with it.

    A round goes through the rules as the loop does and stops where the loop goes back; the next begins with that text.
    """
    some = rules(link_text)
    found = lambda t, i: _has(t, BEGINNINGS[i]) & t.rlike(f"(?is){some[i][0]}")

    def cleared(state: Column, times: int) -> Column:
        """(text, whether no block is left) after the first rule, as often as it changes anything."""
        if not times:
            return F.struct(state["t"].alias("t"), (~_blocked(state["t"])).alias("same"))
        now = _without_blocks(state["t"])
        new = F.struct(now.alias("t"), state["t"].alias("was"))
        return _let(new, lambda n: F.when(n["t"] == n["was"], F.struct(n["t"].alias("t"), F.lit(True).alias("same"))).otherwise(cleared(n, times - 1)))

    def applied(i: int, state: Column) -> Column:
        """(text, whether the loop goes on to the next rule) after rule ``i``; a text at which it has gone back stays."""
        if i == 0:
            return cleared(state, NESTED)
        stripped = F.when(_has(state["t"], BEGINNINGS[i]), _replaced(state["t"], *some[i])).otherwise(state["t"])
        new = F.struct(stripped.alias("t"), state["t"].alias("was"))
        left = lambda t: reduce(lambda x, y: x | y, [found(t, j) for j in range(1, i + 1)]) | _blocked(t)
        now = _let(new, lambda n: F.struct(n["t"].alias("t"), ((n["t"] == n["was"]) | ~left(n["t"])).alias("same")))
        return F.when(state["same"], now).otherwise(state)

    def gone_through(state: Column) -> Column:
        """One round."""
        for i in range(len(some)):
            state = _let(state, partial(applied, i))
        return state

    state = gone_through(F.struct(text.alias("t"), F.lit(True).alias("same")))
    for _ in range(TIMES - 1):
        state = _let(state, lambda s: F.when(s["same"], s).otherwise(gone_through(F.struct(s["t"].alias("t"), F.lit(True).alias("same")))))
    return _let(F.when(text.rlike(r"[<&\[{]"), state).otherwise(F.struct(text.alias("t"), F.lit(True).alias("same"))), lambda s: s)


def strip_markup(rows: DataFrame, text_col: str = "text", link_text: str = "target") -> DataFrame:
    """``rows`` with the column without markup; null stays null."""

    @F.pandas_udf("string")
    def looped(s):
        return s.map(lambda t: None if t is None else strip_text(t, link_text))

    # A column of its own, so that it is computed once.  Rows that need no loop are null to it.
    tried = rows.withColumn("markup_state", _natively(F.col(text_col), link_text))
    state, text = F.col("markup_state"), F.col(text_col)
    out = F.when(state["same"] | text.isNull(), state["t"]).otherwise(looped(F.when(~state["same"], text)))
    return tried.withColumn(text_col, out).drop("markup_state")
