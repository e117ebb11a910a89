"""Scalar text functions: normalisation, chains, word prefixes, markup removal.  All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters in a chain (fixed value).
WINDOW = 40


def normalize(line: Column) -> Column:
    """A line as lower-case ASCII words, one space after each; null counts as empty.

    Apostrophes vanish, every other run of characters that are no ASCII letters or digits is a break, and a NUL ends
    the line.  The line feed that ends a line makes the last space.
    """
    text = F.concat(F.substring_index(F.coalesce(line, F.lit("")), "\0", 1), F.lit("\n"))
    return F.ltrim(F.lower(F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), "[^A-Za-z0-9]+", " ")))


def chains(norm: str, window: int = WINDOW) -> Column:
    """Array of the chains of column ``norm``, a normalised line: from each word start, ``window`` characters.

    A word of ``window`` or more characters starts anew after every ``window`` of them.  A match goes from one start to
    the next and looks ahead for its chain, so the work grows with the line, not with its square.
    """
    most = f"[^ ]{{1,{window - 1}}} |" if window > 1 else ""
    return F.expr(f"regexp_extract_all({norm}, '(?=(.{{1,{window}}}))(?:{most}[^ ]{{{window}}} ?)', 1)")


def char_prefixes(text: str, most: int | None = None) -> Column:
    """Array of all prefixes of column ``text``, up to ``most`` characters."""
    end = f"length({text})" if most is None else f"least(length({text}), {most})"
    return F.expr(f"transform(filter(sequence(1, greatest({end}, 1)), i -> i <= {end}), i -> substr({text}, 1, i))")


def letters_key(text: Column) -> Column:
    """The sorted characters of a text without its spaces."""
    return F.array_join(F.array_sort(F.split(F.replace(text, F.lit(" "), F.lit("")), "")), "")


def phone_key(text: Column) -> Column:
    """The digits that a telephone's keys have for a text, spaces dropped."""
    from lexiloom.plans.pattern import KEYS

    letters = "".join(KEYS.values())
    return F.translate(text, letters + " ", "".join(d * len(cs) for d, cs in KEYS.items()))


def font_size(score: Column) -> Column:
    """The size in which a result page shows a score."""
    size = F.when(score >= 1, 1.5 + F.log(score) / 5).when(score > 0, 1.5 + F.log(score) / 50).otherwise(0.0)
    return F.greatest(F.lit(0.4), size)


def formatted_score(score: Column) -> Column:
    """A score with eight significant digits, as C's ``%.8g`` prints it: plain from 1e-4 to 1e8, else with exponent."""
    power = F.floor(F.log10(score)).cast("int")
    # The exponent after rounding to eight digits: 99999999.9 becomes 1e+08.
    power = F.when(score / F.pow(F.lit(10.0), power) >= 9.99999995, power + 1).otherwise(power)
    mantissa = F.format_string("%.7f", score / F.pow(F.lit(10.0), power))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    plain = F.coalesce(*[F.when(power == p, F.format_string(f"%.{7 - p}f", score)) for p in range(-4, 8)])
    return F.when(score == 0, "0").when(power.between(-4, 7), F.when(plain.contains("."), trimmed(plain)).otherwise(plain)).otherwise(F.concat(trimmed(mantissa), exponent))


def html_escape(text: Column) -> Column:
    """A text with the characters that HTML reserves written as entities."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def url_quote(text: Column) -> Column:
    """A text as part of an address: all but letters, digits and ``_.-~`` as ``%`` and two digits for each byte."""
    out = F.url_encode(text)
    # What forms write otherwise than addresses.
    for mark, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out
