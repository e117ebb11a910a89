r"""Format-preserving pseudonyms for personal numbers and dates; DataFrame functions only.

One pattern finds candidates; each is validated before anything changes:

- payment card numbers of 13 to 19 digits (plain or in groups): Luhn check; the new number passes it too
- social security numbers (3-2-4, by hyphens or blanks): no area 000, 666 or 9xx, no zero group or serial, before and after
- phone numbers with area code (3-3-4): area and exchange start with 2 to 9, before and after; the country code stays
- phone numbers with a country code, plain or with blanks, points or hyphens: 8 to 15 digits; the country code stays
- national numbers with a slash (0171/1234567): what stands before it stays
- national numbers of ten digits in pairs (06 12 34 56 78): the first pair stays
- IPv4 addresses: four octets up to 255
- dates of 1900 to 2099 (2001-12-31, 31/12/2001, 31.12.2001, 1/5/2001, and month first where only that is a date)
- IBANs, plain or in groups of four: the check digits hold (modulo 97), before and after; the country stays
- e-mail addresses: letters for letters and digits for digits, the host by itself and the local part by the host; as
  the new host may exist, ``.invalid`` is put behind it; letters beyond A to Z belong to the address but stay as they are

A find neither begins nor ends inside a word, in whatever letters the word is written.

Numbers, dates and addresses are permuted inside their format by a keyed Feistel network of ``ROUNDS`` rounds: two
halves, each in turn moved by a SHA-256 of the key, the kind and the other half, modulo the size of its range.  Values
that leave the valid range are permuted again until they are in it, which keeps the map one-to-one.  Equal values have
equal pseudonyms in all documents, in dates over all spellings; without the key the map cannot be undone.  The key is
given to ``pseudonymise`` or in the setting ``spark.lexiloom.pii.key``; without it a public one is used, with a warning,
and anybody can undo the map.

Defined results: null and empty texts give an empty text and no finds; a text of any length is read whole; candidates that fail validation stay as they
are, and texts without finds stay byte for byte; repeated rows give repeated results; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import warnings
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import text_of

ROUNDS = 8
KEY_SETTING, DEFAULT_KEY = "spark.lexiloom.pii.key", "set spark.lexiloom.pii.key"
KINDS = ("card", "ssn", "phone", "ip", "date", "iban", "email")

CARD = r"[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
#: The ranges that country codes are given from.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[05-8]|9[679])[0-9])"
ABROAD = rf"\+{COUNTRY}(?:[ .-]?\([0-9]{{1,4}}\))?(?:[ .-][0-9]{{1,8}}){{1,6}}|\+{COUNTRY}[0-9]{{7,12}}|0[1-9][0-9]{{1,3}}/[0-9]{{5,8}}"
PAIRS = r"0[1-9](?: [0-9]{2}){4}|0[1-9](?:\.[0-9]{2}){4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?"
EMAIL = r"[\p{L}\p{M}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Candidates start where no letter, digit or joined punctuation comes before, and end where no more of it follows.
WORD = r"\p{L}\p{M}\p{N}"
PATTERN = rf"(?<![{WORD}._%+@-]){EMAIL}|(?<![{WORD}]|[0-9][.-])(?:{IBAN}|{CARD}|{PHONE}|{IP}|{DATE}|{SSN}|{PAIRS}|{ABROAD})(?![{WORD}]|[.-][0-9])"
FIRST_DAY, DAYS, DAY_WIDTH = "1900-01-01", 73_049, 271  # to 2099-12-31; 270 * 271 covers them


_fresh = count()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name() -> str:
    """A name for a lambda's variable; nested lambdas need different ones."""
    return f"v{next(_fresh)}"


# All functions below take and return SQL expressions as text, so that lambdas can nest.


def _let(value: str, body) -> str:
    """``body`` of a value that is computed once."""
    v = _name()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _each(array: str, body) -> str:
    v = _name()
    return f"transform({array}, {v} -> {body(v)})"


def _repeat(times: int, start: str, body) -> str:
    """``body`` applied ``times`` times from ``start``."""
    s, i = _name(), _name()
    return f"aggregate(sequence(0, {times - 1}), {start}, ({s}, {i}) -> {body(s, i)})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _chars(s: str) -> str:
    v = _name()
    return f"filter(split({s}, ''), {v} -> {v} <> '')"


def feistel(a: str, b: str, size_a: str, size_b: str, key: str, kind: str, tweak: str = "") -> str:
    """struct(a, b) after the rounds; ``a`` and ``b`` are long and below their sizes.  Another ``tweak``, another map."""

    def step(s: str, i: str) -> str:
        other = f"if({i} % 2 = 1, {s}.a, {s}.b)"
        digest = f"sha2(concat_ws('|', {_quoted(key)}, {_quoted(kind)}, {size_a}, {size_b}, {i}, {other}{tweak and ', ' + tweak}), 256)"
        move = f"cast(conv(substr({digest}, 1, 15), 16, 10) AS BIGINT)"
        return f"named_struct('a', if({i} % 2 = 1, {s}.a, ({s}.a + {move} % {size_a}) % {size_a}), 'b', if({i} % 2 = 1, ({s}.b + {move} % {size_b}) % {size_b}, {s}.b))"

    return _repeat(ROUNDS, f"named_struct('a', cast({a} AS BIGINT), 'b', cast({b} AS BIGINT))", step)


def _permuted(x: str, n: str, base: int, of: str, to: str, key: str, kind: str, tweak: str = "") -> str:
    """Another string of the same length ``n`` of digits of a base, which SQL has for ``of`` and from ``to``."""

    def sized(h: str) -> str:
        number = lambda part: f"cast(conv(concat('0', {of.format(part)}), {base}, 10) AS BIGINT)"
        text = lambda v, width: f"lpad({to.format(f'conv({v}, 10, {base})')}, {width}, {to.format(_quoted('0'))})"
        sizes = [f"cast(pow({base}, {h}.{w}) AS BIGINT)" for w in "uv"]
        p = feistel(number(f"left({x}, {h}.u)"), number(f"substr({x}, {h}.u + 1)"), *sizes, key, kind, tweak)
        return _let(p, lambda y: f"concat({text(f'{y}.a', f'{h}.u')}, {text(f'{y}.b', f'{h}.v')})")

    return _let(f"named_struct('u', cast({n} div 2 AS INT), 'v', cast({n} - {n} div 2 AS INT))", sized)


def permuted_digits(d: str, key: str, kind: str, tweak: str = "") -> str:
    """Another digit string of the same length, 1 to 18."""
    return _permuted(d, f"length({d})", 10, "{}", "{}", key, kind, tweak)


_LETTERS, _BASE_26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def permuted_letters(x: str, key: str, kind: str, tweak: str = "") -> str:
    """Another string of lower-case letters of the same length, 1 to 12."""
    return _permuted(x, f"length({x})", 26, f"translate({{}}, '{_LETTERS}', '{_BASE_26}')", f"translate(lower({{}}), '{_BASE_26}', '{_LETTERS}')", key, kind, tweak)


def _in_pieces(x: str, size: int, piece) -> str:
    """``piece`` of (part, its number) of every ``size`` characters of a string, joined."""
    v = _name()
    return f"if({x} = '', '', array_join(transform(sequence(0, (length({x}) - 1) div {size}), {v} -> {piece(f'substr({x}, cast({v} * {size} + 1 AS INT), {size})', v)}), ''))"


def luhn_sum(d: str, doubled_last: bool) -> str:
    """The Luhn sum of the digits; with ``doubled_last`` of a number whose check digit is still missing."""
    c, i, s, x = _name(), _name(), _name(), _name()
    value = f"cast({c} AS INT)"
    one = f"if({i} % 2 = {0 if doubled_last else 1}, {value} * 2 - if({value} > 4, 9, 0), {value})"
    return f"aggregate(transform(reverse({_chars(d)}), ({c}, {i}) -> {one}), 0, ({s}, {x}) -> {s} + {x})"


def in_shape(m: str, d: str) -> str:
    """``m`` with its digits replaced, in order, by those of ``d``."""
    return _let(d, lambda new: f"array_join({_each(f'sequence(1, length({m}))', lambda i: f"if(substr({m}, {i}, 1) RLIKE '[0-9]', substr({new}, length({_digits(f'left({m}, {i})')}), 1), substr({m}, {i}, 1))")}, '')")


def _walked(start: str, again, valid, times: int = 64) -> str:
    """``start``, and as long as it is not valid what comes after it in the permutation."""
    return _repeat(times, start, lambda x, _: f"if({valid(x)}, {x}, {again(x)})")


def _card(m: str, key: str) -> str:
    def made(d: str) -> str:
        new = _let(permuted_digits(f"left({d}, length({d}) - 1)", key, "card"), lambda body: f"concat({body}, (10 - {luhn_sum(body, True)} % 10) % 10)")
        return f"if({luhn_sum(d, False)} % 10 = 0, {in_shape(m, new)}, NULL)"

    return _let(_digits(m), made)


def _ssn(m: str, key: str) -> str:
    valid = lambda d: f"(NOT {d} RLIKE '^(000|666|9)' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"
    again = lambda d: permuted_digits(d, key, "ssn")
    return _let(_digits(m), lambda d: f"if({valid(d)}, {in_shape(m, _walked(again(d), again, valid))}, NULL)")


def _phone(m: str, key: str) -> str:
    """Numbers of an area, an exchange and a line; others keep their country code, or what stands before their first separator."""
    valid = lambda d: f"{d} RLIKE '^[2-9][0-9]{{2}}[2-9]'"
    again = lambda d: permuted_digits(d, key, "phone")

    def near(d: str) -> str:
        own = f"right({d}, 10)"
        return f"if({valid(own)}, {in_shape(m, f'concat(left({d}, length({d}) - 10), {_walked(again(own), again, valid)})')}, NULL)"

    def far(d: str) -> str:
        code = _digits(f"regexp_extract({m}, {_quoted(f'^(?:[+]{COUNTRY}(?=[0-9]+$)|[+]?[0-9]+)')}, 0)")
        return f"if(length({d}) BETWEEN 8 AND 15, {_let(code, lambda c: in_shape(m, f'concat({c}, {permuted_digits(f"substr({d}, length({c}) + 1)", key, "phone abroad", c)})'))}, NULL)"

    return _let(_digits(m), lambda d: f"if({m} RLIKE {_quoted(f'^(?:{PHONE})$')}, {near(d)}, {far(d)})")


def _ip(m: str, key: str) -> str:
    def made(o: str) -> str:
        pair = lambda i: f"cast({o}[{i}] AS BIGINT) * 256 + cast({o}[{i + 1}] AS BIGINT)"
        new = _let(feistel(pair(0), pair(2), "65536L", "65536L", key, "ip"), lambda p: f"concat_ws('.', {p}.a div 256, {p}.a % 256, {p}.b div 256, {p}.b % 256)")
        v = _name()
        return f"if(forall({o}, {v} -> cast({v} AS INT) <= 255), {new}, NULL)"

    return _let(f"split({m}, '[.]')", made)


def _date(m: str, key: str) -> str:
    iso = f"{m} RLIKE '^[0-9]{{4}}-'"
    part = lambda i: f"lpad(split({m}, '[-/.]')[{i}], 2, '0')"
    parse = lambda y, mo, d: f"try_to_date(concat_ws('-', right({m}, 4), {part(mo)}, {part(d)}), 'yyyy-MM-dd')" if y else f"try_to_date({m}, 'yyyy-MM-dd')"

    def permuted(n: str) -> str:
        return _let(feistel(f"({n}) div {DAY_WIDTH}", f"({n}) % {DAY_WIDTH}", "270L", f"{DAY_WIDTH}L", key, "date"), lambda p: f"{p}.a * {DAY_WIDTH} + {p}.b")

    def made(x: str) -> str:
        days = f"cast(datediff({x}.day, DATE'{FIRST_DAY}') AS BIGINT)"

        def shaped(n: str) -> str:
            walked = _repeat(16, permuted(n), lambda v, _: f"if({v} < {DAYS}, {v}, {permuted(v)})")
            mark = f"if(contains({m}, '/'), '/', '.')"
            # As short as it was: without zeros in front where a part came without.
            two = lambda new, what: f"if(length({m}) < 10, cast({what}({new}) AS STRING), lpad({what}({new}), 2, '0'))"
            text = lambda new: f"CASE WHEN {iso} THEN date_format({new}, 'yyyy-MM-dd') WHEN {x}.day_first THEN concat_ws({mark}, {two(new, 'day')}, {two(new, 'month')}, year({new})) ELSE concat_ws({mark}, {two(new, 'month')}, {two(new, 'day')}, year({new})) END"
            return f"if({n} >= 0 AND {n} < {DAYS}, {_let(f"date_add(DATE'{FIRST_DAY}', cast({walked} AS INT))", text)}, NULL)"

        return f"if({x}.day IS NULL, NULL, {_let(days, shaped)})"

    day_first = parse(1, 1, 0)
    return _let(f"named_struct('day', if({iso}, {parse(0, 0, 0)}, coalesce({day_first}, {parse(1, 0, 1)})), 'day_first', {day_first} IS NOT NULL)", made)


def _mod97(s: str) -> str:
    """The number that an IBAN's characters spell (A as 10 to Z as 35), modulo 97."""
    t, c = _name(), _name()
    return f"aggregate({_chars(s)}, 0, ({t}, {c}) -> if({c} RLIKE '[0-9]', {t} * 10 + cast({c} AS INT), {t} * 100 + ascii({c}) - 55) % 97)"


def _iban(m: str, key: str) -> str:
    def made(c: str) -> str:
        country, body = f"left({c}, 2)", f"substr({c}, 5)"

        def digits(d: str) -> str:
            few = lambda x, kind: f"if({x} = '', '', {permuted_digits(x, key, kind)})"
            return f"concat({few(f'left({d}, 16)', 'iban')}, {few(f'substr({d}, 17)', 'iban tail')})"

        new = _let(in_shape(body, _let(_digits(body), digits)), lambda b: f"concat({country}, lpad(98 - {_mod97(f"concat({b}, {country}, '00')")}, 2, '0'), {b})")
        spaced = lambda n: f"array_join({_each(f'sequence(1, length({m}))', lambda i: f"if(substr({m}, {i}, 1) = ' ', ' ', substr({n}, length(replace(left({m}, {i}), ' ', '')), 1))")}, '')"
        return f"if({_mod97(f'concat({body}, left({c}, 4))')} = 1, {_let(new, spaced)}, NULL)"

    return _let(f"replace({m}, ' ', '')", made)


def _email(m: str, key: str) -> str:
    def changed(x: str, kind: str, tweak: str) -> str:
        """Letters and digits of ``x`` permuted among their own; capitals stay where they are."""
        letters = _in_pieces(f"regexp_replace(lower({x}), '[^a-z]', '')", 12, lambda part, i: permuted_letters(part, key, kind, f"{i}, {tweak}"))
        digits = _in_pieces(f"regexp_replace({x}, '[^0-9]', '')", 16, lambda part, i: permuted_digits(part, key, kind, f"{i}, {tweak}"))

        def put(n: str) -> str:
            def one(i: str) -> str:
                c = f"substr({x}, {i}, 1)"
                count = lambda kept: f"length(regexp_replace(left({x}, {i}), '[^{kept}]', ''))"
                letter = f"substr({n}.l, {count('A-Za-z')}, 1)"
                return f"CASE WHEN {c} RLIKE '[a-z]' THEN {letter} WHEN {c} RLIKE '[A-Z]' THEN upper({letter}) WHEN {c} RLIKE '[0-9]' THEN substr({n}.d, {count('0-9')}, 1) ELSE {c} END"

            return f"array_join({_each(f'sequence(1, length({x}))', one)}, '')"

        return _let(f"named_struct('l', {letters}, 'd', {digits})", put)

    def made(p: str) -> str:
        return f"concat({changed(f'{p}.who', 'email', f'lower({p}.host)')}, '@', {changed(f'{p}.host', 'host', _quoted('host'))}, '.invalid')"

    return _let(f"named_struct('who', substring_index({m}, '@', 1), 'host', substring_index({m}, '@', -1))", made)


def pseudonym(m: str, key: str) -> str:
    """struct(kind, new) of a candidate; both null where it fails validation."""
    whole = lambda p: f"{m} RLIKE {_quoted(f'^(?:{p})$')}"
    kind = f"CASE WHEN contains({m}, '@') THEN 'email' WHEN {whole(IBAN)} THEN 'iban' WHEN {whole(f'{PHONE}|{PAIRS}|{ABROAD}')} THEN 'phone' WHEN {whole(IP)} THEN 'ip' WHEN {whole(DATE)} THEN 'date' WHEN {whole(SSN)} THEN 'ssn' ELSE 'card' END"
    make = {"email": _email, "iban": _iban, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}

    def of(k: str) -> str:
        new = " ".join(f"WHEN {k} = '{name}' THEN {f(m, key)}" for name, f in make.items())
        return _let(f"CASE {new} END", lambda n: f"named_struct('kind', if({n} IS NULL, NULL, {k}), 'new', {n})")

    return _let(kind, of)


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """id, the text with pseudonyms, n_found and the number of each kind, for every row.  Narrow: no shuffle."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"no key in {KEY_SETTING}: the pseudonyms can be undone by anybody", stacklevel=2)
        key = DEFAULT_KEY
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    rows = rows.withColumn("m", F.when(F.col("t").rlike("[0-9@]"), F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))))
    made = _each("m", lambda m: _let(pseudonym(m, key), lambda x: f"named_struct('kind', {x}.kind, 'new', coalesce({x}.new, {m}))"))
    rows = rows.withColumn("p", F.expr(f"if(size(m) > 0, {made}, NULL)"))
    rows = rows.withColumn("k", F.expr("coalesce(filter(p.kind, v -> v IS NOT NULL), cast(array() AS array<string>))"))
    spliced = F.expr(f"array_join(zip_with(split(t, {_quoted(PATTERN)}, -1), concat(p.new, array('')), (a, b) -> concat(a, b)), '')")
    text = F.when(F.size("k") > 0, spliced).otherwise(F.col("t"))
    return rows.select(F.col("id").alias(id_col), text.alias("text"), F.size("k").cast("long").alias("n_found"), *[F.expr(f"cast(size(filter(k, v -> v = '{n}')) AS BIGINT)").alias(f"n_{n}") for n in KINDS])
