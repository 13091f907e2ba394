"""Column functions: dates in names, group names in patterns, sequences and portable hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives and the date-time pattern letters that mean the same.
DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "M": "mm",
    "S": "ss",
    "f": "SSSSSS",
    "j": "DDD",
    "b": "MMM",
    "B": "MMMM",
    "p": "a",
    "I": "hh",
}


def date_pattern(strptime: str) -> str:
    """A strptime format as a Spark date-time pattern; a ValueError for directives without a counterpart."""
    out, quoted = [], ""

    def flush() -> None:
        nonlocal quoted
        if quoted:
            out.append("'" + quoted.replace("'", "''") + "'" if re.search("[A-Za-z']", quoted) else quoted)
        quoted = ""

    parts = iter(strptime)
    for c in parts:
        if c != "%":
            quoted += c
            continue
        d = next(parts, "")
        if d == "%":
            quoted += "%"
        elif d in DIRECTIVES:
            flush()
            out.append(DIRECTIVES[d])
        else:
            raise ValueError(f"unsupported directive %{d} in {strptime!r}")
    flush()
    return "".join(out)


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A regular expression with (?P<name>...) groups for Spark, and the numbers of its groups."""
    return re.sub(r"\(\?P<", "(?<", pattern), dict(re.compile(pattern).groupindex)


def named_groups(text: str | Column, pattern: str) -> dict[str, Column]:
    """A column for each named group of ``pattern`` found in ``text``; null where it is not found."""
    java, groups = java_pattern(pattern)
    text = F.col(text) if isinstance(text, str) else text
    found = text.rlike(java)
    return {name: F.when(found, F.regexp_extract(text, java, i)) for name, i in groups.items()}


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stamp(text: str | Column, strptime: str) -> Column:
    """The timestamp without zone that ``text`` holds, or null."""
    return F.try_to_timestamp(text, F.lit(date_pattern(strptime))).cast("timestamp_ntz")


def excel_day(serial: str | Column) -> Column:
    """The date of an Excel serial day; the fraction is cut off."""
    number = F.floor(F.col(serial) if isinstance(serial, str) else serial).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), number)


def matlab_seconds(days: str | Column) -> Column:
    return (F.col(days) if isinstance(days, str) else days) * 86_400.0


def portable_hash(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by colons: the same in every engine, so that draws can be checked."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) if isinstance(p, int) else F.col(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]).cast("binary"))


def portable_index(digest: Column, n: Column) -> Column:
    """A number from 0 below ``n`` from the first eight digits of a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n)


#: A factor that spreads the bits of a 32-bit number, and how far they are shifted.
FACTOR, SHIFT = 73_244_475, 16


def lane(digest: Column, k: int) -> Column:
    """The ``k``th 32 bits of a digest in hexadecimal, as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def mixed(x: Column, y: Column) -> Column:
    """A 32-bit hash of two 32-bit numbers, by whole-number arithmetic that any engine, and numpy over whole arrays, can do."""
    z = x.bitwiseXOR(y)
    for _ in range(2):
        z = (z.bitwiseXOR(F.shiftright(z, SHIFT)) * FACTOR) % 2**32
    return z.bitwiseXOR(F.shiftright(z, SHIFT))



#: Characters that stand for tokens begin here; those up to 0xD7FF give room for some 35,000 in a pair.
FIRST_CODE = 0x4E00


def _letter(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number + FIRST_CODE), 4, "0")), "UTF-16BE")


def token_distance(true: Column, predicted: Column) -> Column:
    """The edit distance of two arrays of strings, whatever the length of each string.

    Each distinct token of the pair becomes one character, so the built-in distance counts tokens.
    """
    names = F.array_distinct(F.concat(true, predicted))

    def coded(tokens: Column) -> Column:
        return F.array_join(F.transform(tokens, lambda t: _letter(F.array_position(names, t))), "")

    return F.levenshtein(coded(true), coded(predicted)).cast("bigint")


def token_error_rate(true: Column, predicted: Column) -> Column:
    """Edits per true token; more than 1 is possible; fails on an empty true sequence."""
    n = F.size(true)
    return F.when(n > 0, token_distance(true, predicted) / n).otherwise(
        F.raise_error(F.lit("the true sequence is empty")).cast("double")
    )


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def rounded(column: str | Column, places: int = 6) -> Column:
    """Rounded as SQL engines do it (scaled, to a whole number, scaled back), with no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") * F.lit(10.0**places)) / F.lit(10.0**places) + F.lit(0.0)


def not_in(column: str, values: Sequence) -> Column:
    """True unless the value is one of ``values``; with none given, always."""
    return ~F.col(column).isin(*values) if values else F.lit(True)
