"""Column expressions over text.  All of them are JVM built-ins."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators; use with the (?U) flag.
SPACE = r"[\s\x1c-\x1f]"

# The SQL keywords whose spelling is normalised, in this order.
SQL_KEYWORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "ON", "GROUP BY", "ORDER BY", "LIMIT",
    "HAVING", "COUNT", "SUM", "AVG", "MIN", "MAX",
)


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` knows blanks only).

    The look-behind keeps long runs inside the text from being tried at every place.
    """
    return F.regexp_replace(c, rf"(?U)\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def collapse(c: Column) -> Column:
    """One blank for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_ANY_KEYWORD = "|".join(SQL_KEYWORDS)
_KEYWORD_TO_FIX = rf"(?U)\b(?!(?:{_ANY_KEYWORD})\b)(?i:{_ANY_KEYWORD})\b"


def upper_keywords(sql: Column) -> Column:
    """Upper-case SQL keywords wherever they stand as whole words.

    This touches string literals and columns named like a keyword too.  Text
    whose keywords are upper case already is tested once and left alone; of the others,
    only keywords that occur are replaced (all are tried if a character is not ASCII,
    since some of these match a letter without having it as upper case).
    """
    plain = F.octet_length(sql) == F.char_length(sql)
    there = bound(F.upper(sql), lambda text: F.filter(
        F.array(*map(F.lit, SQL_KEYWORDS)), lambda word: ~plain | F.contains(text, word)))
    fixed = F.aggregate(there, sql, lambda text, word: F.regexp_replace(
        text, F.concat(F.lit(r"(?iU)\b"), word, F.lit(r"\b")), word))
    return F.when(sql.rlike(_KEYWORD_TO_FIX), fixed).otherwise(sql)


# Words whose spelling does not matter when two queries are compared.
_QUERY_WORDS = (
    "SELECT DISTINCT ALL AS FROM WHERE JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL ON USING GROUP ORDER BY HAVING LIMIT "
    "OFFSET ASC DESC NULLS FIRST LAST UNION INTERSECT EXCEPT AND OR NOT IN IS NULL LIKE BETWEEN EXISTS CASE WHEN THEN ELSE "
    "END CAST WITH COUNT SUM AVG MIN MAX"
).split()


def outside_literals(sql: Column, change: Callable[[Column], Column], literal: Callable[[Column], Column] = lambda c: c) -> Column:
    """Apply ``change`` to what stands outside single quotes and ``literal`` to what stands inside."""
    parts = F.transform(F.split(sql, "'"), lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(literal(p)))
    return F.array_join(parts, "'")


def normalise_sql(sql: Column) -> Column:
    """Form in which two queries are compared: blanks and keywords outside literals, final ``;``."""
    def plain(part: Column) -> Column:
        words = F.split(F.regexp_replace(part, rf"(?U){SPACE}+", " "), r"(?U)\b")
        return F.array_join(F.transform(
            words, lambda w: F.when(F.upper(w).isin(_QUERY_WORDS), F.upper(w)).otherwise(w)), "")

    return F.trim(F.regexp_replace(F.trim(outside_literals(sql, plain)), r"(?<![; ])[; ]++\z", ""))


def before(c: Column, marker: str) -> Column:
    """Text up to the first ``marker``; the whole text when it is absent."""
    return F.substring_index(c, marker, 1)


def between(c: Column, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the next ``start`` or ``end``; null without ``start``."""
    return F.when(
        F.contains(c, F.lit(start)),
        before(F.substring_index(F.substring_index(c, start, 2), start, -1), end),
    )


def bracketed(items: Column) -> Column:
    """``[a,b]`` from an array of strings."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def render(template: str, **slots: Column) -> Column:
    """Fill the ``{slot}`` places of a template with columns."""
    parts: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is not None:
            parts.append(slots[slot])
    return F.concat(*parts)
