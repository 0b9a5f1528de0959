"""White space, rounding and patterns, spelled for Spark (Java) and for DuckDB (RE2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of Unicode white space.
_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def _class(form: str) -> str:
    one = lambda c: form.format(c)
    return "[" + "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in _RANGES) + "]"


WS = _class("\\x{{{:x}}}")
"""One white-space character; this spelling holds in both dialects."""

BREAK = f"\n{WS}*\n"
"""What parts paragraphs."""


CHARS = "".join(chr(c) for a, b in _RANGES for c in range(a, b + 1))
"""All white-space characters."""


def strip(text: Column) -> Column:
    """Without white space at both ends; most texts have none there, which their first and last character tell."""
    bare = ~F.left(text, F.lit(1)).rlike(WS) & ~F.right(text, F.lit(1)).rlike(WS)
    return F.when(bare, text).otherwise(F.regexp_replace(text, f"^{WS}+|{WS}+\\z", ""))


def rounded(value: Column, digits: int, wide: bool = False) -> Column:
    """Half-up rounding of the decimal form, which all engines do alike; values from 1e8 on need the wide form, which is slower."""
    return F.round(value.cast("decimal(38,10)" if wide else "decimal(18,10)"), digits).cast("double")


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+\\z', '', 'g')"


def sql_rounded(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,10)), {digits}) AS DOUBLE)"


def sql_occurrences(text: str, literal: str) -> str:
    return f"((length({text}) - length(replace({text}, {quoted(literal)}, ''))) // {len(literal)})"
