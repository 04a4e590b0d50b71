"""Column helpers for text: white space and blankness in the Unicode sense."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (Unicode White_Space and the four
# ASCII separators), as a Java character class.
SPACE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` would only take blanks)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """Empty or white space only; null for null."""
    return ~c.rlike(f"(?!{SPACE})[\\s\\S]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def iso_micros(ts: Column) -> Column:
    """An ISO time as microseconds since 1970; without a zone it means UTC, whatever the session's zone; null if unreadable."""
    bare = ts.contains(":") & ~ts.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$")
    return F.unix_micros(F.try_to_timestamp(F.when(bare, F.concat(ts, F.lit("Z"))).otherwise(ts)))
