"""Slugs, previews and short forms of numbers and times, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions.text import strip


def slug(c: Column) -> Column:
    """Lower case, every run of other characters one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(path: Column, keep: int = 40) -> Column:
    """The last ``keep`` characters of a path's slug."""
    return F.right(slug(path), F.lit(keep))


def title_slug(title: Column) -> Column:
    s = slug(title)
    return F.when(F.coalesce(s, F.lit("")) == "", "block").otherwise(s)


def preview(c: Column, keep: int = 140) -> Column:
    """The first characters, and an ellipsis if there are more."""
    return F.when(F.length(c) > keep, F.concat(F.substring(c, 1, keep), F.lit("…"))).otherwise(c)


#: Counts below 10,000 in the middle between two tenths of a thousand whose binary quotient lies below it, or ties to the even tenth.
_DOWN = [n for n in range(1050, 10_000, 100) if f"{n / 1000:.1f}" == f"{(n - 1) / 1000:.1f}"]


def short_count(n: Column) -> Column:
    """950, 7.1k, 12k, 1.2M: one decimal below ten of a unit, none above; rounded as the binary quotient is."""
    k = F.when(n.isin(_DOWN), n - 1).otherwise(n) / 1e3
    return F.when(n.isNull(), None).when(n < 1000, n.cast("string")).when(n < 10_000, F.format_string("%.1fk", k)).when(n < 1_000_000, F.format_string("%dk", F.bround(n / 1e3).cast("bigint"))).otherwise(F.format_string("%.1fM", n / 1e6))


def duration(sec: Column) -> Column:
    """5s, 2m05s, 1h02m."""
    s = sec.cast("bigint")
    div = lambda a, b: F.floor(a / b).cast("bigint")
    return F.when(s.isNull(), None).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm%02ds", div(s, 60), s % 60)).otherwise(F.format_string("%dh%02dm", div(s, 3600), div(s % 3600, 60)))


def offset(start_us: Column, us: Column) -> Column:
    """Time since the start, never negative: +7s, +2m05s, +1h02m."""
    return F.concat(F.lit("+"), duration(F.greatest(F.floor((us - start_us) / 1_000_000), F.lit(0))))


def when(ts: Column) -> Column:
    """The minute of an ISO time."""
    return F.replace(F.left(ts, F.lit(16)), F.lit("T"), F.lit(" "))


def same_text(c: Column) -> Column:
    """Text for comparing: white space runs are one blank, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def text_key(heading: Column, text: Column) -> Column:
    """Sixteen hash digits of a heading and a text, by what :func:`same_text` keeps."""
    return F.substring(F.sha2(F.concat(same_text(heading), F.lit("\0"), same_text(text)), 256), 1, 16)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_path(path: Column) -> Column:
    """A path by its text alone: single slashes, no ``/./``, no slash at the end."""
    p = F.regexp_replace(F.regexp_replace(strip(path), "/+", "/"), r"(?:/\.)+(?=/|$)", "")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))
