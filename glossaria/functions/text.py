"""Column expressions for names, literals and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ENDINGS = ("default", "lf", "cr", "crlf")


def pascal_case(c: Column) -> Column:
    """Parts between underscores with their first letter raised, joined."""
    parts = F.filter(F.split(c, "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def literal_escape(c: Column) -> Column:
    """Escapes for a literal in single quotes."""
    for plain, safe in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def line_endings(c: Column, mode: str) -> Column:
    """lf and cr turn every line end into one; crlf drops lone carriage returns first."""
    if mode not in LINE_ENDINGS:
        raise ValueError(f"{mode!r} isn't one of {', '.join(LINE_ENDINGS)}")
    if mode == "lf":
        return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    if mode == "cr":
        return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\r")), F.lit("\n"), F.lit("\r"))
    return F.replace(F.replace(c, F.lit("\r")), F.lit("\n"), F.lit("\r\n")) if mode == "crlf" else c


def path_key(c: Column) -> Column:
    """A path's parts, by which paths sort."""
    return F.split(c, "/")


def prefixes(c: Column) -> Column:
    """All beginnings of a key's dash-separated parts, shortest first."""
    parts = F.split(c, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, 1, n))
