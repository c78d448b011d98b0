"""Name globs: * and ? only, all else literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_like(pattern: str) -> str:
    """A LIKE pattern with ! as the escape character."""
    return "".join("%" if c == "*" else "_" if c == "?" else f"!{c}" if c in "%_!" else c for c in pattern)


def matches_any(column: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """Whether a name matches one of the globs; empty patterns don't count, null never matches."""
    used = [p for p in patterns if p]
    if not used:
        return F.lit(False)
    value = F.lower(column) if ignore_case else column
    # LIKE, so that a literal beginning reaches the scan as a filter; the pattern is a plain text for the reader.
    tests = [F.like(value, F.lit(glob_like(p.lower() if ignore_case else p)), F.lit("!")) for p in used]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))
