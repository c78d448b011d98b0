"""Sizes, counts and dates as people write them."""

from __future__ import annotations

import re
from datetime import datetime

# Two-letter units are decimal, those with an i and single letters binary; counts are decimal.
DECIMAL, BINARY = ("kb", "mb", "gb", "tb", "pb"), ("kib", "mib", "gib", "tib", "pib")
SIZES = {"": 1, "b": 1} | {u: 1000 ** (i + 1) for i, u in enumerate(DECIMAL)} | {u: 1024 ** (i + 1) for i, u in enumerate(BINARY)} | {u[0]: 1024 ** (i + 1) for i, u in enumerate(DECIMAL)}
COUNTS = {"": 1, "k": 1000, "m": 1_000_000}
_NUMBER = re.compile(r"(\d+(?:\.\d+)?)\s*([a-zA-Z]*)")
_AGO = re.compile(r"(\d+)(yrs?|mo)", re.I)


def _number(text: str, units: dict[str, int], what: str) -> int:
    found = _NUMBER.fullmatch(text.strip())
    if not found or found[2].lower() not in units:
        raise ValueError(f"not a {what}: {text!r}")
    return int(float(found[1]) * units[found[2].lower()])


def parse_size(text: str) -> int:
    """Bytes of 1GiB, 500MB, 2T or a bare number."""
    return _number(text, SIZES, "size")


def parse_count(text: str) -> int:
    """A count as 500, 1K or 10M."""
    return _number(text, COUNTS, "count")


def parse_date(text: str, today: datetime | None = None) -> datetime:
    """A date as 2024-01-15, or the same day so many years (3yrs) or months (18mo) ago; days after the 28th become the 28th where they may be missing."""
    if not (found := _AGO.fullmatch(text.strip())):
        return datetime.strptime(text.strip(), "%Y-%m-%d")
    today, many = today or datetime.now(), int(found[1])
    by_month = found[2].lower() == "mo"
    year, month = divmod(today.year * 12 + today.month - 1 - many * (1 if by_month else 12), 12)
    kept = min(today.day, 28) if by_month or month == 1 else today.day
    return today.replace(year=year, month=month + 1, day=kept)


def format_size(size: float | None) -> str:
    """A size with one decimal in the largest binary unit that it fills; N/A for none."""
    if size is None:
        return "N/A"
    power = max(0, min(len(BINARY) + 1, (int(abs(size)).bit_length() - 1) // 10))
    return f"{size / (1 << 10 * power):.1f} " + ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")[power]
