"""Windows and calendar bands over naive-UTC timestamps, with days of a site's own time zone."""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

SITE_ZONE = "America/Denver"
PERIODS = ("day", "week", "month")
MOST_BANDS, MOST_ROLLUP_BANDS = 400, 1200


def _utc(day: date, zone: str) -> datetime:
    """Midnight of a site day, as naive UTC."""
    return datetime.combine(day, time(), ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None)


def site_bounds(start: date | None, end: date | None, zone: str = SITE_ZONE) -> tuple[datetime | None, datetime | None]:
    """Half-open UTC bounds of the site days start to end, both included."""
    return (None if start is None else _utc(start, zone), None if end is None else _utc(end + timedelta(days=1), zone))


def in_site_days(ts: Column, start: date | None, end: date | None, zone: str = SITE_ZONE) -> Column:
    low, high = site_bounds(start, end, zone)
    out = F.lit(True)
    if low is not None:
        out = out & (ts >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        out = out & (ts < F.lit(high).cast("timestamp_ntz"))
    return out


def in_utc_days(ts: Column, start: date | None, end: date | None) -> Column:
    """Days of the stored (UTC) clock, both included: the older reports' convention."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= F.lit(datetime.combine(start, time())).cast("timestamp_ntz"))
    if end is not None:
        out = out & (ts < F.lit(datetime.combine(end + timedelta(days=1), time())).cast("timestamp_ntz"))
    return out


def site_day(ts: Column, zone: str = SITE_ZONE) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def period_start(day: Column, period: str) -> Column:
    """The first day of a calendar period; weeks start on Monday."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    return F.to_date(F.date_trunc(period, day))


def utc_label(ts: Column, period: str) -> Column:
    """Day, month, quarter or year label of the stored clock."""
    if period == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    pattern = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}.get(period)
    if pattern is None:
        raise ValueError("period must be day, month, quarter or year")
    return F.date_format(ts, pattern)


def bands(start: date, end: date, period: str, zone: str = SITE_ZONE, most: int = MOST_BANDS) -> list[dict]:
    """Calendar bands over the site days start to end: label, first and last day inside, and UTC bounds."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    out, at = [], start
    while at <= end:
        if period == "day":
            first, after = at, at + timedelta(days=1)
        elif period == "week":
            first = at - timedelta(days=at.weekday())
            after = first + timedelta(days=7)
        else:
            first = at.replace(day=1)
            after = (first + timedelta(days=32)).replace(day=1)
        last = min(end, after - timedelta(days=1))
        year, week, _ = first.isocalendar()
        label = {"day": first.isoformat(), "week": f"{year}-W{week:02d}", "month": f"{first:%Y-%m}"}[period]
        out.append({"label": label, "period": first, "start": at, "end": last, "utc_start": _utc(at, zone), "utc_end": _utc(last + timedelta(days=1), zone)})
        if len(out) > most:
            raise ValueError(f"more than {most} bands; take a longer period or a shorter window")
        at = after
    return out
