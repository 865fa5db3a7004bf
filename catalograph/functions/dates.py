"""Instants, ranges, periodic windows and collection dates."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of date-time text, UTC where no offset is given.
_FORMS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd",
]
_ISO = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?)?)?(Z|[+-]\d\d:?\d\d)?$")


def parse_datetime(c: Column) -> Column:
    """Date-time text in any of the known forms as a UTC instant; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in _FORMS]).cast("timestamp_ntz")


def parse_instant(text: str) -> dt.datetime:
    """A whole or shortened ISO 8601 instant, in UTC."""
    m = _ISO.match(text.strip())
    if not m:
        raise ValueError(f"not a date-time: {text}")
    y, mo, d, h, mi, s, frac, zone = m.groups()
    out = dt.datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(6, "0")[:6]))
    if zone and zone != "Z":
        sign = -1 if zone[0] == "+" else 1
        out += sign * dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
    return out


_PERIOD = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")


def _add(t: dt.datetime, period: str, sign: int) -> dt.datetime:
    m = _PERIOD.match(period)
    if not m or period == "P":
        raise ValueError(f"not a period: {period}")
    y, mo, w, d, h, mi, s = (int(x or 0) for x in m.groups())
    months = t.month - 1 + sign * (12 * y + mo)
    year, month = t.year + months // 12, months % 12 + 1
    t = t.replace(year=year, month=month, day=min(t.day, calendar.monthrange(year, month)[1]))
    return t + sign * dt.timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s)


def parse_range(text: str) -> tuple[dt.datetime | None, dt.datetime | None]:
    """``start,end`` with either open, or ISO 8601 ``start/end``, ``start/period``, ``period/end``."""
    sep = "/" if "/" in text else ","
    a, _, b = (p.strip() for p in text.partition(sep))
    if a.startswith("P") and b:
        end = parse_instant(b)
        return _add(end, a, -1), end
    if b.startswith("P"):
        start = parse_instant(a)
        return start, _add(start, b, 1)
    start, end = parse_instant(a) if a else None, parse_instant(b) if b else None
    if start and end and start > end:
        raise ValueError("range starts after its end")
    return start, end


def _day(year: int, day: int) -> dt.datetime:
    """Midnight of a day of the year; from day 59 on leap years count one more, so that day 60 is 1 March in each."""
    offset = day if calendar.isleap(year) and day >= 59 else day - 1
    return dt.datetime(year, 1, 1) + dt.timedelta(days=offset)


def period_window(year: int, start: dt.datetime, end: dt.datetime | None, start_day: int, end_day: int | None) -> tuple[dt.datetime, dt.datetime]:
    """The window of days in a year, at the times of day of start and end, clipped to them.

    An end day before the start day falls in the next year: it is built in this one and moved.
    Without an end day the window lasts to the year's last second, or to the end in its year.
    """
    a = max(start, dt.datetime.combine(_day(year, start_day).date(), start.time()))
    if end_day is None:
        b = end if end and end.year == year else dt.datetime(year + 1, 1, 1) - dt.timedelta(seconds=1)
    else:
        b = dt.datetime.combine(_day(year, end_day).date(), end.time() if end else dt.time())
        if end_day < start_day:
            leap = (b.month, b.day) == (2, 29)
            b = b.replace(year=year + 1, day=28 if leap else b.day)
        if end and b > end:
            b = end
    return a, b


def periodic_windows(start: dt.datetime, end: dt.datetime | None, start_day: int | None, end_day: int | None, now: dt.datetime) -> list[tuple]:
    """Windows of each year from start to end (to now if open) that aren't empty."""
    years = range(start.year, (end or now).year + 1)
    found = [period_window(y, start, end, start_day or 1, end_day) for y in years]
    return [(a, b) for a, b in found if a <= b]


# ---------------------------------------------------------------- columns


def collection_start(singles: Column, ranges: Column, periodic: Column) -> Column:
    """Earliest of single dates, range starts and periodic starts."""
    return F.array_min(F.concat(F.coalesce(singles, F.array()), F.transform(F.coalesce(ranges, F.array()), lambda r: r["start"]), F.transform(F.coalesce(periodic, F.array()), lambda r: r["start"])))


def collection_end(singles: Column, ranges: Column, periodic: Column, ends_at_present: Column) -> Column:
    """Latest end; null ("present") if a range is open or flagged as running."""
    ranges, periodic = F.coalesce(ranges, F.array()), F.coalesce(periodic, F.array())
    present = F.coalesce(ends_at_present, F.lit(False)) | F.exists(ranges, lambda r: r["end"].isNull())
    latest = F.array_max(F.concat(F.coalesce(singles, F.array()), F.transform(ranges, lambda r: r["end"]), F.transform(periodic, lambda r: r["end"])))
    return F.when(~present, latest)


def granule_start(single: Column, start: Column) -> Column:
    return F.coalesce(single, start)


def granule_end(single: Column, end: Column) -> Column:
    return F.coalesce(single, end)


def seconds(c: Column) -> Column:
    """Seconds since 1970 as a double, with microseconds."""
    return F.unix_micros(c.cast("timestamp")) / 1e6


def temporal_overlap(ranges: Column, requested: list[tuple], now: dt.datetime) -> Column:
    """Share of the requested spans that a row's range (start, end struct) covers; no end means now."""
    total, covered = 0.0, F.lit(0.0)
    for a, b in requested:
        a, b = a or dt.datetime(1970, 1, 1), b or now
        total += (b - a).total_seconds()
        lo = F.greatest(seconds(ranges["start"]), F.lit(a.replace(tzinfo=dt.timezone.utc).timestamp()))
        hi = F.least(F.coalesce(seconds(ranges["end"]), F.lit(now.replace(tzinfo=dt.timezone.utc).timestamp())), F.lit(b.replace(tzinfo=dt.timezone.utc).timestamp()))
        covered = covered + F.greatest(hi - lo, F.lit(0.0))
    return F.when(ranges["start"].isNull() | F.lit(total <= 0), F.lit(0.0)).otherwise(covered / F.lit(max(total, 1e-9)))
