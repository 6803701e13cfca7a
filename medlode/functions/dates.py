"""Dates of any precision as half-open UTC intervals, in search values and in documents."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlode.errors import Invalid
from medlode.functions.variant import items, node, text

#: Stand for no bound; Spark's timestamps have no infinity.
FIRST, LAST = datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999999)
PREFIXES = ("eq", "ne", "gt", "ge", "lt", "le", "sa", "eb", "ap")


@dataclass(frozen=True)
class Sought:
    prefix: str
    start: datetime
    end: datetime


def _later(at: datetime, **by) -> datetime:
    try:
        return at + timedelta(**by)
    except OverflowError:
        return LAST


def bounds(value: str) -> tuple[datetime, datetime]:
    """The interval of a date of year to second precision."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[Tt](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?([Zz]|[+-]\d\d:\d\d)?)?)?)?", value)
    if not m:
        raise Invalid(f"not a date: {value}")
    year, month, day, hour, minute, second, zone = m.groups()
    try:
        start = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0))
    except ValueError:
        raise Invalid(f"not a date: {value}") from None
    if day is None:
        months = 12 if month is None else 1
        total = start.year * 12 + start.month - 1 + months
        return start, LAST if total // 12 > 9999 else datetime(total // 12, total % 12 + 1, 1)
    if hour is None:
        return start, _later(start, days=1)
    if zone and zone not in "Zz":
        off = timedelta(hours=int(zone[1:3]), minutes=int(zone[4:]))
        if off > timedelta(hours=14) or int(zone[4:]) > 59:
            raise Invalid(f"no such offset: {zone}")
        try:
            start = start - off if zone[0] == "+" else start + off
        except OverflowError:
            raise Invalid(f"not a date: {value}") from None
    return start, _later(start, seconds=1) if second else _later(start, minutes=1)


def sought(value: str) -> Sought:
    prefix = value[:2] if value[:2] in PREFIXES else "eq"
    start, end = bounds(value[2:] if value[:2] in PREFIXES else value)
    return Sought(prefix, start, end)


def _lit(at: datetime) -> Column:
    return F.lit(at.replace(tzinfo=timezone.utc))


def matches(start: Column, end: Column, q: Sought) -> Column:
    """Whether the interval stands to the sought one as the prefix says; null bounds never match."""
    if q.prefix == "ap":
        widen = timedelta(milliseconds=round((q.end - q.start).total_seconds() * 100))
        low = q.start - widen if q.start - FIRST > widen else FIRST
        high = q.end + widen if LAST - q.end > widen else LAST
        return (start < _lit(high)) & (end > _lit(low))
    a, z = _lit(q.start), _lit(q.end)
    return {
        "eq": lambda: (start >= a) & (end <= z),
        "ne": lambda: (start < a) | (end > z),
        "gt": lambda: end > z,
        "ge": lambda: end > a,
        "lt": lambda: start < a,
        "le": lambda: start < z,
        "sa": lambda: start >= z,
        "eb": lambda: end <= a,
    }[q.prefix]()


# precision by shape of the text: what completes it to an instant, the unit it is cut to, and its length
_DAY = r"^\d{4}-\d{2}-\d{2}"
_ZONE = r"(Z|[+-]\d{2}:\d{2})"
_SHAPES = (
    (r"^\d{4}$", lambda s: F.concat(s, F.lit("-01-01T00:00:00Z")), "year", "1 year"),
    (r"^\d{4}-\d{2}$", lambda s: F.concat(s, F.lit("-01T00:00:00Z")), "month", "1 month"),
    (_DAY + "$", lambda s: F.concat(s, F.lit("T00:00:00Z")), "day", "1 day"),
    (_DAY + rf"T\d{{2}}:\d{{2}}{_ZONE}?$", lambda s: F.concat(s.substr(1, 16), F.lit(":00"), F.coalesce(F.nullif(F.regexp_extract(s, rf"T.*?{_ZONE}$", 1), F.lit("")), F.lit("Z"))), "minute", "1 minute"),
    (_DAY + rf"T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?{_ZONE}?$", lambda s: F.concat(s.substr(1, 19), F.coalesce(F.nullif(F.regexp_extract(s, rf"T.*?{_ZONE}$", 1), F.lit("")), F.lit("Z"))), "second", "1 second"),
)


def primitive_start(value: Column) -> Column:
    s, out = F.upper(value), F.lit(None).cast("timestamp")
    for shape, whole, unit, _ in _SHAPES:
        out = F.when(s.rlike(shape), F.date_trunc(unit, whole(s).try_cast("timestamp"))).otherwise(out)
    return out


def primitive_end(value: Column) -> Column:
    s, start, out = F.upper(value), primitive_start(value), F.lit(None).cast("timestamp")
    for shape, _, _, length in _SHAPES:
        out = F.when(s.rlike(shape), start + F.expr(f"INTERVAL {length}")).otherwise(out)
    return out


def _period(v: Column) -> tuple[Column, Column]:
    has_start, has_end = node(v, "start").isNotNull(), node(v, "end").isNotNull()
    start = F.when(has_start, primitive_start(text(v, "start"))).otherwise(F.when(has_end, _lit(FIRST)))
    return start, F.when(has_end, primitive_end(text(v, "end"))).otherwise(F.when(has_start, _lit(LAST)))


def interval(v: Column) -> tuple[Column, Column]:
    """Start and end of a date text, a Period or a Timing; null for anything else."""
    events = items(v, "event")
    whole = node(v, "repeat", "boundsPeriod")
    low, high = _period(whole)
    first = F.least(F.array_min(F.transform(events, lambda x: primitive_start(x.try_cast("string")))), low)
    last = F.greatest(F.array_max(F.transform(events, lambda x: primitive_end(x.try_cast("string")))), high)
    timing = events.isNotNull() | whole.isNotNull()
    own = text(v)
    start, end = _period(v)
    return F.when(timing, first).otherwise(F.coalesce(start, primitive_start(own))), F.when(timing, last).otherwise(F.coalesce(end, primitive_end(own)))
