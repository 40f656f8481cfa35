"""Durations, date strings and time ranges, all in epoch milliseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 7 * 86_400_000, "month": 30 * 86_400_000, "y": 365 * 86_400_000}
_NAMES = {"second": "s", "seconds": "s", "minute": "m", "min": "m", "minutes": "m", "hour": "h", "hours": "h", "day": "d", "days": "d", "wk": "w", "week": "w", "weeks": "w", "months": "month", "year": "y", "years": "y"}
_SHORT = re.compile(r"(\d+)\s*([a-z]+)$")
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")
_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?(.*)$")


def duration(text: str) -> int:
    """Milliseconds of 5m, 1h, 2w, 1month, 1y or an ISO period such as PT5M; months are 30 and years 365 days."""
    m = _SHORT.match(text)
    if m and _NAMES.get(m[2], m[2]) in _UNITS:
        return int(m[1]) * _UNITS[_NAMES.get(m[2], m[2])]
    m = _ISO.match(text)
    if m and any(m.groups()):
        y, mo, w, d, h, mi, s = (float(x or 0) for x in m.groups())
        return int(((y * 365 + mo * 30 + w * 7 + d) * 86_400 + h * 3600 + mi * 60 + s) * 1000)
    raise ValueError(f"invalid duration: {text}")


def _epoch(n: int) -> int:
    """Seconds, milliseconds, microseconds or nanoseconds, told apart by their size."""
    for limit, scale in ((10**10, 1000), (10**13, 1)):
        if abs(n) < limit:
            return n * scale
    return n // 1000 if abs(n) < 10**16 else n // 1_000_000


def timestamp(text: str, tz: str = "UTC", now: int | None = None, refs: dict[str, int] | None = None) -> int:
    """A date: now, epoch, digits, an ISO date with optional time and zone, a reference name, each with ± a duration."""
    refs = {"now": now if now is not None else int(datetime.now(timezone.utc).timestamp() * 1000), "epoch": 0} | (refs or {})
    m = re.match(r"([A-Za-z]+|\d+)([+-])(.+)$", text)
    if m and (m[1] in refs or m[1].isdigit()) and not re.match(r"\d{4}-\d\d-\d\d", text):
        base = refs[m[1]] if m[1] in refs else _epoch(int(m[1]))
        return base + (1 if m[2] == "+" else -1) * duration(m[3])
    if text in refs:
        return refs[text]
    if re.fullmatch(r"-?\d+", text):
        return _epoch(int(text))
    m = _STAMP.match(text)
    if not m:
        raise ValueError(f"invalid date: {text}")
    zone = m[8].strip("[]")
    where = timezone.utc if zone in ("Z", "z") else ZoneInfo(tz) if not zone else _zone(zone)
    whole = datetime(*(int(x or 0) for x in m.groups()[:6]), tzinfo=where)
    return int(whole.timestamp()) * 1000 + int((m[7] or "0").ljust(3, "0")[:3])


def _zone(text: str) -> timezone | ZoneInfo:
    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)?", text)
    if m:
        off = timedelta(hours=int(m[2]), minutes=int(m[3] or 0))
        return timezone(off if m[1] == "+" else -off)
    return ZoneInfo(text)


def time_range(start: str, end: str, tz: str = "UTC", now: int | None = None) -> tuple[int, int]:
    """Start and end, where either may be relative to the other (e-3h, s+1h)."""
    if start.startswith("s"):
        raise ValueError("the start can't be relative to itself")
    if end.startswith("e") and not end.startswith("epoch"):
        raise ValueError("the end can't be relative to itself")
    if start.startswith("e") and not start.startswith("epoch"):
        e = timestamp(end, tz, now)
        return timestamp(start, tz, now, {"e": e}), e
    s = timestamp(start, tz, now)
    return s, timestamp(end, tz, now, {"s": s})


#: Steps that a graph may use, from finest.
STEPS = [*(s * 1000 for s in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)), *(m * 60_000 for m in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)), *(h * 3_600_000 for h in (1, 2, 3, 4, 6, 8, 12, 24))]


def auto_step(primary: int, start: int, end: int, width: int = 1440) -> int:
    """The finest allowed step, a multiple of the primary one, that gives at most `width` points."""
    least = max(primary, -(-(end - start) // max(1, width)))
    for s in STEPS:
        if s >= least and s % primary == 0:
            return s
    day = 86_400_000
    return -(-least // day) * day


def round_up(ts: int, step: int) -> int:
    return -(-ts // step) * step
