"""Null-safe math as Column expressions: null is missing, NaN never leaves an operator."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def truth(c: Column) -> Column:
    return F.coalesce(F.abs(c) >= 1e-12, F.lit(False))


#: What exact_sum cuts values into multiples of, coarse to fine.
_QUANTA = tuple(2.0**e for e in (32, 0, -32, -64))


def exact_sum(v: Column) -> Column:
    """Aggregate: the sum of doubles without the rounding of each addition, so that it doesn't depend on their order.

    Each value is cut into multiples of the quanta, which add up without rounding for up
    to four million rows below 2**85, and a rest under 2**-64.
    """
    parts, before = [], F.lit(0.0)
    for k, q in enumerate(_QUANTA):
        shift = 1.5 * 2.0**52 * q  # adding it rounds to a multiple of q
        cut = F.when(F.abs(v) < 2.0**51 * q, (v + shift) - shift).otherwise(v)
        # what a coarser quantum left whole (large and infinite values) has no finer parts
        parts.append(cut if k == 0 else F.when(F.abs(v) < 2.0**51 * _QUANTA[k - 1], cut - before).otherwise(F.lit(0.0)))
        before = cut
    parts.append(F.when(F.abs(v) < 2.0**51 * _QUANTA[-1], v - before).otherwise(F.lit(0.0)))
    out = F.sum(parts[0])
    for part in parts[1:]:
        out = out + F.sum(part)
    return out


#: Statistics of a line over its points, as aggregates. Filters and ranks compare totals and averages, so a last digit may decide.
STATISTICS = {
    "avg": lambda c: exact_sum(F.col(c)) / F.nullif(F.count(c), F.lit(0)),
    "max": F.max,
    "min": F.min,
    "total": lambda c: exact_sum(F.col(c)),
    "count": lambda c: F.count(c).cast("double"),
    "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))),
}


def constant(v: float) -> Column:
    return F.lit(None).cast("double") if math.isnan(v) else F.lit(float(v))


def _divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.when(a == 0, 0.0)).otherwise(F.try_divide(a, b))


def _ieee_divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf"))).otherwise(F.try_divide(a, b))


BINARY = {
    "add": lambda a, b: F.coalesce(known(a + b), a, b),
    "sub": lambda a, b: F.coalesce(known(a - b), a, -b),
    "mul": lambda a, b: known(a * b),
    "div": lambda a, b: known(_divided(a, b)),
    "pow": lambda a, b: F.when(b == 0, 1.0).otherwise(known(F.pow(a, b))),
    "gt": lambda a, b: F.coalesce((a > b).cast("double"), F.lit(0.0)),
    "ge": lambda a, b: F.coalesce((a >= b).cast("double"), F.lit(0.0)),
    "lt": lambda a, b: F.coalesce((a < b).cast("double"), F.lit(0.0)),
    "le": lambda a, b: F.coalesce((a <= b).cast("double"), F.lit(0.0)),
    "fadd": lambda a, b: known(a + b),
    "fsub": lambda a, b: known(a - b),
    "fmul": lambda a, b: known(a * b),
    "fdiv": lambda a, b: known(_ieee_divided(a, b)),
    "and": lambda a, b: (truth(a) & truth(b)).cast("double"),
    "or": lambda a, b: (truth(a) | truth(b)).cast("double"),
}
#: Missing on either side gives missing, so absent rows need not be filled in.
STRICT = frozenset(("mul", "div", "fadd", "fsub", "fmul", "fdiv"))
#: Missing on both sides gives missing.
LENIENT = frozenset(("add", "sub"))


def unary(op: str, a: Column, step: int) -> Column:
    if op == "abs":
        return F.abs(a)
    if op == "neg":
        return -a
    if op == "sin":
        return known(F.sin(a))
    if op == "sqrt":
        return F.when(a >= 0, F.sqrt(a))
    if op == "per-step":
        return a * (step / 1000.0)
    raise ValueError(op)


def clamp(op: str, a: Column, bound: float) -> Column:
    return F.when(a < bound, bound).otherwise(a) if op == "clamp-min" else F.when(a > bound, bound).otherwise(a)


_PARTS = {
    "secondOfMinute": F.second,
    "minuteOfHour": F.minute,
    "hourOfDay": F.hour,
    "dayOfWeek": lambda t: F.weekday(t) + 1,
    "dayOfMonth": F.dayofmonth,
    "dayOfYear": F.dayofyear,
    "monthOfYear": F.month,
    "yearOfCentury": lambda t: F.year(t) % 100,
    "yearOfEra": F.year,
    "year": F.year,
    "minuteOfDay": lambda t: F.hour(t) * 60 + F.minute(t),
    "secondOfDay": lambda t: (F.hour(t) * 60 + F.minute(t)) * 60 + F.second(t),
    "weekOfYear": F.weekofyear,
    "quarterOfYear": F.quarter,
}
_SINCE = {"seconds": 1000.0, "minutes": 60_000.0, "hours": 3_600_000.0, "days": 86_400_000.0, "weeks": 7 * 86_400_000.0}


def time_part(mode: str, ts: Column) -> Column:
    """Calendar fields in UTC, or time since the epoch as a fraction."""
    from tagloom.sources.series import utc_time

    if mode in _SINCE:
        return ts / _SINCE[mode]
    if mode not in _PARTS:
        raise ValueError(f"unknown time mode: {mode}")
    return _PARTS[mode](utc_time(ts)).cast("double")


def pseudo_random(ts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) with three digits that depends on the time only: an integer hash in 32 bits."""
    mask = 0xFFFFFFFF
    x = ts.bitwiseXOR(F.lit(seed).cast("long"))
    x = x.bitwiseXOR(F.shiftright(x, 32)).bitwiseAND(mask)
    for shift, by in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = x.bitwiseXOR(F.shiftright(x, shift))
        # the product in 16-bit halves, as 64 bits would overflow
        low, high = x.bitwiseAND(0xFFFF), F.shiftright(x, 16)
        x = (low * by + F.shiftleft((high * by).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return (x % 1000) / 1000.0


def matches(query, key) -> Column:
    """A tag predicate as a Column; key gives the Column of a tag or None. A missing tag makes a comparison false."""
    from tagloom.plans import nodes as n

    if isinstance(query, n.Always):
        return F.lit(query.value)
    if isinstance(query, n.And):
        return matches(query.left, key) & matches(query.right, key)
    if isinstance(query, n.Or):
        return matches(query.left, key) | matches(query.right, key)
    if isinstance(query, n.Not):
        # null-safe at the leaf, so that the negation of a missing tag is true
        return ~F.coalesce(matches(query.query, key), F.lit(False))
    c = key(query.key)
    if c is None:
        return F.lit(False)
    if isinstance(query, n.Has):
        return c.isNotNull()
    if isinstance(query, n.In):
        return c.isin(*query.values)
    v = query.value
    op = query.op
    if op in ("re", "reic"):
        plain = v.replace("-", "").replace("_", "").isalnum()
        return c.startswith(v) if op == "re" and plain else c.rlike(("(?i)" if op == "reic" else "") + f"^(?:{v})")
    return {"eq": lambda: c == v, "lt": lambda: c < v, "le": lambda: c <= v, "gt": lambda: c > v, "ge": lambda: c >= v, "contains": lambda: c.contains(v), "starts": lambda: c.startswith(v), "ends": lambda: c.endswith(v)}[op]()


def could_match(query, tags: dict[str, str]) -> bool:
    """Whether a predicate may hold for a tag set of which only some tags are known: for pruning tables and partitions."""
    from tagloom.plans import nodes as n

    def known(q) -> bool | None:
        """True or False where the known tags decide, else None."""
        if isinstance(q, n.Always):
            return q.value
        if isinstance(q, n.Not):
            inner = known(q.query)
            return None if inner is None else not inner
        if isinstance(q, (n.And, n.Or)):
            stop = isinstance(q, n.Or)
            both = known(q.left), known(q.right)
            return stop if stop in both else None if None in both else not stop
        return _one_value(q, tags[q.key]) if q.key in tags else None

    return known(query) is not False


def _one_value(q, value: str) -> bool:
    from tagloom.plans import nodes as n

    if isinstance(q, n.Has):
        return True
    if isinstance(q, n.In):
        return value in q.values
    v = q.value
    return {
        "eq": lambda: value == v,
        "lt": lambda: value < v,
        "le": lambda: value <= v,
        "gt": lambda: value > v,
        "ge": lambda: value >= v,
        "re": lambda: re.match(v, value) is not None,
        "reic": lambda: re.match(v, value, re.I) is not None,
        "contains": lambda: v in value,
        "starts": lambda: value.startswith(v),
        "ends": lambda: value.endswith(v),
    }[q.op]()


def matches_any_value(query, tags: dict[str, list[str]]) -> bool:
    """Whether a predicate holds where each comparison is true if any of a key's values is."""
    from tagloom.plans import nodes as n

    if isinstance(query, n.Always):
        return query.value
    if isinstance(query, n.Not):
        return not matches_any_value(query.query, tags)
    if isinstance(query, n.And):
        return matches_any_value(query.left, tags) and matches_any_value(query.right, tags)
    if isinstance(query, n.Or):
        return matches_any_value(query.left, tags) or matches_any_value(query.right, tags)
    return any(_one_value(query, v) for v in tags.get(query.key) or ())


def matches_any(query, key) -> Column:
    """matches_any_value as a Column; key gives the array Column of a tag's values or None."""
    from tagloom.plans import nodes as n

    if isinstance(query, n.Always):
        return F.lit(query.value)
    if isinstance(query, n.Not):
        return ~matches_any(query.query, key)
    if isinstance(query, n.And):
        return matches_any(query.left, key) & matches_any(query.right, key)
    if isinstance(query, n.Or):
        return matches_any(query.left, key) | matches_any(query.right, key)
    c = key(query.key)
    if c is None:
        return F.lit(False)
    return F.coalesce(F.exists(c, lambda v: F.coalesce(matches(query, lambda k: v), F.lit(False))), F.lit(False))
