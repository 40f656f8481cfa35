"""Percentile buckets with the public numbering: 1, 2, 3, then steps of a third of each power of four.

A bucket holds the values from the bound before it up to its own, which it excludes; the
last bound is the largest signed 64-bit number. A bucket is tagged D or T (nanoseconds)
and its number as four upper-case hex digits.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bounds() -> list[int]:
    out = [1, 2, 3]
    for power in (4**k for k in range(1, 31)):
        out += range(power, 4 * power - power // 3, power // 3)
    return [*out, 2**63 - 1]


BOUNDS = [float(b) for b in _bounds()]
COUNT = len(BOUNDS)
#: Number of the bound that is each power of four.
_POWERS = [BOUNDS.index(float(4**k)) for k in range(31)]


def index_of(value: float) -> int:
    """The bucket of a value: the first with a bound above it; 0 for negative values."""
    return min(bisect.bisect_right(BOUNDS, value), COUNT - 1)


def tag_of(index: int, prefix: str = "D") -> str:
    return f"{prefix}{index:04X}"


def index_column(value: Column) -> Column:
    """index_of as a Column."""
    v = F.floor(value).cast("long")
    bits = F.length(F.bin(v)) - 1
    power = bits - bits % 2
    base = F.call_function("shiftleft", F.lit(1).cast("long"), power.cast("int"))
    at = F.get(F.array(*map(F.lit, _POWERS)), (power / 2).cast("int"))
    # the last step of a power is wider than the others
    steps = F.least(F.floor((v - base) / F.greatest(F.lit(1).cast("long"), F.floor(base / 3))), F.when(power == 2, 10).otherwise(8))
    above = F.when(power >= 62, COUNT - 1).otherwise(at + steps + 1)
    out = F.when(v < 1, 0).when(v <= 4, v).otherwise(above)
    return F.least(out, F.lit(COUNT - 1)).cast("int")


def tag_column(value: Column, prefix: str = "D") -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.hex(index_column(value)), 4, "0"))


def bucket_range(low: float, high: float):
    """A predicate for the buckets whose values lie between low and high."""
    from tagloom.plans import nodes as n

    first, last = index_of(low), COUNT - 1 if high == float("inf") else index_of(high)
    if first == 0 and last == COUNT - 1:
        return n.Has("percentile")
    span = lambda p: n.conj(n.Compare("ge", "percentile", tag_of(first, p)), n.Compare("le", "percentile", tag_of(last, p)))
    return n.disj(span("D"), span("T"))


def percentile_columns(counts: Column, percentiles: Sequence[float]) -> Column:
    """An array of estimates from an array of (bucket, count) sorted by bucket, in one pass; linear inside a bucket; null without counts."""
    bounds = F.array(*[F.lit(b) for b in BOUNDS])
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["count"])
    shares = F.array(*[F.lit(p / 100.0) for p in percentiles])

    def step(a: Column, x: Column) -> Column:
        low = F.when(x["bucket"] == 0, 0.0).otherwise(F.get(bounds, x["bucket"] - 1))
        high = F.get(bounds, x["bucket"])

        def estimate(done: Column, share: Column) -> Column:
            target = a["total"] * share
            here = done.isNull() & (a["sum"] + x["count"] >= target - 1e-9) & (x["count"] > 0)
            return F.when(here, low + (high - low) * F.greatest(target - a["sum"], F.lit(0.0)) / x["count"]).otherwise(done)

        return F.struct((a["sum"] + x["count"]).alias("sum"), a["total"].alias("total"), F.zip_with(a["done"], shares, estimate).alias("done"))

    zero = F.struct(F.lit(0.0).alias("sum"), total.alias("total"), F.array(*[F.lit(None).cast("double")] * len(percentiles)).alias("done"))
    return F.when(total > 0, F.aggregate(counts, zero, step)["done"])
