"""Series sources: tables whose rows are datapoints with tags."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Source:
    """Rows of datapoints.

    tags: the Column of each tag, or None if `tag_map` names a map column that has them.
    ts: epoch milliseconds of the interval's end. between: the filter of low < ts <= high
    on stored columns, so that it reaches the scan. step: the primary step in ms.
    unique: rows are at most one for each series and primary interval, so that :count,
    which is the number of series with a value, may count rows without telling series apart.
    """

    df: DataFrame
    ts: Column
    value: Column
    step: int
    tags: dict[str, Column] = field(default_factory=dict)
    tag_map: str | None = None
    between: Callable[[int, int], Column] | None = None
    dstype_key: str = "dstype"
    snap: bool = True
    unique: bool = False

    def key(self, name: str) -> Column | None:
        if self.tag_map is not None and name not in self.tags:
            return F.col(self.tag_map)[name]
        return self.tags.get(name)

    def in_range(self, low: int, high: int) -> Column:
        return self.between(low, high) if self.between else (self.ts > low) & (self.ts <= high)

    def series(self) -> Column:
        """A string that identifies a series: its sorted tags as JSON."""
        return F.to_json(self.tags_column())

    def tags_column(self) -> Column:
        if self.tag_map is not None:
            entries = F.col(self.tag_map)
            for k, c in self.tags.items():
                entries = F.map_concat(entries, F.create_map(F.lit(k), c))
        else:
            entries = F.create_map(*[x for k in sorted(self.tags) for x in (F.lit(k), self.tags[k].cast("string"))])
        kept = F.map_filter(entries, lambda k, v: v.isNotNull())
        return F.map_from_entries(F.array_sort(F.map_entries(kept)))


def series_id(tags: Column) -> Column:
    """SHA-1 of the sorted tags: equal tags, equal ids."""
    return F.sha1(F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


def datapoints(df: DataFrame, step: int) -> Source:
    """A table in canonical form: tags MAP, ts BIGINT (interval end), value DOUBLE (null is missing)."""
    return Source(df, F.col("ts"), F.when(~F.isnan("value"), F.col("value")), step, tag_map="tags")


def utc_millis(c: Column, kind: str) -> Column:
    """Epoch milliseconds of a time of a column type; times without zone are read as UTC, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_millis(c)
    if kind == "date":
        return (F.unix_date(c) * 86_400_000).cast("long")
    c = c.cast("timestamp_ntz")
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")).cast("long") * 86_400_000 + seconds.cast("long") * 1000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")


def utc_time(ts: Column) -> Column:
    """Epoch milliseconds as a time without zone, in UTC."""
    day = F.floor(ts / 86_400_000)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), (F.pmod(ts, F.lit(86_400_000)) / 1000).cast("decimal(18,6)"))


def millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a time column."""
    return utc_millis(F.col(column), dict(df.dtypes)[column])


def between_times(column: str, kind: str = "timestamp_ntz") -> Callable[[int, int], Column]:
    """low < column <= high with bounds as literals of the column's own type, which the scan can use."""

    def literal(ms: int) -> Column:
        if kind == "timestamp":
            return F.timestamp_millis(F.lit(ms))
        at = datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        # a date is after a bound if its midnight is
        return F.lit(at[:10] if kind == "date" else at).cast(kind)

    return lambda low, high: (F.col(column) > literal(low)) & (F.col(column) <= literal(high))


def flat(df: DataFrame, time: str, value: Column, tags: dict[str, Column], step: int) -> Source:
    """A flat table with a timestamp column; rows fall into the interval that ends at or after them."""
    kind = dict(df.dtypes)[time]
    return Source(df, millis(df, time), value.cast("double"), step, tags, between=between_times(time, kind))
