"""Tag metadata: keys, values and tag sets of the series that match a predicate, in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.lang.words import parse_query
from tagloom.operators.columns import matches
from tagloom.sources.series import Source


def series_table(source: Source, query: str = ":true") -> DataFrame:
    """The distinct tag sets; small beside the data, so worth caching by the caller."""
    rows = source.df.where(matches(parse_query(query), source.key))
    return rows.select(source.series().alias("_id")).distinct().select(F.from_json("_id", "map<string,string>").alias("tags"))


def _page(df: DataFrame, column: str, offset: str | None, limit: int | None) -> DataFrame:
    df = df.where(F.col(column) > offset) if offset is not None else df
    return df.orderBy(column).limit(limit) if limit is not None else df


def tag_keys(source: Source, query: str = ":true", offset: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct keys after `offset`, in order where limited."""
    each = source.df.where(matches(parse_query(query), source.key)).select(F.explode(F.map_keys(source.tags_column())).alias("key"))
    return _page(each.distinct(), "key", offset, limit)


def tag_values(source: Source, key: str, query: str = ":true", offset: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct values of a key after `offset`."""
    c = source.key(key)
    rows = source.df.where(matches(parse_query(query), source.key))
    values = rows.select((c if c is not None else F.lit(None)).cast("string").alias("value")).where(F.col("value").isNotNull())
    return _page(values.distinct(), "value", offset, limit)


def tags(source: Source, query: str = ":true", key: str | None = None, offset: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct (key, value) pairs with the number of series that have them."""
    pairs = series_table(source, query).select(F.explode("tags").alias("key", "value"))
    if key is not None:
        pairs = pairs.where(F.col("key") == key)
    counted = pairs.groupBy("key", "value").agg(F.count("*").alias("series"))
    if offset is not None:
        counted = counted.where(F.concat_ws("=", "key", "value") > offset)
    return counted.orderBy("key", "value").limit(limit) if limit is not None else counted
