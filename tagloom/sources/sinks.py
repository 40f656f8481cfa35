"""Sinks of evaluated lines (expr, label, tags, ts, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.sources.series import utc_time


def pivoted(lines: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row for each ts, one column for each label; given labels save the pass that finds them."""
    return lines.groupBy("ts").pivot("label", labels).agg(F.first("value", ignorenulls=True)).orderBy("ts")


def write_csv(lines: DataFrame, path: str, separator: str = ",", labels: list[str] | None = None) -> None:
    """A table with header: timestamp, then the labels."""
    table = pivoted(lines, labels)
    stamp = F.concat(F.replace(F.substring(utc_time(F.col("ts")).cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z")).alias("timestamp")
    table.select(stamp, *[F.col(f"`{c}`") for c in table.columns if c != "ts"]).write.option("header", True).option("sep", separator).csv(path)


def series_json(lines: DataFrame, start: int, step: int, end: int) -> DataFrame:
    """One JSON document for each line: label, tags, start, step and its values on every boundary."""
    packed = lines.groupBy("expr", "label", F.to_json("tags").alias("_tags")).agg(F.map_from_entries(F.collect_list(F.struct("ts", "value"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(start), F.lit(end - step), F.lit(step)), lambda t: F.element_at("_m", t))
    return packed.select("expr", "label", F.to_json(F.struct("label", F.from_json("_tags", "map<string,string>").alias("tags"), F.lit(start).alias("start"), F.lit(step).alias("step"), values.alias("values")), {"ignoreNullFields": "false"}).alias("json"))


def statistics(lines: DataFrame) -> DataFrame:
    """count, avg, min, max, last and total of each line."""
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts")))
    return lines.groupBy("expr", "label").agg(F.count("value").alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), last.alias("last"), F.sum("value").alias("total"))


def heatmap(lines: DataFrame, low: float | None, high: float | None, cells: int) -> DataFrame:
    """Counts of values by ts and cell of equal height; values outside the bounds are left out. A bound that is None is the least or greatest value."""
    if low is None or high is None:
        found = lines.agg(F.min("value"), F.max("value")).first()  # two numbers
        low, high = found[0] if low is None else low, found[1] if high is None else high
        if low is None or high is None:
            low, high = 0.0, 1.0
        high = max(high, math.nextafter(low, math.inf))
    cell = F.least(F.floor((F.col("value") - low) / ((high - low) / cells)), F.lit(cells - 1)).cast("int")
    return lines.where(F.col("value").between(low, high)).groupBy("ts", cell.alias("cell")).agg(F.count("*").alias("count"))


def append_points(points: DataFrame, path: str, partition_ms: int = 86_400_000) -> None:
    """Append datapoints as Parquet, partitioned by block start, so that ranges prune files."""
    points.withColumn("block", (F.floor((F.col("ts") - 1) / partition_ms) * partition_ms).cast("long")).write.mode("append").partitionBy("block").parquet(path)


def write_jdbc(points: DataFrame, url: str, table: str, **options: str) -> None:
    """Bulk load over JDBC; the tags go as JSON."""
    points.withColumn("tags", F.to_json("tags")).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


def fetch_messages(lines: DataFrame, start: int, step: int, end: int) -> DataFrame:
    """Messages of a fetch, one JSON document a row: a metadata message, one for each line with a value, and a close message."""
    spark = lines.sparkSession
    message = lambda order, kind: spark.range(1).select(F.lit(order).alias("order"), F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(step).alias("step"))).alias("json"))
    data = series_json(lines.where(F.col("value").isNotNull()), start, step, end).select(F.lit(1).alias("order"), "json")
    return message(0, "metadata").unionByName(data).unionByName(message(2, "close"))


def sharded(points: DataFrame, shards: int) -> DataFrame:
    """Points with the shard that their line belongs to, and dealt out by it."""
    from tagloom.sources.series import series_id

    return points.withColumn("shard", F.pmod(F.xxhash64(series_id(F.col("tags"))), F.lit(shards)).cast("int")).repartition(shards, "shard")
