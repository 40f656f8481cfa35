"""Ingest normalization: raw samples of counters, rates, gauges and sums become points on step boundaries.

Samples have series_id, tags, ts (ms) and value. Each function works per series with
window functions or grouped aggregates; only the first sample of a series needs a rule
of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heartbeat_of(step: int) -> int:
    """Two minutes below a step of one minute, else two steps."""
    return 120_000 if step < 60_000 else 2 * step


def step_end(ts: Column, step: int) -> Column:
    return (F.ceil(ts / step) * step).cast("long")


def counter_to_rate(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rates per second between samples of monotonic counters; a reset gives 0, the first sample nothing."""
    w = Window.partitionBy(*ids).orderBy("ts")
    dv, dt = F.col("value") - F.lag("value").over(w), F.col("ts") - F.lag("ts").over(w)
    rate = F.when(dt.isNull(), F.lit(None)).when((dv < 0) | (dt <= 0), 0.0).otherwise(F.try_divide(dv, dt / 1000.0))
    return df.withColumn("value", rate).where(F.col("value").isNotNull())


def regrid(df: DataFrame, ids: list[str], step: int, heartbeat: int) -> DataFrame:
    """Time-weighted points on step boundaries.

    A sample stands for the time since the one before it, if that is within the
    heartbeat; a boundary's value is the sum of what overlaps its interval, by share, and
    is emitted once a sample at or after the boundary is there. The first sample of a
    line, or the first after a gap, on a boundary is that boundary's value; off a
    boundary it gives the boundary before it the share of the step that is left, and
    counts from that boundary on. Samples that repeat a time are ignored.
    """
    w = Window.partitionBy(*ids).orderBy("ts")
    prev = F.lag("ts").over(w)
    fresh = F.coalesce(F.col("ts") - prev > heartbeat, F.lit(True))
    floor = (F.floor(F.col("ts") / step) * step).cast("long")
    spans = df.select(*ids, "ts", "value", fresh.alias("_fresh"), floor.alias("_floor"), F.when(fresh, F.when(F.col("ts") == floor, F.col("ts") - step).otherwise(floor)).otherwise(prev).cast("long").alias("_from"))
    # what lies between gaps; its last interval stays open
    spans = spans.withColumn("_run", F.sum(F.col("_fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("_last", F.max("ts").over(Window.partitionBy(*ids, "_run")))
    first, last = step_end(F.col("_from") + 1, step), step_end(F.col("ts"), step)
    # a sample spans a few intervals at most, as the heartbeat bounds it
    cells = spans.where("ts > _from").select(*ids, "_run", "_last", "ts", "value", "_from", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("_end"))
    overlap = F.least("ts", "_end") - F.greatest("_from", F.col("_end") - step)
    done = cells.where("_end <= _last").groupBy(*ids, "_run", F.col("_end").alias("ts")).agg(F.sum(F.col("value") * overlap / step).alias("value")).drop("_run")
    begun = spans.where(F.col("_fresh") & (F.col("ts") > F.col("_floor"))).select(*ids, F.col("_floor").alias("ts"), (F.col("value") * (F.lit(step) - (F.col("ts") - F.col("_floor"))) / step).alias("value"))
    return done.unionByName(begun)


def rolling(df: DataFrame, ids: list[str], step: int, how: str) -> DataFrame:
    """Samples snapped up to the end of their step and merged by sum or max."""
    return df.groupBy(*ids, step_end(F.col("ts"), step).alias("ts")).agg({"sum": F.sum, "max": F.max}[how]("value").alias("value"))


def last_write(df: DataFrame, ids: list[str], step: int, arrival: str = "arrival") -> DataFrame:
    """One value for each step: the one that arrived last."""
    return df.groupBy(*ids, step_end(F.col("ts"), step).alias("ts")).agg(F.max_by("value", arrival).alias("value"))


def normalize(df: DataFrame, step: int, dstype_key: str = "dstype", kinds: tuple[str, ...] = ("counter", "rate", "gauge", "sum")) -> DataFrame:
    """Route samples with a tags map by their type: counter, rate, gauge, sum; without one they are rates."""
    src = df.withColumn("_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags"))))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    kind = F.coalesce(F.col("tags")[dstype_key], F.lit("rate"))
    ids, beat = ["_id"], heartbeat_of(step)
    pick = lambda k: src.where(kind == k if k != "rate" else ~kind.isin("counter", "gauge", "sum")).select("_id", "ts", "value")
    parts = {
        "counter": lambda d: regrid(counter_to_rate(d, ids), ids, step, beat),
        "rate": lambda d: regrid(d, ids, step, step),
        "gauge": lambda d: rolling(d, ids, step, "max"),
        "sum": lambda d: rolling(d, ids, step, "sum"),
    }
    out = reduce(DataFrame.unionByName, [parts[k](pick(k)) for k in kinds])
    return out.select(F.from_json("_id", "map<string,string>").alias("tags"), "ts", "value")


def rollup(df: DataFrame, keep: list[str]) -> DataFrame:
    """Pre-aggregated points over the tags in `keep`: sum, count, min and max of each timestamp."""
    kept = F.map_filter("tags", lambda k, v: k.isin(*keep))
    return df.groupBy(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))).alias("_id"), "ts").agg(F.sum("value").alias("sum"), F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max")).select(F.from_json("_id", "map<string,string>").alias("tags"), "ts", "sum", "count", "min", "max")
