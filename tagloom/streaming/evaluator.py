"""Streaming: events to datapoints, time grouping with watermarks, and over-time state.

The functions take and give streaming DataFrames and work on static ones as well, where
they are what the tests compare with.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.lang.services import streaming_problems
from tagloom.lang.words import parse, parse_event
from tagloom.operators.columns import matches
from tagloom.plans import nodes as n
from tagloom.sources.series import millis, utc_millis
from tagloom.streaming.online import online

#: Rows of one line that are held before they are given out.
_PIECE = 10_000


def _key(df: DataFrame, tag_map: str | None) -> Callable[[str], Column | None]:
    names = set(df.columns)

    def key(k: str) -> Column | None:
        if k in names:
            return F.col(f"`{k}`").cast("string")
        return F.col(tag_map)[k] if tag_map else None

    return key


def event_query(events: DataFrame, program: str, ts: str = "ts", step: int = 5_000, tag_map: str | None = None) -> DataFrame:
    """An event expression: matching events whole (raw), some columns (table), or a count and a sample for each step and group (sample)."""
    e = parse_event(program)
    hit = events.where(matches(e.query, _key(events, tag_map)))
    if e.kind == "raw":
        return hit
    if e.kind == "table":
        return hit.select(*[F.col(f"`{c}`") for c in e.columns])
    end = (F.ceil(millis(events, ts) / step) * step).cast("long").alias("step_end")
    return hit.groupBy(end, *[F.col(f"`{c}`") for c in e.by]).agg(F.count("*").alias("count"), F.first(F.struct(*[F.col(f"`{c}`") for c in e.columns]), ignorenulls=True).alias("sample"))


def typed_filter(events: DataFrame, column: str, op: str, value: Any) -> DataFrame:
    """Events by a comparison in the field's own type; a field of another type never matches."""
    kind = dict(events.dtypes)[column]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    fits = isinstance(value, bool) == (kind == "boolean") and (isinstance(value, str) == (kind == "string")) and (not isinstance(value, (int, float)) or isinstance(value, bool) or numeric)
    if not fits:
        return events.where(F.lit(False))
    c, v = F.col(column), F.lit(value)
    return events.where({"eq": c == v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op])


def partial_aggregates(events: DataFrame, programs: dict[str, str], step: int, ts: str = "ts", value: str = "value", tag_map: str | None = None, delay_ms: int | None = None) -> DataFrame:
    """Datapoints of every leaf query of the programs, from events, in one pass: expr, query, keys, ts, value, samples.

    :sum is a rate per second over finite values of at least 0; :count a rate of events;
    :min and :max are over the values. With delay_ms the result is emitted when the
    watermark has passed a step, and events that come later are dropped.
    """
    key = _key(events, tag_map)
    leaves: dict[str, n.DataExpr] = {}
    for program in programs.values():
        for s in parse(program):
            leaves |= {str(d): d for d in n.data_exprs(s.expr)}
    wants = []
    for name, d in leaves.items():
        a = d.aggregate if isinstance(d, n.GroupBy) else d
        keys = d.keys if isinstance(d, n.GroupBy) else ()
        hit = F.coalesce(matches(a.query, key), F.lit(False))
        columns = [key(k) for k in keys]
        for c in columns:
            hit = hit & (c.isNotNull() if c is not None else F.lit(False))
        tags = F.to_json(F.create_map(*[x for k, c in zip(keys, columns, strict=True) for x in (F.lit(k), c)])) if keys and all(c is not None for c in columns) else F.lit("{}")
        wants.append(F.when(hit, F.struct(F.lit(name).alias("query"), F.lit(a.fn).alias("fn"), tags.alias("keys"))))
    # each event goes to the leaves that it matches, so the stream is read and shuffled once
    each = events.withColumn("_to", F.explode(F.array_compact(F.array(*wants))))
    v = F.col(value).cast("double")
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    end = F.window(F.col(ts), f"{step} milliseconds")
    if delay_ms is not None:
        each = each.withWatermark(ts, f"{delay_ms} milliseconds")
    grouped = each.groupBy(end.alias("_w"), F.col("_to.query").alias("query"), F.col("_to.fn").alias("fn"), F.col("_to.keys").alias("keys")).agg(
        F.sum(F.when(ok & (v >= 0), v)).alias("_sum"), F.count(F.when(ok, v)).alias("samples"), F.min(F.when(ok, v)).alias("_min"), F.max(F.when(ok, v)).alias("_max")
    )
    per = F.lit(step / 1000.0)
    out = F.when(F.col("fn").isin("sum", "all"), F.col("_sum") / per).when(F.col("fn") == "count", F.nullif(F.col("samples"), F.lit(0)) / per).when(F.col("fn") == "min", F.col("_min")).otherwise(F.col("_max"))
    return grouped.select("query", "keys", utc_millis(F.col("_w.end"), dict(events.dtypes)[ts]).alias("ts"), out.alias("value"), "samples")


def time_grouped(points: DataFrame, step: int, how: str = "sum", ids: tuple[str, ...] = ("keys",), replica: str | None = None, num_buffers: int = 1, max_input: int | None = None, now: Column | None = None) -> DataFrame:
    """Partial aggregates of one timestamp merged into one value for each group: ids, ts, value, samples.

    points have `time` (timestamp) and value. With `replica`, the maximum of each replica
    key is summed, so that copies of the same datapoint count once. The watermark keeps
    num_buffers steps open; what comes later is dropped, as is what lies after `now`.
    Groups with over max_input rows are dropped whole.
    """
    rows = points.where(F.col("time") <= now) if now is not None else points
    if rows.isStreaming:
        rows = rows.withWatermark("time", f"{num_buffers * step} milliseconds")
    w = F.window("time", f"{step} milliseconds")
    if replica:
        if rows.isStreaming:
            raise ValueError("merge replicas in foreachBatch: a stream aggregates once")
        each = rows.groupBy(w.alias("_w"), *ids, replica).agg(F.max("value").alias("value"), F.count("*").alias("samples"))
        grouped = each.groupBy("_w", *ids).agg(F.sum("value").alias("value"), F.sum("samples").alias("samples"))
    else:
        fn = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[how]
        grouped = rows.groupBy(w.alias("_w"), *ids).agg(fn("value").alias("value"), F.count("*").alias("samples"))
    if max_input is not None:
        grouped = grouped.where(F.col("samples") <= max_input)
    return grouped.select(*ids, utc_millis(F.col("_w.start"), dict(points.dtypes)["time"]).alias("ts"), "value", "samples")


def over_time(points: DataFrame, op: str, args: tuple, step: int, ids: tuple[str, ...] = ("keys",), max_gap: int | None = None) -> DataFrame:
    """An over-time operator on a stream of (ids, ts, value): each line's state is carried between batches.

    Steps without data count as missing, however many; with max_gap, a line starts over after more of them.
    Points that are older than what a line has seen are dropped.
    """
    kinds = dict(points.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ids)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        algorithm, last = online(op, args, step), None
        if state.exists:
            saved, last = state.get
            algorithm.restore(saved)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []

        def piece() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["ts", "value"])
            frame = frame[~frame["value"].isna()]
            for c, k in zip(ids, key, strict=True):
                frame[c] = k
            out.clear()
            return frame[[*ids, "ts", "value"]]

        for t, v in zip(rows["ts"], rows["value"], strict=True):
            if last is not None and t <= last:
                continue
            if last is not None:
                gap = (t - last) // step - 1
                if max_gap is not None and gap > max_gap:
                    algorithm = online(op, args, step)
                else:
                    for k in range(int(gap)):
                        out.append((last + (k + 1) * step, algorithm.next(math.nan)))
                        if len(out) >= _PIECE:
                            yield piece()
            out.append((t, algorithm.next(math.nan if v is None else float(v))))
            last = int(t)
        if last is not None:
            state.update((algorithm.state(), last))
        yield piece()

    return points.groupBy(*ids).applyInPandasWithState(advance, f"{fields}, ts long, value double", "saved string, last long", "append", "NoTimeout")


def final_eval(batch: DataFrame, programs: dict[str, str], step: int, start: int, end: int) -> DataFrame:
    """Evaluate programs on the partial aggregates of some timestamps: id, label, tags, ts, value.

    For use in foreachBatch. Leaves are read from the batch by their query text.
    """
    from tagloom.plans.compiler import Compiler, EvalContext, Frame, tags_column
    from tagloom.operators import presentation
    from tagloom.sources.series import datapoints

    spark = batch.sparkSession
    out = []
    for name, program in programs.items():
        problems = streaming_problems(program)
        if problems:
            raise ValueError(f"{name}: {'; '.join(problems)}")
        for s in parse(program):
            c = Compiler(spark, datapoints(spark.createDataFrame([], "tags map<string,string>, ts long, value double"), step), EvalContext(start, end, step))
            for d in n.data_exprs(s.expr):
                keys = d.keys if isinstance(d, n.GroupBy) else ()
                tags = F.from_json("keys", "map<string,string>")
                groups = tuple((k, f"_g{i}") for i, k in enumerate(keys))
                df = batch.where(F.col("query") == str(d)).select(*[tags[k].alias(col) for k, col in groups], "ts", F.col("value").alias("_leaf"))
                a = d.aggregate if isinstance(d, n.GroupBy) else d
                c.known[d] = Frame(df, F.col("_leaf"), groups, tuple((k, v) for k, v in n.exact_keys(a.query).items() if k not in keys))
            f = c.dense(c.frame(s.expr))
            out.append(f.df.select(F.lit(name).alias("id"), presentation.label(s, f).alias("label"), tags_column(f).alias("tags"), "ts", f.value.cast("double").alias("value")))
    return reduce(DataFrame.unionByName, out)
