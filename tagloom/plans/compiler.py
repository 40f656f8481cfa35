"""Compiles expressions into DataFrames.

Leaf queries that share predicate, grouping and offset become one scan with one
aggregation that computes all their values side by side; math between them is then a
Column expression without a join. Frames stay sparse (rows only where there is data)
until an operator needs every grid point. Whole-window and rolling operators are
window functions over the group's rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import dates
from tagloom.functions.buckets import percentile_columns
from tagloom.lang import words
from tagloom.operators import columns, smoothing
from tagloom.plans import nodes as n
from tagloom.sources.series import Source

#: Grid points of a single ungrouped line up to which a join may broadcast it.
BROADCAST_POINTS = 200_000
OTHERS = "--others--"
_fresh = itertools.count()


@dataclass(frozen=True)
class EvalContext:
    """Grid of an evaluation: points start, start + step, ... below end, in ms."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.start % self.step or self.end % self.step:
            raise ValueError("start and end must be multiples of the step")
        if self.end <= self.start:
            raise ValueError("the range is empty")

    @classmethod
    def aligned(cls, start: int, end: int, step: int) -> EvalContext:
        return cls(dates.round_up(start, step), dates.round_up(end, step), step)

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step


class LimitError(ValueError):
    """A query that reads more than it may."""


@dataclass(frozen=True)
class Limits:
    """Most lines and datapoints that one leaf query may read; None is no limit."""

    lines: int | None = None
    datapoints: int | None = None

    def check(self, rows: DataFrame, series: Column) -> None:
        """Counts no further than one over each limit."""
        if self.datapoints is not None and rows.limit(self.datapoints + 1).count() > self.datapoints:
            raise LimitError(f"too many datapoints: over {self.datapoints}")
        if self.lines is not None and rows.select(series).distinct().limit(self.lines + 1).count() > self.lines:
            raise LimitError(f"too many lines: over {self.lines}")


@dataclass(frozen=True)
class Frame:
    """Lines: df has ts, group columns (tag -> column) and what `value` refers to; fixed tags are the same in all lines.

    df is None for lines that exist without data (constants); value then refers to ts only.
    tagmap names a column with all tags as JSON if lines carry tags of their own.
    """

    df: DataFrame | None
    value: Column
    groups: tuple[tuple[str, str], ...] = ()
    fixed: tuple[tuple[str, str], ...] = ()
    dense: bool = False
    tagmap: str | None = None

    @property
    def ids(self) -> list[str]:
        return ([self.tagmap] if self.tagmap else []) + [c for _, c in self.groups]


def new_column(prefix: str = "v") -> str:
    return f"_{prefix}{next(_fresh)}"


class Compiler:
    def __init__(self, spark: SparkSession, source: Source, ctx: EvalContext, limits: Limits | None = None):
        if ctx.step % source.step and source.step % ctx.step:
            raise ValueError(f"step {ctx.step} is no multiple and no part of the primary step {source.step}")
        self.spark, self.source, self.ctx, self.limits = spark, source, ctx, limits
        self.scans: dict[tuple, tuple[DataFrame, dict[n.Aggregate, str], tuple[tuple[str, str], ...], str | None]] = {}
        self.known: dict[n.Node, Frame] = {}

    # --- scans ---

    def prepare(self, exprs: list[n.Node]) -> None:
        """Plan one scan for all leaves with the same predicate, grouping and offset."""
        by: dict[tuple, dict[n.Aggregate, None]] = {}
        for e in exprs:
            for d in n.data_exprs(e):
                a = d.aggregate if isinstance(d, n.GroupBy) else d
                keys = d.keys if isinstance(d, n.GroupBy) else ()
                by.setdefault((a.query, keys, a.offset, a.fn == "all"), {})[a] = None
        for key, aggregates in by.items():
            if key not in self.scans:
                self.scans[key] = self._scan(*key, list(aggregates))

    def _scan(self, query: n.Query, keys: tuple[str, ...], offset: int, every: bool, aggregates: list[n.Aggregate]):
        s, ctx = self.source, self.ctx
        shift = offset // ctx.step * ctx.step
        step = max(ctx.step, s.step)
        low, high = ctx.start - ctx.step - shift, ctx.end - ctx.step - shift
        if step > ctx.step:  # whole primary intervals
            low, high = low // step * step, dates.round_up(high, step)
        rows = s.df.where(s.in_range(low, high)).where(columns.matches(query, s.key))
        if self.limits:
            self.limits.check(rows, s.series())
        found = {k: s.key(k) for k in keys}
        if any(c is None for c in found.values()):
            rows = rows.where(F.lit(False))
        groups = tuple((k, f"_g{i}") for i, k in enumerate(keys))
        picked = [(found[k] if found[k] is not None else F.lit(None)).cast("string").alias(c) for k, c in groups]
        tagmap = "_tags" if every else None
        if every:
            picked.append(s.series().alias("_tags"))
        multiple = step // s.step
        gauge = s.key(s.dstype_key)
        two_level = any(a.fn == "count" and not s.unique or multiple > 1 and _needs_series(a) for a in aggregates)
        counted = multiple > 1 and any(a.fn == "count" for a in aggregates)
        primary = F.ceil(s.ts / s.step) * s.step if s.snap else s.ts
        rows = rows.select(*picked, (F.ceil(s.ts / step) * step + shift).cast("long").alias("ts"), s.value.alias("_v"), *([primary.cast("long").alias("_p")] if multiple > 1 and (gauge is not None or counted) else []), *([F.coalesce(gauge == "gauge", F.lit(False)).alias("_gauge")] if multiple > 1 and gauge is not None else []), *([s.series().alias("_series")] if two_level else []))
        for _, c in groups:  # lines without a grouping tag are left out
            rows = rows.where(F.col(c).isNotNull())
        ids = [*(["_tags"] if every else []), *(c for _, c in groups), "ts"]
        gauged = multiple > 1 and gauge is not None
        out: dict[n.Aggregate, Column] = {}
        if two_level:
            per = rows.groupBy(*ids, "_series").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *([F.count_distinct(F.when(F.col("_v").isNotNull(), F.col("_p"))).alias("_n")] if counted else []), *([F.max("_gauge").alias("_gauge")] if gauged else []))
            for a in aggregates:
                divisor = F.when(F.col("_gauge"), F.nullif(F.col("_n" if counted else "_c"), F.lit(0))).otherwise(F.lit(multiple)) if gauged else F.lit(multiple)
                if a.fn == "count":
                    # a line counts once in each primary interval in which it has a value
                    has = F.when(F.col("_c") > 0, 1.0)
                    n_primary = F.nullif(F.col("_n"), F.lit(0)).cast("double") if counted else has
                    cell = {"avg": n_primary / (divisor if multiple > 1 else F.lit(1.0)), "sum": n_primary, "min": has, "max": has}[a.consolidation]
                else:
                    cell = {"avg": F.col("_s") / divisor if multiple > 1 else F.col("_s"), "sum": F.col("_s"), "min": F.col("_lo"), "max": F.col("_hi")}[a.consolidation if multiple > 1 else {"min": "min", "max": "max"}.get(a.fn, "sum")]
                out[a] = {"sum": F.sum, "count": F.sum, "all": F.sum, "min": F.min, "max": F.max}[a.fn](cell)
            agg = per
        else:
            agg = rows
            for a in aggregates:
                out[a] = self._direct(a, multiple, gauged)
        names = {a: new_column() for a in aggregates}
        df = agg.groupBy(*ids).agg(*[c.alias(names[a]) for a, c in out.items()])
        if step > ctx.step:  # a finer step repeats the value of the interval that it lies in
            fine = F.explode(F.sequence(F.col("ts") - (step - ctx.step), F.col("ts"), F.lit(ctx.step))).alias("ts")
            df = df.select(*[c for c in df.columns if c != "ts"], fine).where(F.col("ts").between(ctx.start, ctx.end - ctx.step))
        return df, names, groups, tagmap

    def _direct(self, a: n.Aggregate, multiple: int, gauged: bool) -> Column:
        if a.fn in ("min", "max"):
            return {"min": F.min, "max": F.max}[a.fn]("_v")
        total = F.nullif(F.count("_v"), F.lit(0)).cast("double") if a.fn == "count" else F.sum("_v")
        if multiple == 1 or a.consolidation == "sum":
            return total
        if a.fn == "all" and a.consolidation in ("min", "max"):
            return {"min": F.min, "max": F.max}[a.consolidation]("_v")
        if gauged:
            # a gauge is averaged over the primary intervals in which the group has any value
            return total / F.when(F.min("_gauge"), F.count_distinct(F.when(F.col("_v").isNotNull(), F.col("_p")))).otherwise(F.lit(multiple))
        return total / multiple

    def _data(self, d: n.DataExpr) -> Frame:
        a = d.aggregate if isinstance(d, n.GroupBy) else d
        keys = d.keys if isinstance(d, n.GroupBy) else ()
        key = (a.query, keys, a.offset, a.fn == "all")
        if key not in self.scans or a not in self.scans[key][1]:
            self.scans[key] = self._scan(*key, [a])
        df, names, groups, tagmap = self.scans[key]
        exact = n.exact_keys(a.query)
        fixed = tuple((k, v) for k, v in exact.items() if k not in keys) if exact or keys else (("name", "unknown"),)
        return Frame(df, F.col(names[a]), groups, () if tagmap else fixed, False, tagmap)

    # --- shapes ---

    def grid(self) -> DataFrame:
        c = self.ctx
        return self.spark.range(1).select(F.explode(F.sequence(F.lit(c.start), F.lit(c.end - c.step), F.lit(c.step))).alias("ts"))

    def with_df(self, f: Frame) -> Frame:
        """A frame without data as one on the grid."""
        return f if f.df is not None else replace(f, df=self.grid(), dense=True)

    def dense(self, f: Frame) -> Frame:
        """The frame with a row for every grid point of each line; an ungrouped line exists even without data."""
        f = self.with_df(f)
        if f.dense:
            return f
        points = F.explode(F.sequence(F.lit(self.ctx.start), F.lit(self.ctx.end - self.ctx.step), F.lit(self.ctx.step))).alias("ts")
        if f.ids:
            grid = f.df.select(*f.ids).distinct().select(*f.ids, points)
        else:
            grid = self.grid()
        return replace(f, df=grid.join(f.df, [*f.ids, "ts"], "left"), dense=True)

    def settled(self, f: Frame, dense: bool = True) -> tuple[Frame, str]:
        """The frame with its value in a column of its own."""
        f = self.dense(f) if dense else self.with_df(f)
        c = new_column()
        return replace(f, df=f.df.select(*f.ids, "ts", f.value.alias(c)), value=F.col(c)), c

    # --- expressions ---

    def frame(self, e: n.Node) -> Frame:
        found = self.known.get(e)
        if found is None:
            found = self.known[e] = self._frame(e)
        return found

    def _frame(self, e: n.Node) -> Frame:
        if isinstance(e, (n.Aggregate, n.GroupBy)):
            return self._data(e)
        if isinstance(e, n.Named):
            return self.frame(e.expr)
        if isinstance(e, n.Constant):
            return Frame(None, columns.constant(e.value), (), (("name", n.number(e.value)),), True)
        if isinstance(e, n.Generated):
            return Frame(None, self._generated(e), (), (("name", e.kind),), True)
        if isinstance(e, n.Unary):
            f = self.frame(e.expr)
            return replace(f, value=columns.unary(e.op, f.value, self.ctx.step))
        if isinstance(e, n.Clamp):
            f = self.frame(e.expr)
            return replace(f, value=columns.clamp(e.op, f.value, e.bound))
        if isinstance(e, n.Rename):
            f = self.frame(e.expr)
            new = lambda k: e.new if k == e.old else k
            renamed = replace(f, groups=tuple((new(k), c) for k, c in f.groups), fixed=tuple((new(k), v) for k, v in f.fixed))
            return self._renamed_tags(renamed, e) if f.tagmap else renamed
        if isinstance(e, n.Binary):
            return self._binary(e.op, self.frame(e.left), self.frame(e.right))
        if isinstance(e, n.Over):
            return self._over(e)
        if isinstance(e, n.Stateful):
            return self._stateful(e)
        if isinstance(e, n.Consolidate):
            return self._consolidate(e)
        if isinstance(e, n.Stat):
            return self._stat(e)
        if isinstance(e, n.StatOf):
            return Frame(self.grid().where(F.lit(False)), F.lit(None).cast("double"), (), (("name", f"stat-{e.stat}"),), True)
        if isinstance(e, n.Filter):
            return self._filter(e)
        if isinstance(e, n.Ranked):
            return self._ranked(e)
        if isinstance(e, n.Percentiles):
            return self._percentiles(e)
        if isinstance(e, n.Distinct):
            return self._distinct(e)
        raise ValueError(f"can't evaluate {e}")

    def _renamed_tags(self, f: Frame, e: n.Rename) -> Frame:
        tags = F.from_json(f.tagmap, "map<string,string>")
        moved = F.when(tags[e.old].isNotNull(), F.map_concat(F.map_filter(tags, lambda k, v: (k != e.old) & (k != e.new)), F.create_map(F.lit(e.new), tags[e.old]))).otherwise(tags)
        return replace(f, df=f.df.withColumn(f.tagmap, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(moved))))))

    def _generated(self, e: n.Generated) -> Column:
        ts = F.col("ts")
        if e.kind == "random":
            return columns.pseudo_random(ts)
        if e.kind == "srandom":
            return columns.pseudo_random(ts, e.args[0])
        if e.kind == "time":
            return columns.time_part(e.args[0], ts)
        refs = {"gs": self.ctx.start, "ge": self.ctx.end}
        start, end = e.args
        s = dates.timestamp(start, refs=refs) if not start.startswith("e-") else None
        t = dates.timestamp(end, refs=refs | ({"s": s} if s is not None else {}))
        s = s if s is not None else dates.timestamp(start, refs=refs | {"e": t})
        return F.when(ts.between(s, t), 1.0).otherwise(0.0)

    def _binary(self, op: str, left: Frame, right: Frame) -> Frame:
        fn = columns.BINARY[op]
        lone = [f for f in (left, right) if f.df is None]
        if len(lone) == 2:
            return replace(left, value=fn(left.value, right.value))
        if lone or left.df is right.df:
            main = right if left.df is None else left
            if op not in columns.STRICT and not (op in columns.LENIENT and not lone):
                # missing data gives values here: both columns come from the same rows, so one fill serves both
                main = self.dense(main)
            return replace(main, value=fn(left.value, right.value), dense=main.dense)
        if op not in columns.STRICT:
            left, right = self.dense(left), self.dense(right)
        a, b = dict(left.groups), dict(right.groups)
        if left.tagmap or right.tagmap:
            if left.ids and right.ids and not (left.tagmap and right.tagmap):
                raise ValueError("both sides must be grouped alike")
            shared: list[tuple[str, str]] = [(left.tagmap, right.tagmap)] if left.tagmap and right.tagmap else []
        else:
            shared = [(a[k], b[k]) for k in a if k in b]
        wide, narrow = (left, right) if len(left.ids) >= len(right.ids) else (right, left)
        pairs = shared if wide is left else [(y, x) for x, y in shared]
        v, w = new_column(), new_column("w")
        small = narrow.df.select(F.col("ts").alias(f"{w}_ts"), *[F.col(y).alias(f"{w}_{i}") for i, (_, y) in enumerate(pairs)], narrow.value.alias(w))
        if not narrow.ids and self.ctx.points <= BROADCAST_POINTS:
            small = F.broadcast(small)  # one line: at most a row for each grid point
        on = F.col("ts") == F.col(f"{w}_ts")
        for i, (x, _) in enumerate(pairs):
            on = on & (F.col(x) == F.col(f"{w}_{i}"))
        df = wide.df.select(*wide.ids, "ts", wide.value.alias(v)).join(small, on).select(*wide.ids, "ts", v, w)
        value = fn(F.col(v), F.col(w)) if wide is left else fn(F.col(w), F.col(v))
        return replace(wide, df=df, value=value, dense=left.dense and right.dense)

    def _over(self, e: n.Over) -> Frame:
        f = self.with_df(self.frame(e.expr))
        c = new_column()
        agg = {"sum": F.sum, "min": F.min, "max": F.max}.get(e.fn)
        value = agg(f.value) if agg else F.nullif(F.count(f.value), F.lit(0)).cast("double")
        groups = tuple((k, col) for k, col in f.groups if k in (e.keys or ()))
        if f.tagmap and e.keys:
            tags = F.from_json(f.tagmap, "map<string,string>")
            groups = tuple((k, f"_g{i}") for i, k in enumerate(e.keys))
            src = f.df.select("ts", f.value.alias("_x"), *[tags[k].alias(col) for k, col in groups])
            for _, col in groups:
                src = src.where(F.col(col).isNotNull())
            value = agg(F.col("_x")) if agg else F.nullif(F.count("_x"), F.lit(0)).cast("double")
        else:
            src = f.df
        df = src.groupBy(*[col for _, col in groups], "ts").agg(value.alias(c))
        fixed = f.fixed or (tuple(n.exact_keys(_first_query(e)).items()) or (("name", "unknown"),))
        return Frame(df, F.col(c), groups, fixed, f.dense)

    def _stateful(self, e: n.Stateful) -> Frame:
        f, c = self.settled(self.frame(e.expr))
        w = Window.partitionBy(*f.ids).orderBy("ts") if f.ids else Window.orderBy("ts")
        v, op, args = F.col(c), e.op, e.args
        if op in ("des", "sdes"):
            return replace(f, df=smoothing.smooth(f.df, f.ids, c, op, args, self.ctx.start, self.ctx.step), value=F.col("_smoothed"))
        last = lambda k: w.rowsBetween(-(k - 1), 0)
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        if op == "rolling-count":
            out = F.sum(columns.truth(v).cast("double")).over(last(args[0]))
        elif op in ("rolling-min", "rolling-max", "rolling-sum"):
            out = {"rolling-min": F.min, "rolling-max": F.max, "rolling-sum": F.sum}[op](v).over(last(args[0]))
        elif op == "rolling-mean":
            out = F.when(F.count(v).over(last(args[0])) >= args[1], F.avg(v).over(last(args[0])))
        elif op == "delay":
            out = F.lag(v, args[0]).over(w)
        elif op == "derivative":
            out = columns.known(v - F.lag(v, 1).over(w))
        elif op == "integral":
            out = F.sum(v).over(running)
        elif op == "cumulative-max":
            out = F.max(v).over(running)
        elif op == "trend":
            k = dates.duration(args[0]) // self.ctx.step
            out = v if k <= 1 else F.when((F.row_number().over(w) >= k) & (F.count(v).over(last(k)) > 0), F.sum(v).over(last(k)) / k)
        else:
            raise ValueError(op)
        r = new_column()
        return replace(f, df=f.df.withColumn(r, out), value=F.col(r))

    def _consolidate(self, e: n.Consolidate) -> Frame:
        step = dates.round_up(e.step, self.ctx.step)
        f, c = self.settled(self.frame(e.expr))
        multiple = step // self.ctx.step
        w = Window.partitionBy(*f.ids, F.ceil(F.col("ts") / step))
        out = {"avg": F.sum(c).over(w) / multiple, "sum": F.sum(c).over(w), "min": F.min(c).over(w), "max": F.max(c).over(w)}[e.cf]
        r = new_column()
        return replace(f, df=f.df.withColumn(r, out), value=F.col(r))

    def _stat(self, e: n.Stat) -> Frame:
        # missing points count in no statistic, so the lines' rows are enough; each grid point repeats the result
        f, c = self.settled(self.frame(e.expr), dense=False)
        r = new_column()
        points = F.explode(F.sequence(F.lit(self.ctx.start), F.lit(self.ctx.end - self.ctx.step), F.lit(self.ctx.step))).alias("ts")
        stats = f.df.groupBy(*f.ids).agg(columns.STATISTICS[e.stat](c).cast("double").alias(r))
        return replace(f, df=stats.select(*f.ids, r, points), value=F.col(r), dense=True)

    def _filter(self, e: n.Filter) -> Frame:
        f, by = self.frame(e.expr), self.frame(e.by)
        if f.df is None:
            f = self.with_df(f)
        by = self.with_df(by)
        hit = by.df.where(columns.truth(by.value))
        if f.tagmap and by.tagmap:
            pairs = [(f.tagmap, by.tagmap)]
        else:
            own = dict(f.groups)
            pairs = [(own[k], c) for k, c in by.groups if k in own]
        if by.ids and not pairs:
            raise ValueError("both sides must be grouped alike")
        if not pairs:
            return replace(f, df=f.df.join(F.broadcast(hit.select(F.lit(1).alias("_hit")).limit(1)), F.lit(True), "left_semi"))
        keys = hit.select(*[F.col(c).alias(f"_hit{i}") for i, (_, c) in enumerate(pairs)]).distinct()
        on = F.lit(True)
        for i, (c, _) in enumerate(pairs):
            on = on & (F.col(c) == F.col(f"_hit{i}"))
        return replace(f, df=f.df.join(keys, on, "left_semi"))

    def _ranked(self, e: n.Ranked) -> Frame:
        f = self.with_df(self.frame(e.expr))
        if not f.ids:
            return f
        c = new_column()
        f = replace(f, df=f.df.select(*f.ids, "ts", f.value.alias(c)), value=F.col(c))
        stats = f.df.groupBy(*f.ids).agg(columns.STATISTICS[e.stat](c).alias("_stat"))
        # missing statistics rank as the largest; ties keep the earlier line
        order = F.col("_stat").desc_nulls_first() if e.op.startswith("topk") else F.col("_stat").asc_nulls_last()
        kept = stats.orderBy(order, *f.ids).limit(e.k).select(*f.ids)
        inside = f.df.join(F.broadcast(kept), f.ids, "left_semi")  # at most k rows
        how = e.op.partition("-others-")[2]
        if not how:
            return replace(f, df=inside)
        agg = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[how](c)
        rest = f.df.join(F.broadcast(kept), f.ids, "left_anti").groupBy("ts").agg(agg.alias(c))
        tagged = F.lit('{"name":"%s"}' % OTHERS) if f.tagmap else F.lit(OTHERS)
        return replace(f, df=inside.unionByName(rest.select(*[tagged.alias(x) for x in f.ids], "ts", c)), dense=False)

    def _percentiles(self, e: n.Percentiles) -> Frame:
        f = self.frame(e.data)
        tag = dict(f.groups)["percentile"]
        groups = tuple((k, c) for k, c in f.groups if k != "percentile")
        number = F.conv(F.substring(tag, 2, 4), 16, 10).cast("int")
        ok = F.col(tag).rlike("^[DT][0-9A-F]{4}$")
        count = F.when(F.abs(f.value) != float("inf"), f.value * self.ctx.step / 1000.0).otherwise(F.lit(0.0))
        cells = f.df.where(ok).select(*[c for _, c in groups], "ts", F.struct(number.alias("bucket"), count.alias("count")).alias("_cell"), F.col(tag).startswith("T").alias("_timer")).where(F.col("_cell.count").isNotNull())
        # at most one cell for each bucket of the scheme
        sorted_cells = cells.groupBy(*[c for _, c in groups], "ts").agg(F.array_sort(F.collect_list("_cell")).alias("_cells"), F.max("_timer").alias("_timer"))
        found = percentile_columns(F.col("_cells"), e.pcts)
        values = F.zip_with(F.array(*[F.lit(n.number(p)) for p in e.pcts]), found, lambda p, v: F.struct(p.alias("_pct"), v.alias("_pv")))
        each = sorted_cells.select(*[c for _, c in groups], "ts", "_timer", F.explode(values).alias("_e"))
        df = each.withColumn("_e", F.struct(F.col("_e._pct").alias("_pct"), F.when(F.col("_timer"), F.col("_e._pv") * 1e-9).otherwise(F.col("_e._pv")).alias("_pv")))
        df = df.select(*[c for _, c in groups], "ts", "_e").select(*[c for _, c in groups], "ts", F.lpad(F.col("_e._pct"), max(len(n.number(p)) for p in e.pcts), " ").alias("_pct"), F.col("_e._pv").alias("_pv"))
        return Frame(df, F.col("_pv"), (*groups, ("percentile", "_pct")), f.fixed)

    def _distinct(self, e: n.Distinct) -> Frame:
        """HyperLogLog over M registers: their maxima give the estimate, with linear counting where registers are unset."""
        m, alpha = 64, 0.709
        f = self.frame(e.data)
        if e.cumulative:
            f = self._stateful_frame("cumulative-max", f)
        tag = dict(f.groups)["distinct"]
        groups = tuple((k, c) for k, c in f.groups if k != "distinct")
        ok = F.col(tag).rlike("^R[0-9A-F]{2}$") & f.value.isNotNull()
        registers = f.df.where(ok).groupBy(*[c for _, c in groups], tag, "ts").agg(F.max(f.value).alias("_rho"))
        sums = registers.groupBy(*[c for _, c in groups], "ts").agg(F.sum(F.pow(F.lit(2.0), -F.col("_rho"))).alias("_z"), F.count(F.when(F.col("_rho") > 0, 1)).alias("_set"), F.count("*").alias("_seen"))
        zero = F.lit(m) - F.col("_set")
        raw = F.lit(alpha * m * m) / (F.col("_z") + (F.lit(m) - F.col("_seen")))
        estimate = F.when(F.col("_set") == 0, F.lit(None)).when((raw <= 2.5 * m) & (zero > 0), m * F.log(F.lit(float(m)) / zero)).otherwise(raw)
        c = new_column()
        return Frame(sums.select(*[x for _, x in groups], "ts", estimate.alias(c)), F.col(c), groups, f.fixed, False)

    def _stateful_frame(self, op: str, f: Frame) -> Frame:
        f, c = self.settled(f)
        w = Window.partitionBy(*f.ids).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        r = new_column()
        return replace(f, df=f.df.withColumn(r, F.max(c).over(w)), value=F.col(r))


def _needs_series(a: n.Aggregate) -> bool:
    if a.fn == "all":
        return False
    return a.consolidation not in ("sum", "avg") if a.fn in ("sum", "count") else a.consolidation != a.fn


def _first_query(e: n.Node) -> n.Query:
    for d in n.data_exprs(e):
        return (d.aggregate if isinstance(d, n.GroupBy) else d).query
    return n.Always(True)


def tags_column(f: Frame) -> Column:
    if f.tagmap:
        return F.from_json(f.tagmap, "map<string,string>")
    cells = [(k, F.lit(v)) for k, v in f.fixed if k not in dict(f.groups)] + [(k, F.col(c)) for k, c in f.groups]
    return F.create_map(*[x for k, c in sorted(cells, key=lambda x: x[0]) for x in (F.lit(k), c)]) if cells else F.expr("map()").cast("map<string,string>")


def evaluate(spark: SparkSession, source: Source, program: str | list[n.Style], start: int, end: int, step: int | None = None, dense: bool = False, interpreter=None, limits: Limits | None = None) -> DataFrame:
    """Lines of a program: expr (its place), label, tags, ts, value.

    Rows without a value are left out unless `dense`. step is by default the source's.
    Presentation words that choose lines (:sort, :order, :limit) are applied. A query that
    reads more than `limits` raises LimitError.
    """
    from tagloom.operators import presentation

    styles = words.parse(program, interpreter) if isinstance(program, str) else program
    if not styles:
        raise ValueError("the program leaves no expression")
    step = step or source.step
    ctx = EvalContext.aligned(start, end, step)
    compiler = Compiler(spark, source, ctx, limits)
    compiler.prepare([s.expr for s in styles])
    out = None
    for k, s in enumerate(styles):
        f = compiler.frame(s.expr)
        f = compiler.dense(f) if dense or f.df is None else f
        df = f.df.select(F.lit(k).alias("expr"), presentation.label(s, f).alias("label"), tags_column(f).alias("tags"), F.col("ts"), f.value.cast("double").alias("value"))
        df = presentation.chosen(s, df)
        if not dense:
            df = df.where(F.col("value").isNotNull())
        out = df if out is None else out.unionByName(df)
    return out


def lines(spark: SparkSession, source: Source, program: str, start: int, end: int, step: int | None = None, dense: bool = False) -> DataFrame:
    """One expression's lines as flat columns: each grouping tag, ts, value."""
    style = words.parse(program)[-1]
    step = step or source.step
    compiler = Compiler(spark, source, EvalContext.aligned(start, end, step))
    compiler.prepare([style.expr])
    f = compiler.frame(style.expr)
    f = compiler.dense(f) if dense or f.df is None else f
    df = f.df.select(*[F.col(c).alias(k) for k, c in f.groups], "ts", f.value.cast("double").alias("value"))
    return df if dense else df.where(F.col("value").isNotNull())
