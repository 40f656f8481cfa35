"""Vocabulary: stack words, predicates, data, math, stateful, filter, style, custom and event words."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from tagloom.functions import dates
from tagloom.lang.interpreter import Context, Interpreter, ProgramError, Word, tokenize, unescape
from tagloom.plans import nodes as n

WORDS: list[Word] = []


# --- types and coercions ---


def is_query(x: Any) -> bool:
    return isinstance(x, n.Query)


def is_number(x: Any) -> bool:
    if isinstance(x, (int, float)):
        return True
    try:
        return isinstance(x, str) and math.isfinite(float(x)) or x in ("NaN", "Infinity", "-Infinity", "+Infinity")
    except ValueError:
        return False


def is_int(x: Any) -> bool:
    return isinstance(x, int) or isinstance(x, str) and bool(re.fullmatch(r"[+-]?\d+", x))


def is_text(x: Any) -> bool:
    return isinstance(x, str)


def is_list(x: Any) -> bool:
    return isinstance(x, list)


def is_ts(x: Any) -> bool:
    return isinstance(x, n.Expr) or is_query(x) or is_number(x) and not isinstance(x, bool)


def is_aggregate(x: Any) -> bool:
    return is_query(x) or isinstance(x, n.Aggregate)


def is_style(x: Any) -> bool:
    return isinstance(x, n.Style) or is_ts(x)


def is_event(x: Any) -> bool:
    return isinstance(x, n.Event) or is_query(x)


def ts(x: Any) -> n.Expr:
    if isinstance(x, n.Expr):
        return x
    return n.Aggregate("sum", x) if is_query(x) else n.Constant(float(x))


def aggregate(x: Any) -> n.Aggregate:
    return n.Aggregate("sum", x) if is_query(x) else x


def style(x: Any) -> n.Style:
    return x if isinstance(x, n.Style) else n.Style(ts(x))


def texts(x: list) -> tuple[str, ...]:
    return tuple(unescape(str(t)) for t in x)


# --- registration ---


def word(name: str, *types: Callable[[Any], bool]):
    """Register an overload: a function from the popped items, lowest first, to what is pushed (None: nothing)."""

    def add(fn: Callable[..., Any]) -> Callable[..., Any]:
        def matches(stack: list) -> bool:
            return len(stack) >= len(types) and all(t(x) for t, x in zip(types, stack[len(stack) - len(types) :], strict=True))

        def run(c: Context) -> None:
            items = c.stack[len(c.stack) - len(types) :] if types else []
            if types:
                del c.stack[len(c.stack) - len(types) :]
            out = fn(*items)
            if out is not None:
                c.push(out)

        WORDS.append(Word(name, matches, run))
        return fn

    return add


def raw(name: str, *types: Callable[[Any], bool]):
    """Register an overload that works on the context."""

    def add(fn: Callable[[Context], None]) -> Callable[[Context], None]:
        WORDS.append(Word(name, lambda s: len(s) >= len(types) and all(t(x) for t, x in zip(types, s[len(s) - len(types) :], strict=True)), fn))
        return fn

    return add


def macro(name: str, body: str, *types: Callable[[Any], bool]) -> None:
    tokens = tokenize(body)
    WORDS.append(Word(name, lambda s: len(s) >= len(types) and all(t(x) for t, x in zip(types, s[len(s) - len(types) :], strict=True)), lambda c: c.call(tokens), body))


def anything(x: Any) -> bool:
    return True


# --- stack words ---


@raw("call", is_list)
def _(c: Context) -> None:
    c.call(c.pop())


@raw("clear")
def _(c: Context) -> None:
    c.stack.clear()


@raw("depth")
def _(c: Context) -> None:
    c.push(str(len(c.stack)))


@raw("drop", anything)
def _(c: Context) -> None:
    c.pop()


@raw("dup", anything)
def _(c: Context) -> None:
    c.push(c.stack[-1])


@raw("each", is_list, is_list)
def _(c: Context) -> None:
    body, items = c.pop(), c.pop()
    for x in items:
        c.push(unescape(x) if isinstance(x, str) else x)
        c.call(body)


@raw("map", is_list, is_list)
def _(c: Context) -> None:
    body, items = c.pop(), c.pop()
    out = []
    for x in items:
        c.push(unescape(x) if isinstance(x, str) else x)
        c.call(body)
        out.append(c.pop())
    c.push(out)


@word("format", is_text, is_list)
def _(pattern: str, args: list) -> str:
    """printf with strings and numbers only."""
    values = iter(args)

    def one(m: re.Match) -> str:
        if m[0] == "%%":
            return "%"
        v = next(values, None)
        if v is None:
            raise ProgramError("too few values to format")
        return m[0] % (v if m[0][-1] == "s" else int(float(v)) if m[0][-1] in "dxX" else float(v))

    return re.sub(r"%%|%[-+ 0#]*\d{0,3}(?:\.\d{1,2})?[sdxXfeEgG]", one, pattern)


@raw("freeze")
def _(c: Context) -> None:
    c.frozen += c.stack
    c.stack.clear()


@raw("get", is_text)
def _(c: Context) -> None:
    name = c.pop()
    if name not in c.variables:
        raise ProgramError(f"key not found: {name}")
    c.push(c.variables[name])


@raw("set", is_text, anything)
def _(c: Context) -> None:
    value, name = c.pop(), c.pop()
    c.variables[name] = value


@raw("sset", anything, is_text)
def _(c: Context) -> None:
    name, value = c.pop(), c.pop()
    c.variables[name] = value


@raw("pick", is_int)
def _(c: Context) -> None:
    k = int(c.pop())
    c.push(c.stack[-1 - k])


@raw("roll", is_int)
def _(c: Context) -> None:
    k = int(c.pop())
    c.push(c.stack.pop(-1 - k))


@raw("ndrop", is_int)
def _(c: Context) -> None:
    k = int(c.pop())
    if k > 0:
        del c.stack[max(0, len(c.stack) - k) :]


@raw("nlist", is_int)
def _(c: Context) -> None:
    k = int(c.pop())
    at = len(c.stack) - min(k, len(c.stack))
    items = c.stack[at:]
    del c.stack[at:]
    c.push(items)


@raw("list")
def _(c: Context) -> None:
    items = c.stack[:]
    c.stack.clear()
    c.push(items)


@raw("over", anything, anything)
def _(c: Context) -> None:
    c.push(c.stack[-2])


@raw("rot", anything)
def _(c: Context) -> None:
    c.push(c.stack.pop(0))


@raw("-rot", anything)
def _(c: Context) -> None:
    c.stack.insert(0, c.pop())


@raw("swap", anything, anything)
def _(c: Context) -> None:
    c.stack[-1], c.stack[-2] = c.stack[-2], c.stack[-1]


macro("2over", ":over,:over")
macro("nip", ":swap,:drop")
macro("tuck", ":swap,:over")


# --- predicates ---

word("true")(lambda: n.Always(True))
word("false")(lambda: n.Always(False))
word("has", is_text)(lambda k: n.Has(k))
for _op in ("eq", "lt", "le", "gt", "ge", "re", "reic", "contains", "starts", "ends"):
    word(_op, is_text, is_text)(lambda k, v, op=_op: n.Compare(op, k, v))
word("in", is_text, is_list)(lambda k, vs: n.Always(False) if not vs else n.Compare("eq", k, texts(vs)[0]) if len(vs) == 1 else n.In(k, texts(vs)))
word("and", is_query, is_query)(n.conj)
word("or", is_query, is_query)(n.disj)
word("not", is_query)(n.neg)


def _with_query(e: n.Node, q: n.Query) -> n.Node:
    return e.rewrite(lambda x: replace(x, query=n.conj(x.query, q)) if isinstance(x, (n.Aggregate, n.Event)) else x)


def common_query(x: Any, q: n.Query) -> Any:
    """x with q required of all its data; what is no expression stays."""
    if is_query(x):
        return n.conj(x, q)
    return _with_query(x, q) if isinstance(x, n.Node) else x


@raw("cq", is_query)
def _(c: Context) -> None:
    q = c.pop()
    c.stack[:] = [common_query(x, q) for x in c.stack]


# --- data ---

for _fn in ("all", "sum", "count", "min", "max"):
    word(_fn, is_query)(lambda q, fn=_fn: n.Aggregate(fn, q))
word("by", is_aggregate, is_list)(lambda a, ks: n.GroupBy(aggregate(a), texts(ks)))


def _with_cf(e: n.Expr, cf: str) -> n.Expr:
    e = e.rewrite(lambda x: x.expr if isinstance(x, n.Named) else x)
    return e.rewrite(lambda x: replace(x, cf=cf) if isinstance(x, n.Aggregate) else x)


for _cf in ("sum", "avg", "min", "max"):
    word(f"cf-{_cf}", is_ts)(lambda e, cf=_cf: _with_cf(ts(e), cf))


@word("offset", is_ts, is_text)
def _(e: Any, d: str) -> n.Expr:
    ms = dates.duration(d)
    return ts(e).rewrite(lambda x: replace(x, offset=ms) if isinstance(x, n.Aggregate) else x)


# --- math ---


def _named(word_name: str, shown: n.Node, body: n.Expr, *args: str) -> n.Named:
    return n.Named(word_name, shown, body, (), args)


def _sum(q: n.Query) -> n.Aggregate:
    return n.Aggregate("sum", q)


def _parts(x: Any, *fns: str) -> list[n.Expr]:
    """An expression's sums, counts, ...: on a predicate or a plain aggregate at the data, else over its series."""
    x = x if is_query(x) else ts(x)
    if is_query(x):
        return [n.Aggregate(f, x) for f in fns]
    if isinstance(x, n.Aggregate):
        return [replace(x, fn=f) for f in fns]
    return [n.Over(f, x) for f in fns]


@word("avg", is_ts)
def _(x: Any) -> n.Named:
    total, count = _parts(x, "sum", "count")
    return _named("avg", x if is_query(x) else ts(x), n.Binary("div", total, count))


@word("stddev", is_ts)
def _(x: Any) -> n.Named:
    """sqrt((N * sum of squares - square of sum) / N^2) over the series."""
    inner = n.Aggregate("all", x) if is_query(x) else n.Aggregate("all", x.query, x.cf, x.offset) if isinstance(x, n.Aggregate) else ts(x)
    total, count, squares = n.Over("sum", inner), n.Over("count", inner), n.Over("sum", n.Binary("mul", inner, inner))
    spread = n.Binary("sub", n.Binary("mul", count, squares), n.Binary("mul", total, total))
    return _named("stddev", x if is_query(x) else ts(x), n.Unary("sqrt", n.Binary("div", spread, n.Binary("mul", count, count))))


@word("pct", is_ts)
def _(x: Any) -> n.Named:
    e = ts(x)
    return _named("pct", e, n.Binary("mul", n.Binary("div", e, n.Over("sum", e)), n.Constant(100.0)))


def _statistic(q: n.Query, *stats: str) -> n.Query:
    return n.conj(q, n.Compare("eq", "statistic", stats[0]) if len(stats) == 1 else n.In("statistic", stats))


@word("dist-avg", is_query)
def _(q: n.Query) -> n.Named:
    return _named("dist-avg", q, n.Binary("div", _sum(_statistic(q, "totalTime", "totalAmount")), _sum(_statistic(q, "count"))))


@word("dist-max", is_query)
def _(q: n.Query) -> n.Named:
    return _named("dist-max", q, n.Aggregate("max", _statistic(q, "max")))


@word("dist-stddev", is_query)
def _(q: n.Query) -> n.Named:
    count, squares, total = _sum(_statistic(q, "count")), _sum(_statistic(q, "totalOfSquares")), _sum(_statistic(q, "totalTime", "totalAmount"))
    spread = n.Binary("sub", n.Binary("mul", count, squares), n.Binary("mul", total, total))
    return _named("dist-stddev", q, n.Unary("sqrt", n.Binary("div", spread, n.Binary("mul", count, count))))


def _regrouped(e: n.Expr, keys: tuple[str, ...]) -> n.Expr:
    """Every data aggregate of an expression grouped by keys, second-level ones following suit."""

    def one(x: n.Node) -> n.Node:
        if isinstance(x, n.Over):
            return replace(x, keys=keys) if not isinstance(x.expr, n.Aggregate) or x.expr.fn == "all" else x
        return x

    def visit(x: n.Node) -> n.Node:
        if isinstance(x, n.Aggregate):
            return x if x.fn == "all" else n.GroupBy(x, keys)
        if isinstance(x, n.GroupBy):
            return x
        if isinstance(x, n.Named):
            return replace(x, expr=visit(x.expr), keys=keys)
        if isinstance(x, n.Over):
            return one(x)
        changed = {f: visit(v) for f, v in vars(x).items() if isinstance(v, n.Node)}
        return replace(x, **changed) if changed else x

    return visit(e)


@word("by", is_ts, is_list)
def _(x: Any, ks: list) -> n.Expr:
    e, keys = ts(x), texts(ks)
    if isinstance(e, n.Over) and e.keys is None:
        inner = n.group_keys(e.expr)
        if not set(keys) <= set(inner):
            raise ProgramError(f"keys {keys} are not among {inner}")
        return replace(e, keys=keys)
    if isinstance(e, n.GroupBy):
        if not set(keys) <= set(e.keys):
            raise ProgramError(f"keys {keys} are not among {e.keys}")
        return n.Over("sum", e, keys)
    if isinstance(e, n.Named) and isinstance(e.shown, n.Expr) and n.group_keys(e.shown) and e.word in ("avg", "stddev"):
        return replace(e, expr=e.expr.rewrite(lambda y: replace(y, keys=keys) if isinstance(y, n.Over) else y), keys=keys)
    return _regrouped(e, keys)


@raw("cg", is_list)
def _(c: Context) -> None:
    keys = texts(c.pop())

    def add(x: Any) -> Any:
        if is_query(x) or not isinstance(x, n.Node):
            return x
        def visit(y: n.Node) -> n.Node:
            if isinstance(y, n.GroupBy):
                return replace(y, keys=(*y.keys, *(k for k in keys if k not in y.keys)))
            if isinstance(y, n.Aggregate):
                return y if y.fn == "all" else n.GroupBy(y, keys)
            if isinstance(y, n.Over) and y.keys is not None:
                y = replace(y, keys=(*y.keys, *(k for k in keys if k not in y.keys)))
            if isinstance(y, n.Named):
                return replace(y, expr=visit(y.expr), keys=tuple(dict.fromkeys((*y.keys, *keys))))
            changed = {f: visit(v) for f, v in vars(y).items() if isinstance(v, n.Node)}
            return replace(y, **changed) if changed else y
        return visit(x)

    c.stack[:] = [add(ts(x)) if is_query(x) else add(x) for x in c.stack]


word("const", is_number)(lambda v: n.Constant(float(v)))
word("pi")(lambda: n.Constant(math.pi))
word("random")(lambda: n.Generated("random"))
word("srandom", is_int)(lambda s: n.Generated("srandom", (int(s),)))
word("time", is_text)(lambda m: n.Generated("time", (m,)))
word("time-span", is_text, is_text)(lambda s, e: n.Generated("time-span", (s, e)))
word("as", is_ts, is_text, is_text)(lambda e, a, b: n.Rename(ts(e), a, b))

_FOLD: dict[str, Callable[[float], float]] = {"abs": abs, "neg": lambda v: -v, "sin": math.sin, "sqrt": lambda v: math.sqrt(v) if v >= 0 else math.nan}


def _unary(op: str, e: n.Expr) -> n.Expr:
    return n.Constant(_FOLD[op](e.value)) if op in _FOLD and isinstance(e, n.Constant) else n.Unary(op, e)


for _op in ("abs", "neg", "sin", "sqrt", "per-step"):
    word(_op, is_ts)(lambda e, op=_op: _unary(op, ts(e)))
for _op in ("clamp-min", "clamp-max"):
    word(_op, is_ts, is_number)(lambda e, v, op=_op: n.Clamp(op, ts(e), float(v)))


def fold_binary(op: str, a: float, b: float) -> float:
    """A binary operation on constants; nan is missing."""
    nan = math.isnan
    truth = lambda v: not nan(v) and abs(v) >= 1e-12
    try:
        return {
            "add": lambda: b if nan(a) else a if nan(b) else a + b,
            "sub": lambda: -b if nan(a) else a if nan(b) else a - b,
            "mul": lambda: a * b,
            "div": lambda: (0.0 if a == 0 else math.nan) if b == 0 else a / b,
            "pow": lambda: math.pow(a, b),
            "gt": lambda: float(a > b),
            "ge": lambda: float(a >= b),
            "lt": lambda: float(a < b),
            "le": lambda: float(a <= b),
            "fadd": lambda: a + b,
            "fsub": lambda: a - b,
            "fmul": lambda: a * b,
            "fdiv": lambda: (math.nan if a == 0 or nan(a) else math.copysign(math.inf, a)) if b == 0 else a / b,
            "and": lambda: float(truth(a) and truth(b)),
            "or": lambda: float(truth(a) or truth(b)),
        }[op]()
    except (OverflowError, ValueError):
        return math.nan


BINARY = ("add", "sub", "mul", "div", "pow", "gt", "ge", "lt", "le", "fadd", "fsub", "fmul", "fdiv", "and", "or")


def _binary(op: str, a: n.Expr, b: n.Expr) -> n.Expr:
    if isinstance(a, n.Constant) and isinstance(b, n.Constant):
        return n.Constant(fold_binary(op, a.value, b.value))
    ka, kb = set(n.group_keys(a)), set(n.group_keys(b))
    if not (ka <= kb or kb <= ka):
        raise ProgramError(f"both sides must be grouped alike: {sorted(ka)} and {sorted(kb)}")
    return n.Binary(op, a, b)


def _styled(op: str, a: Any, b: Any) -> Any:
    """Style survives if one input has it."""
    sa, sb = isinstance(a, n.Style), isinstance(b, n.Style)
    out = _binary(op, a.expr if sa else ts(a), b.expr if sb else ts(b))
    kept = a if sa and not (sb and b.settings) else b if sb and not (sa and a.settings) else None
    return replace(kept, expr=out) if kept is not None else out


for _op in BINARY:
    word(_op, is_style, is_style)(lambda a, b, op=_op: _styled(op, a, b))
macro("cos", ":pi,2,:div,:swap,:sub,:sin", is_ts)
macro("tan", ":dup,:sin,:swap,:cos,:div", is_ts)
macro("cot", ":dup,:cos,:swap,:sin,:div", is_ts)
macro("sec", "1,:swap,:cos,:div", is_ts)
macro("csc", "1,:swap,:sin,:div", is_ts)


def _second(fn: str, x: Any) -> n.Expr:
    e = ts(x)
    if isinstance(e, n.Aggregate) and e.fn != "all" and fn != "count":
        return e  # one line already
    return n.Over(fn, e)


for _fn in ("sum", "count", "min", "max"):
    word(_fn, is_ts)(lambda x, fn=_fn: _second(fn, x))


def _bucketed(x: Any) -> n.GroupBy:
    e = x if isinstance(x, n.GroupBy) else n.GroupBy(aggregate(x), ())
    return replace(e, keys=(*(k for k in e.keys if k != "percentile"), "percentile"))


def is_data(x: Any) -> bool:
    return is_query(x) or isinstance(x, (n.Aggregate, n.GroupBy))


word("percentiles", is_data, is_list)(lambda x, ps: n.Percentiles(_bucketed(x), tuple(float(p) for p in ps)))
macro("median", "(,50,),:percentiles", is_data)


@word("sample-count", is_query, is_number, is_number)
def _(q: n.Query, low: Any, high: Any) -> n.Named:
    from tagloom.functions.buckets import bucket_range

    rate = n.Over("sum", n.GroupBy(n.Aggregate("sum", n.conj(q, bucket_range(float(low), float(high)))), ("percentile",)))
    return _named("sample-count", q, rate, str(low), str(high))


@word("sample-count", is_query)
def _(q: n.Query) -> n.Named:
    return _named("sample-count", q, n.Over("sum", n.GroupBy(n.Aggregate("sum", n.conj(q, n.Has("percentile"))), ("percentile",))))


def _registers(x: Any) -> n.GroupBy:
    """Registers are merged by their maximum."""
    e = x if isinstance(x, n.GroupBy) else n.GroupBy(n.Aggregate("max", x if is_query(x) else x.query), ())
    q = n.conj(e.aggregate.query, n.Compare("eq", "statistic", "distinct"))
    return n.GroupBy(replace(e.aggregate, fn="max", query=q), (*(k for k in e.keys if k != "distinct"), "distinct"))


word("approx-distinct", is_data)(lambda x: n.Distinct(_registers(x)))
word("approx-distinct-cumulative", is_data)(lambda x: n.Distinct(_registers(x), True))


@raw("named-rewrite", is_text)
def _(c: Context) -> None:
    name, e, shown = c.pop(), c.pop(), c.pop()
    c.push(n.Named(name, shown, ts(e)))


# --- over time ---

for _op in ("rolling-count", "rolling-min", "rolling-max", "rolling-sum", "delay"):
    word(_op, is_ts, is_int)(lambda e, k, op=_op: n.Stateful(op, ts(e), (int(k),)))
word("rolling-mean", is_ts, is_int, is_int)(lambda e, k, m: n.Stateful("rolling-mean", ts(e), (int(k), int(m))))
for _op in ("derivative", "integral", "cumulative-max"):
    word(_op, is_ts)(lambda e, op=_op: n.Stateful(op, ts(e)))
word("trend", is_ts, is_text)(lambda e, d: n.Stateful("trend", ts(e), (f"{dates.duration(d) // 1000}s",)))
for _op in ("des", "sdes"):
    word(_op, is_ts, is_int, is_number, is_number)(lambda e, t, a, b, op=_op: n.Stateful(op, ts(e), (int(t), float(a), float(b))))
    for _speed, _args in (("simple", "10,0.1,0.5"), ("fast", "10,0.1,0.02"), ("slower", "10,0.05,0.03"), ("slow", "10,0.03,0.04")):
        macro(f"{_op}-{_speed}", f"{_args},:{_op}", is_ts)


@word("des-epic-signal", is_ts, is_int, is_number, is_number, is_number, is_number, is_number)
def _(e: Any, training: Any, alpha: Any, beta: Any, max_pct: Any, min_pct: Any, noise: Any) -> n.Expr:
    """1 where the line leaves its predicted bounds, else 0."""
    line = ts(e)
    predicted = n.Stateful("des", line, (int(training), float(alpha), float(beta)))
    scaled = lambda pct, sign: n.Binary("fmul", predicted, n.Constant(1.0 + sign * float(pct)))
    above = n.Binary("and", n.Binary("gt", line, scaled(max_pct, 1)), n.Binary("gt", line, n.Binary("add", predicted, n.Constant(float(noise)))))
    below = n.Binary("and", n.Binary("lt", line, scaled(min_pct, -1)), n.Binary("lt", line, n.Binary("sub", predicted, n.Constant(float(noise)))))
    return n.Named("des-epic-signal", line, n.Binary("or", above, below), (), tuple(map(str, (training, alpha, beta, max_pct, min_pct, noise))))


# --- filters ---

STATS = ("avg", "max", "min", "last", "total", "count")


@word("stat", is_ts, is_text)
def _(e: Any, stat: str) -> n.Stat:
    if stat not in STATS:
        raise ProgramError(f"unknown statistic: {stat}")
    return n.Stat(ts(e), stat)


for _stat in STATS:
    word(f"stat-{_stat}")(lambda s=_stat: n.StatOf(s))
for _stat in ("min", "max", "avg"):
    macro(f"stat-{_stat}-mf", f"{_stat},:stat", is_ts)


def _filtered(e: n.Expr, by: n.Expr) -> n.Filter:
    return n.Filter(e, by.rewrite(lambda x: n.Stat(e, x.stat) if isinstance(x, n.StatOf) else x))


word("filter", is_ts, is_ts)(lambda e, by: _filtered(ts(e), ts(by)))
word("filter", is_style, is_ts)(lambda e, by: replace(e, expr=_filtered(e.expr, ts(by))))

RANKED = [f"{k}{o}" for k in ("topk", "bottomk") for o in ("", "-others-min", "-others-max", "-others-sum", "-others-avg")]


def _ranked(op: str, e: Any, stat: str, k: Any) -> n.Ranked:
    if stat not in STATS:
        raise ProgramError(f"unknown statistic: {stat}")
    if int(k) <= 0:
        raise ProgramError("k must be positive")
    return n.Ranked(op, ts(e), stat, int(k))


for _op in RANKED:
    word(_op, is_ts, is_text, is_int)(lambda e, s, k, op=_op: _ranked(op, e, s, k))


@word("consolidate", is_ts, is_text, is_text)
def _(e: Any, cf: str, step: str) -> n.Consolidate:
    if cf not in ("avg", "sum", "min", "max"):
        raise ProgramError(f"unknown consolidation function: {cf}")
    return n.Consolidate(ts(e), cf, dates.duration(step))


# --- style ---

for _setting in ("alpha", "color", "palette", "ls", "lw", "axis", "legend", "decode", "sort", "order", "limit"):
    word(_setting, is_style, is_text)(lambda e, v, key=_setting: style(e).put(key, v))
for _ls in ("area", "line", "stack", "heatmap", "vspan"):
    macro(_ls, f"{_ls},:ls", is_style)
macro("head", ":limit", is_style, is_text)
word("s", is_style, is_text, is_text)(lambda e, a, b: style(e).put("s", f"{a}\x00{b}"))
word("strip-style", is_style)(lambda e: style(e).expr)
word("percentiles-heatmap", is_data)(lambda x: n.Style(_bucketed(x)).put("ls", "heatmap"))


@raw("offset", is_style, is_list)
def _(c: Context) -> None:
    offsets, e = texts(c.pop()), style(c.pop())
    for d in offsets:
        ms = dates.duration(d)
        c.push(replace(e, expr=e.expr.rewrite(lambda x, ms=ms: replace(x, offset=ms) if isinstance(x, n.Aggregate) else x)))


@raw("des-epic-viz", is_ts, is_int, is_number, is_number, is_number, is_number, is_number)
def _(c: Context) -> None:
    args = [c.pop() for _ in range(6)][::-1]
    line = ts(c.pop())
    predicted = n.Stateful("des", line, (int(args[0]), float(args[1]), float(args[2])))
    bound = lambda pct, sign: n.Binary("fmul", predicted, n.Constant(1.0 + sign * float(pct)))
    c.push(n.Style(line).put("legend", "line"))
    c.push(n.Style(bound(args[3], 1)).put("legend", "max"))
    c.push(n.Style(bound(args[4], -1)).put("legend", "min"))
    c.push(line)
    for a in args:
        c.push(a)
    c.call([":des-epic-signal", ":vspan", "triggered", ":legend"])


# --- events ---

word("table", is_event, is_list)(lambda q, cols: n.Event("table", q, texts(cols)))
word("sample", is_event, is_list, is_list)(lambda q, by, cols: n.Event("sample", q, texts(cols), texts(by)))


def custom_average(interpreter: Interpreter, name: str, denominator: str, shared: tuple[str, ...]) -> None:
    """Add a word that divides a sum by the number of units that a base query counts, under the shared tags of its predicate."""
    base = parse_query(denominator)

    def keep(q: n.Query) -> n.Query:
        out: n.Query = n.Always(True)
        for k, v in n.exact_keys(q).items():
            if k in shared:
                out = n.conj(out, n.Compare("eq", k, v))
        return out

    def build(x: Any) -> n.Named:
        a = aggregate(x) if is_aggregate(x) else x.aggregate
        count = n.Aggregate("sum", n.conj(base, keep(a.query)))
        if isinstance(x, n.GroupBy) and set(x.keys) <= set(shared):
            return _named(name, x, n.Binary("div", x, n.GroupBy(count, x.keys)))
        return _named(name, x, n.Binary("div", x if isinstance(x, n.GroupBy) else a, count))

    interpreter.words.setdefault(name, []).append(Word(name, lambda s: bool(s) and is_data(s[-1]), lambda c: c.push(build(c.pop()))))


def new_interpreter() -> Interpreter:
    return Interpreter(WORDS)


def parse(program: str, interpreter: Interpreter | None = None) -> list[n.Style]:
    """Expressions of a program, in stack order."""
    out = []
    for x in (interpreter or new_interpreter()).run(program):
        if not is_style(x):
            raise ProgramError(f"not an expression: {x}")
        out.append(style(x))
    return out


def parse_query(program: str) -> n.Query:
    found = new_interpreter().run(program)
    if len(found) != 1 or not is_query(found[0]):
        raise ProgramError(f"not a predicate: {program}")
    return found[0]


def parse_event(program: str) -> n.Event:
    found = new_interpreter().run(program)
    if len(found) != 1 or not is_event(found[0]):
        raise ProgramError(f"not an event expression: {program}")
    return found[0] if isinstance(found[0], n.Event) else n.Event("raw", found[0])
