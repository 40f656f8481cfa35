"""Expression tree: tag predicates, data, math, stateful, filter, style and event expressions.

Every node is an immutable dataclass that prints back to a program which parses to an
equal node; `rewrite` rebuilds a tree bottom-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


class Node:
    def rewrite(self, fn: Callable[[Node], Node]) -> Node:
        """The tree with fn applied to each node, children first."""
        changed = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Node):
                changed[f.name] = v.rewrite(fn)
            elif isinstance(v, tuple) and any(isinstance(x, Node) for x in v):
                changed[f.name] = tuple(x.rewrite(fn) if isinstance(x, Node) else x for x in v)
        return fn(replace(self, **changed) if changed else self)

    def walk(self) -> Iterator[Node]:
        yield self
        for f in fields(self):
            v = getattr(self, f.name)
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, Node):
                    yield from x.walk()


def listed(items: tuple[str, ...]) -> str:
    return "(," + "".join(f"{i}," for i in items) + ")"


def number(v: float) -> str:
    return repr(float(v))


def quoted(text: str) -> str:
    """A literal as it must stand in a program."""
    out = "".join(f"\\u{ord(c):04x}" if c in ",\\" or c.isspace() else c for c in text)
    if out[:1] == ":" or out in ("(", ")"):
        out = f"\\u{ord(out[0]):04x}{out[1:]}"
    return out


# --- tag predicates ---


class Query(Node):
    pass


@dataclass(frozen=True)
class Always(Query):
    value: bool

    def __str__(self) -> str:
        return ":true" if self.value else ":false"


@dataclass(frozen=True)
class Has(Query):
    key: str

    def __str__(self) -> str:
        return f"{quoted(self.key)},:has"


@dataclass(frozen=True)
class Compare(Query):
    """op: eq lt le gt ge re reic contains starts ends."""

    op: str
    key: str
    value: str

    def __str__(self) -> str:
        return f"{quoted(self.key)},{quoted(self.value)},:{self.op}"


@dataclass(frozen=True)
class In(Query):
    key: str
    values: tuple[str, ...]

    def __str__(self) -> str:
        return f"{quoted(self.key)},{listed(tuple(map(quoted, self.values)))},:in"


@dataclass(frozen=True)
class And(Query):
    left: Query
    right: Query

    def __str__(self) -> str:
        return f"{self.left},{self.right},:and"


@dataclass(frozen=True)
class Or(Query):
    left: Query
    right: Query

    def __str__(self) -> str:
        return f"{self.left},{self.right},:or"


@dataclass(frozen=True)
class Not(Query):
    query: Query

    def __str__(self) -> str:
        return f"{self.query},:not"


def conj(a: Query, b: Query) -> Query:
    if isinstance(a, Always):
        return b if a.value else a
    if isinstance(b, Always):
        return a if b.value else b
    return And(a, b)


def disj(a: Query, b: Query) -> Query:
    if isinstance(a, Always):
        return a if a.value else b
    if isinstance(b, Always):
        return b if b.value else a
    return Or(a, b)


def neg(a: Query) -> Query:
    if isinstance(a, Always):
        return Always(not a.value)
    return a.query if isinstance(a, Not) else Not(a)


def exact_keys(q: Query) -> dict[str, str]:
    """Tags that the predicate fixes: those of :eq clauses outside :or and :not."""
    if isinstance(q, Compare) and q.op == "eq":
        return {q.key: q.value}
    if isinstance(q, And):
        return exact_keys(q.left) | exact_keys(q.right)
    return {}


# --- data expressions ---


class Expr(Node):
    """Anything that evaluates to time series."""


class DataExpr(Expr):
    pass


@dataclass(frozen=True)
class Aggregate(DataExpr):
    """fn: all sum count min max; cf None is the default of fn."""

    fn: str
    query: Query
    cf: str | None = None
    offset: int = 0

    def __str__(self) -> str:
        return f"{self.query},:{self.fn}" + (f",:cf-{self.cf}" if self.cf else "") + shifted(self.offset)

    @property
    def consolidation(self) -> str:
        return self.cf or {"sum": "avg", "count": "avg", "min": "min", "max": "max", "all": "sum"}[self.fn]


@dataclass(frozen=True)
class GroupBy(DataExpr):
    aggregate: Aggregate
    keys: tuple[str, ...]

    def __str__(self) -> str:
        a = self.aggregate
        return f"{replace(a, offset=0)},{listed(self.keys)},:by" + shifted(a.offset)


def shifted(ms: int) -> str:
    return f",{ms // 1000}s,:offset" if ms else ""


# --- math ---


@dataclass(frozen=True)
class Constant(Expr):
    value: float

    def __str__(self) -> str:
        return f"{number(self.value)},:const"


@dataclass(frozen=True)
class Generated(Expr):
    """kind: random, srandom (arg: seed), time (arg: mode), time-span (arg: start and end in ms)."""

    kind: str
    args: tuple[Any, ...] = ()

    def __str__(self) -> str:
        return "".join(f"{a}," for a in self.args) + f":{self.kind}"


@dataclass(frozen=True)
class Unary(Expr):
    """op: abs neg sin sqrt per-step."""

    op: str
    expr: Expr

    def __str__(self) -> str:
        return f"{self.expr},:{self.op}"


@dataclass(frozen=True)
class Clamp(Expr):
    op: str
    expr: Expr
    bound: float

    def __str__(self) -> str:
        return f"{self.expr},{number(self.bound)},:{self.op}"


@dataclass(frozen=True)
class Rename(Expr):
    expr: Expr
    old: str
    new: str

    def __str__(self) -> str:
        return f"{self.expr},{quoted(self.old)},{quoted(self.new)},:as"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left},{self.right},:{self.op}"


@dataclass(frozen=True)
class Over(Expr):
    """Second-level aggregation of all series of an expression, or by keys."""

    fn: str
    expr: Expr
    keys: tuple[str, ...] | None = None

    def __str__(self) -> str:
        return f"{self.expr},:{self.fn}" + (f",{listed(self.keys)},:by" if self.keys else "")


@dataclass(frozen=True)
class Percentiles(Expr):
    data: GroupBy
    pcts: tuple[float, ...]

    def __str__(self) -> str:
        return f"{self.data},{listed(tuple(map(number, self.pcts)))},:percentiles"


@dataclass(frozen=True)
class Distinct(Expr):
    """Approximate distinct count from register tags; cumulative keeps each register's maximum so far."""

    data: GroupBy
    cumulative: bool = False

    def __str__(self) -> str:
        return f"{self.data},:approx-distinct" + ("-cumulative" if self.cumulative else "")


@dataclass(frozen=True)
class Named(Expr):
    """A word whose display form differs from what is evaluated."""

    word: str
    shown: Expr | Query
    expr: Expr
    keys: tuple[str, ...] = ()
    args: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.shown}," + "".join(f"{a}," for a in self.args) + f":{self.word}" + (f",{listed(self.keys)},:by" if self.keys else "")


# --- over time ---


@dataclass(frozen=True)
class Stateful(Expr):
    """op: rolling-count/min/max/mean/sum delay derivative integral cumulative-max trend des sdes."""

    op: str
    expr: Expr
    args: tuple[Any, ...] = ()

    def __str__(self) -> str:
        return f"{self.expr}," + "".join(f"{a}," for a in self.args) + f":{self.op}"


@dataclass(frozen=True)
class Consolidate(Expr):
    expr: Expr
    cf: str
    step: int

    def __str__(self) -> str:
        return f"{self.expr},{self.cf},{self.step // 1000}s,:consolidate"


# --- whole-window filters ---


@dataclass(frozen=True)
class Stat(Expr):
    expr: Expr
    stat: str

    def __str__(self) -> str:
        return f"{self.expr},{self.stat},:stat"


@dataclass(frozen=True)
class StatOf(Expr):
    """Placeholder inside a filter for a statistic of the filtered expression."""

    stat: str

    def __str__(self) -> str:
        return f":stat-{self.stat}"


@dataclass(frozen=True)
class Filter(Expr):
    expr: Expr
    by: Expr

    def __str__(self) -> str:
        return f"{self.expr},{self.by},:filter"


@dataclass(frozen=True)
class Ranked(Expr):
    """op: topk bottomk, with -others-min/max/sum/avg."""

    op: str
    expr: Expr
    stat: str
    k: int

    def __str__(self) -> str:
        return f"{self.expr},{self.stat},{self.k},:{self.op}"


# --- presentation and events ---


@dataclass(frozen=True)
class Style(Node):
    expr: Expr
    settings: tuple[tuple[str, str], ...] = ()

    def __str__(self) -> str:
        out = str(self.expr)
        for k, v in self.settings:
            out += f",{quoted_template(v)},:{k}" if k not in ("s",) else "," + ",".join(map(quoted_template, v.split("\x00"))) + ",:s"
        return out

    def get(self, key: str, default: str | None = None) -> str | None:
        return next((v for k, v in reversed(self.settings) if k == key), default)

    def put(self, key: str, value: str) -> Style:
        kept = self.settings if key == "s" else tuple((k, v) for k, v in self.settings if k != key)
        return replace(self, settings=(*kept, (key, value)))


def quoted_template(text: str) -> str:
    return text.replace("\\", "\\u005c").replace(",", "\\u002c")


@dataclass(frozen=True)
class Event(Node):
    """kind: raw, table (columns), sample (sample keys and projection)."""

    kind: str
    query: Query
    columns: tuple[str, ...] = ()
    by: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.kind == "raw":
            return str(self.query)
        return f"{self.query}," + (f"{listed(self.by)}," if self.kind == "sample" else "") + f"{listed(self.columns)},:{self.kind}"


def group_keys(e: Node) -> tuple[str, ...]:
    """The final grouping of an expression."""
    if isinstance(e, GroupBy):
        return e.keys
    if isinstance(e, Named):
        return e.keys or group_keys(e.expr)
    if isinstance(e, (Percentiles,)):
        return tuple(k for k in e.data.keys)
    if isinstance(e, Distinct):
        return tuple(k for k in e.data.keys if k != "distinct")
    if isinstance(e, Over):
        return e.keys or ()
    if isinstance(e, Binary):
        a, b = group_keys(e.left), group_keys(e.right)
        return a if len(a) >= len(b) else b
    if isinstance(e, Rename):
        return tuple(e.new if k == e.old else k for k in group_keys(e.expr))
    inner = getattr(e, "expr", None)
    return group_keys(inner) if isinstance(inner, Node) else ()


def data_exprs(e: Node) -> list[DataExpr]:
    """Distinct leaf queries, in order."""
    out: dict[DataExpr, None] = {}

    def visit(n: Node) -> None:
        if isinstance(n, (Aggregate, GroupBy)):
            out[n] = None
            return
        for f in fields(n):
            if isinstance(n, Named) and f.name == "shown":
                continue
            v = getattr(n, f.name)
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, Node):
                    visit(x)

    visit(e)
    return list(out)
