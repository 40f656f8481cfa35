"""Services over programs: debug, normalize, complete, queries, rewrite and graph requests."""

from __future__ import annotations

from dataclasses import dataclass, replace
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from tagloom.functions import dates
from tagloom.lang import words
from tagloom.lang.interpreter import Context, tokenize
from tagloom.plans import nodes as n


def debug(program: str) -> list[tuple[str, list[str]]]:
    """The stack, top first, after each word."""
    interpreter = words.new_interpreter()
    c = Context(interpreter)
    out, tokens, at = [], tokenize(program), 0
    while at < len(tokens):
        end = at + 1
        if tokens[at] == "(":
            depth = 1
            while depth and end < len(tokens):
                depth += (tokens[end] == "(") - (tokens[end] == ")")
                end += 1
        interpreter.execute(c, tokens[at:end])
        out.append((",".join(tokens[at:end]), [str(x) for x in reversed(c.stack)]))
        at = end
    return out


def _sorted_query(q: n.Query) -> n.Query:
    """Clauses of a conjunction in order, each once."""
    parts: list[n.Query] = []

    def collect(x: n.Query) -> None:
        if isinstance(x, n.And):
            collect(x.left)
            collect(x.right)
        elif x not in parts:
            parts.append(x)

    collect(q)
    parts.sort(key=str)
    out = parts[0]
    for p in parts[1:]:
        out = n.And(out, p)
    return out


def normalize(program: str) -> list[str]:
    """Each expression with its predicates in a canonical order."""
    return [str(e.rewrite(lambda x: replace(x, query=_sorted_query(x.query)) if isinstance(x, n.Aggregate) else x)).removesuffix(",") for e in words.parse(program)]


def complete(program: str) -> list[str]:
    """Words that match the stack a program leaves."""
    interpreter = words.new_interpreter()
    stack = interpreter.run(program)
    return sorted(k for k, ws in interpreter.words.items() if any(w.matches(stack) for w in ws))


def queries(program: str) -> list[str]:
    """Distinct predicates of a program."""
    out = {}
    for s in words.parse(program):
        for d in n.data_exprs(s.expr):
            out[str((d.aggregate if isinstance(d, n.GroupBy) else d).query)] = None
    return list(out)


def strip(program: str, keys: list[str]) -> list[str]:
    """Each expression without the clauses on some keys."""
    drop = lambda x: n.Always(True) if isinstance(x, (n.Compare, n.Has, n.In)) and x.key in keys else x

    def fold(x: n.Node) -> n.Node:
        x = drop(x)
        if isinstance(x, n.And):
            return n.conj(x.left, x.right)
        return n.disj(x.left, x.right) if isinstance(x, n.Or) else x

    return [str(s.rewrite(fold)) for s in words.parse(program)]


def streaming_problems(program: str, max_step: int = 60_000, step: int = 60_000) -> list[str]:
    """Why a program can't be evaluated on a stream; empty if it can."""
    out = ["the step is over the limit"] if step > max_step else []
    for s in words.parse(program):
        for x in s.walk():
            if isinstance(x, n.Aggregate) and x.offset:
                out.append(":offset isn't supported on streams")
            elif isinstance(x, (n.Filter, n.Ranked, n.Stat, n.StatOf)):
                out.append("whole-window filters aren't supported on streams")
            elif isinstance(x, n.Stateful) and x.op in ("integral", "cumulative-max"):
                out.append(f":{x.op} isn't supported on streams")
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Request:
    """A graph request: program, range, step and line order."""

    program: list[n.Style]
    start: int
    end: int
    step: int
    form: str
    sort: str | None
    order: str | None


def graph_request(uri: str, primary: int, now: int | None = None) -> Request:
    """Parameters q, cq, s, e, tz, step, w, format, sort and order of a request."""
    got = {k: v[-1] for k, v in parse_qs(urlsplit(uri).query).items()}
    if "q" not in got:
        raise ValueError("missing required parameter 'q'")
    interpreter = words.new_interpreter()
    items = interpreter.run(got["q"])
    if "cq" in got:
        q = words.parse_query(got["cq"])
        items = [words.common_query(x, q) for x in items]
    start, end = dates.time_range(got.get("s", "e-3h"), got.get("e", "now"), got.get("tz", "UTC"), now)
    step = dates.round_up(dates.duration(got["step"]), primary) if "step" in got else dates.auto_step(primary, start, end, int(got.get("w", 700)))
    styles = [words.style(x) for x in items]
    styles = [s if s.get("sort") or "sort" not in got else s.put("sort", got["sort"]) for s in styles]
    return Request(styles, start, end, step, got.get("format", "json"), got.get("sort"), got.get("order"))


def eval_uri(spark: SparkSession, source, uri: str, now: int | None = None) -> DataFrame:
    from tagloom.plans.compiler import evaluate

    r = graph_request(uri, source.step, now)
    return evaluate(spark, source, r.program, r.start, r.end, r.step)
