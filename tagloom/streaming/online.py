"""Online forms of the over-time operators, with state that can be saved and restored.

NaN is missing. `next` takes one value and gives one; a state is a list of JSON values.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable

NAN = math.nan


def _truth(v: float) -> bool:
    return not math.isnan(v) and abs(v) >= 1e-12


class Online:
    def next(self, v: float) -> float:
        raise NotImplementedError

    def state(self) -> str:
        return json.dumps({k: list(x) if isinstance(x, deque) else x for k, x in vars(self).items()})

    def restore(self, state: str) -> Online:
        for k, x in json.loads(state).items():
            setattr(self, k, deque(x) if isinstance(getattr(self, k), deque) else x)
        return self


class Rolling(Online):
    """Count, min, max, sum or mean of the last n values."""

    def __init__(self, how: str, n: int, least: int = 1):
        self.how, self.n, self.least, self.last = how, n, least, deque()

    def next(self, v: float) -> float:
        self.last.append(v)
        if len(self.last) > self.n:
            self.last.popleft()
        if self.how == "count":
            return float(sum(map(_truth, self.last)))
        known = [x for x in self.last if not math.isnan(x)]
        if len(known) < max(1, self.least):
            return NAN
        return {"min": min, "max": max, "sum": math.fsum, "mean": lambda x: math.fsum(x) / len(x)}[self.how](known)


class Delay(Online):
    def __init__(self, n: int):
        self.n, self.last = n, deque()

    def next(self, v: float) -> float:
        self.last.append(v)
        return self.last.popleft() if len(self.last) > self.n else NAN


class Derivative(Online):
    def __init__(self):
        self.before = NAN

    def next(self, v: float) -> float:
        out, self.before = v - self.before, v
        return out


class Integral(Online):
    def __init__(self):
        self.total = NAN

    def next(self, v: float) -> float:
        if not math.isnan(v):
            self.total = v if math.isnan(self.total) else self.total + v
        return self.total


class CumulativeMax(Online):
    def __init__(self):
        self.most = NAN

    def next(self, v: float) -> float:
        if not math.isnan(v):
            self.most = v if math.isnan(self.most) else max(self.most, v)
        return self.most


class Trend(Online):
    """Mean of exactly n points, missing ones as 0; missing until there are n or if all are missing."""

    def __init__(self, n: int):
        self.n, self.last = n, deque()

    def next(self, v: float) -> float:
        if self.n <= 1:
            return v
        self.last.append(v)
        if len(self.last) > self.n:
            self.last.popleft()
        known = [x for x in self.last if not math.isnan(x)]
        return math.fsum(known) / self.n if len(self.last) == self.n and known else NAN


class Des(Online):
    """Double exponential smoothing: the prediction made before each value."""

    def __init__(self, training: int, alpha: float, beta: float):
        self.training, self.alpha, self.beta = training, alpha, beta
        self.seen, self.level, self.slope = 0, NAN, 0.0

    def next(self, v: float) -> float:
        out = self.level if self.seen >= self.training else NAN
        if not math.isnan(v):
            if self.seen == 0:
                self.level = v
            else:
                before = self.level
                self.level = self.alpha * v + (1 - self.alpha) * (before + self.slope)
                self.slope = self.beta * (self.level - before) + (1 - self.beta) * self.slope
            self.seen += 1
        return out


def online(op: str, args: tuple, step: int = 60_000) -> Online:
    """The online form of a stateful word."""
    from tagloom.functions.dates import duration

    make: dict[str, Callable[[], Online]] = {
        "rolling-count": lambda: Rolling("count", args[0]),
        "rolling-min": lambda: Rolling("min", args[0]),
        "rolling-max": lambda: Rolling("max", args[0]),
        "rolling-sum": lambda: Rolling("sum", args[0]),
        "rolling-mean": lambda: Rolling("mean", args[0], args[1]),
        "delay": lambda: Delay(args[0]),
        "derivative": Derivative,
        "integral": Integral,
        "cumulative-max": CumulativeMax,
        "trend": lambda: Trend(duration(args[0]) // step),
        "des": lambda: Des(*args),
    }
    return make[op]()
