"""Double exponential smoothing: a recurrence, so each line's points go through a pandas function in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Smoother:
    """Predictions of one line; emits the prediction made before each value, once `training` values are known."""

    def __init__(self, training: int, alpha: float, beta: float):
        self.training, self.alpha, self.beta = training, alpha, beta
        self.seen, self.level, self.slope = 0, np.nan, 0.0

    def next(self, v: float) -> float:
        out = self.level if self.seen >= self.training else np.nan
        if not np.isnan(v):
            if self.seen == 0:
                self.level, self.slope = v, 0.0
            else:
                before = self.level
                self.level = self.alpha * v + (1 - self.alpha) * (before + self.slope)
                self.slope = self.beta * (self.level - before) + (1 - self.beta) * self.slope
            self.seen += 1
        return out

    def state(self) -> tuple[int, float, float]:
        return self.seen, self.level, self.slope

    def restore(self, state: tuple[int, float, float]) -> Smoother:
        self.seen, self.level, self.slope = state
        return self


class SlidingSmoother:
    """Two smoothers that both see all values; every `training` values the one in use starts over and the other takes its turn."""

    def __init__(self, training: int, alpha: float, beta: float):
        self.make = lambda: Smoother(training, alpha, beta)
        self.training, self.at = training, 0
        self.used, self.other = self.make(), self.make()

    def next(self, v: float) -> float:
        out = self.used.next(v)
        self.other.next(v)
        self.at += 1
        if self.at % self.training == 0:
            self.used, self.other = self.other, self.make()
        return out


def smooth_values(values: np.ndarray, op: str, args: tuple, skip: int = 0) -> np.ndarray:
    """Predictions for evenly spaced values; the first `skip` are taken as missing."""
    s = (Smoother if op == "des" else SlidingSmoother)(*args)
    skip = min(skip, len(values))
    return np.concatenate([np.full(skip, np.nan), [s.next(v) for v in values[skip:]]])


def smooth(df: DataFrame, ids: list[str], column: str, op: str, args: tuple, start: int, step: int) -> DataFrame:
    """df with a column _smoothed; the sliding form starts at a multiple of training steps, whatever the range."""
    training = int(args[0])
    skip = (-(-start // (step * training)) * step * training - start) // step if op == "sdes" else 0

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        out = smooth_values(g[column].to_numpy(dtype=float), op, args, skip)
        return g.drop(columns=[column]).assign(_smoothed=[None if np.isnan(x) else x for x in out])

    kinds = dict(df.dtypes)
    src = df if ids else df.withColumn("_all", F.lit(0))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ids) + (", " if ids else "") + "ts long, _smoothed double"
    if ids:
        return src.groupBy(*ids).applyInPandas(one, schema)
    return src.groupBy("_all").applyInPandas(lambda g: one(g.drop(columns=["_all"])), schema)
