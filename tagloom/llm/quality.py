"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad; its features are its own and those of its neighbours. The
field learns from documents' labels, which all lines of a document share, on a bounded
sample of labelled rows, read whole. The objective is one: the mean over documents of
the log likelihood of a document's line labels divided by its lines, less a quadratic
penalty, with transition scores between -2 and 2, as labels that never change inside a
document would otherwise drive them without bound. A document's quality is the mean of its lines' marginals from
the forward-backward pass, weighted by line length and calibrated by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import arrow_map, texts_of

#: Labelled documents that the fit reads at most, those with the smallest hash of their id.
FIT_DOCS = 4000
THRESHOLD = 0.7
#: Transition scores lie within this of 0.
MOST_TRANS = 2.0
_CLASSES = 9


def _classes() -> np.ndarray:
    lut = np.full(256, 7, np.uint8)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\v\f", 3), ("!", 4), ("|", 5), ("#$%&*@^~_=+<>{}[]\\", 6)):
        lut[[ord(c) for c in chars]] = k
    lut[128:] = 8
    return lut


_LUT = _classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, lines of each text, characters (at least 1) of each line."""
    lines = [t.split("\n") for t in texts]
    count = np.array([len(x) for x in lines])
    flat = [x for one in lines for x in one]
    raw = "\n".join(flat).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    ends = np.append(ends, len(data))
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    owner = np.repeat(np.arange(len(flat)), size + 1)[: len(data)]
    by = np.bincount(owner * _CLASSES + _LUT[data], minlength=len(flat) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    by[: len(flat) - 1, 7] -= 1  # the line feed itself
    words, distinct, repeats, total_words, all_distinct = [], [], [], [], []
    for one in lines:
        seen, in_doc, n_doc = set(), set(), 0
        for x in one:
            w = x.split()
            s = set(w)
            words.append(len(w))
            distinct.append(len(s))
            repeats.append(x in seen and bool(w))
            seen.add(x)
            in_doc |= s
            n_doc += len(w)
        total_words += [n_doc] * len(one)
        all_distinct += [len(in_doc) / max(1, n_doc)] * len(one)
    words, total = np.array(words, float), np.maximum(size, 1)
    letters = np.maximum(by[:, 0] + by[:, 1] + by[:, 8] / 2, 1)
    total_words = np.array(total_words, float)
    own = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            by[:, 1] / letters,
            by[:, 2] / total,
            by[:, 4] / total * 10,
            by[:, 5] / total * 10,
            by[:, 6] / total * 10,
            by[:, 7] / total,
            np.array(distinct) / np.maximum(words, 1),
            size / np.maximum(words, 1) / 10,
            np.array(repeats, float),
            (words < 4).astype(float),
            (by[:, 4] + by[:, 5] + by[:, 6] > 0.02 * total).astype(float),
            (by[:, 1] > 0.5 * letters).astype(float),
        ],
        axis=1,
    )
    first = np.cumsum(count) - count
    before, after = np.arange(len(flat)) - 1, np.arange(len(flat)) + 1
    edge_first, edge_last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    edge_first[first] = True
    edge_last[first + count - 1] = True
    near = own[:, [0, 2, 4, 5, 6, 8]]
    left = np.where(edge_first[:, None], near, near[np.maximum(before, 0)])
    right = np.where(edge_last[:, None], near, near[np.minimum(after, len(flat) - 1)])
    whole = np.stack([np.log1p(total_words), (total_words < 8).astype(float), (total_words < 20).astype(float), np.array(all_distinct), np.log1p(np.repeat(count, count)), np.ones(len(flat))], axis=1)
    return np.concatenate([own, left, right, whole], axis=1), count, np.array([max(1, len(x)) for x in flat], float)


def marginals(unary: np.ndarray, count: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good by line, log partition by text, expected transitions (summed) of a two-state chain.

    unary: score of good by line (bad has 0); trans: 2 x 2 scores, state before and after;
    weight: by text, what its transitions count in the sum (1).
    """
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    first, sorted_count = first[order], count[order]
    alpha = np.zeros((len(unary), 2))
    beta = np.zeros((len(unary), 2))
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    live = len(count) - np.searchsorted(sorted_count[::-1], np.arange(1, sorted_count[0] + 1))
    alpha[first] = score[first]
    for t in range(1, sorted_count[0]):
        at = first[: live[t]] + t
        p = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0])
        alpha[at, 1] = np.logaddexp(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1]) + score[at, 1]
    for t in range(sorted_count[0] - 1, 0, -1):
        at = first[: live[t]] + t
        n = beta[at] + score[at]
        beta[at - 1, 0] = np.logaddexp(n[:, 0] + trans[0, 0], n[:, 1] + trans[0, 1])
        beta[at - 1, 1] = np.logaddexp(n[:, 0] + trans[1, 0], n[:, 1] + trans[1, 1])
    last = np.cumsum(count) - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(count) - count] = False
    at = np.flatnonzero(inner)
    z = np.repeat(log_z, count)[at]
    each = np.repeat(np.ones(len(count)) if weight is None else weight, count)[at]
    expected = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            expected[a, b] = np.exp(alpha[at - 1, a] + trans[a, b] + score[at, b] + beta[at, b] - z) @ each
    return good, log_z, expected


@dataclass(frozen=True)
class Field:
    """A fitted field: feature scaling, weights of good, transitions and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals by line, lines of each text, line lengths."""
        x, count, size = line_features(texts)
        return marginals((x - self.mean) / self.scale @ self.weights, count, self.trans)[0], count, size

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, good lines and bad lines of each text."""
        good, count, size = self.lines(texts)
        n_good = np.add.reduceat((good > 0.5).astype(np.int64), np.cumsum(count) - count)
        return 1 / (1 + np.exp(-(self.slope * pooled(good, count, size) + self.offset))), n_good, count - n_good


def pooled(good: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal."""
    at = np.cumsum(count) - count
    p = np.clip(np.add.reduceat(good * size, at) / np.add.reduceat(size, at), 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def objective(theta: np.ndarray, x: np.ndarray, count: np.ndarray, labels: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """What `fit` minimises, and its gradient; theta is the weights of good, then the four transition scores."""
    w, trans = theta[:-4], theta[-4:].reshape(2, 2)
    y, weight = np.repeat(labels, count), 1 / count
    each = np.repeat(weight, count)
    unary = x @ w
    good, log_z, expected = marginals(unary, count, trans, weight)
    same = np.diag([((1 - labels) * (count - 1)) @ weight, (labels * (count - 1)) @ weight])
    likelihood = (unary * y) @ each + (trans * same).sum() - log_z @ weight
    grad = np.concatenate([x.T @ ((good - y) * each), (expected - same).ravel()]) / len(count) + l2 * theta
    return -likelihood / len(count) + l2 / 2 * float(theta @ theta), grad


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> Field:
    """Penalised maximum likelihood by Adam on all texts; one label alone, or no text, gives a constant score."""
    labels = np.asarray(labels, float)
    if not len(texts) or labels.min() == labels.max():
        width = line_features([""])[0].shape[1]
        return Field(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, 2.0 if len(labels) == 0 or labels[0] else -2.0)
    x, count, size = line_features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    x = (x - mean) / scale
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        _, g = objective(theta, x, count, labels, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -MOST_TRANS, MOST_TRANS)
    w, trans = theta[:-4], theta[-4:].reshape(2, 2)
    z = pooled(marginals(x @ w, count, trans)[0], count, size)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of the calibration
        p = 1 / (1 + np.exp(-(slope * z + offset)))
        g = np.array([((p - labels) * z).sum() + 1e-2 * (slope - 1), (p - labels).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-6:
            break
    return Field(mean, scale, w, trans, float(np.clip(slope, 0.05, 20)), float(np.clip(offset, -20, 20)))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """Fit on at most fit_docs labelled rows that aren't held out."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).dropna().where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)
    # at most fit_docs rows of two numbers are broadcast, and as many whole texts are read
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "_y", "_text").dropDuplicates(["_id"]).orderBy("_id").collect()
    return fit([r._text for r in rows], np.array([r._y for r in rows]))


def score(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """Quality of each document, one output row per input row.

    Result: doc_id, held_out, score, predicted, n_good_lines, n_bad_lines (lines by their
    own marginal; an empty text is one line), `keep`. Null and empty texts get a score like
    any other; a null id is not held out; repeated rows are repeated; columns besides
    doc_id, text and `keep` are ignored.
    """
    keep = keep or []
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, score double, predicted int, n_good_lines long, n_bad_lines long" + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, n_good, n_bad = field.scores(texts_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(n_good, pa.int64()), pa.array(n_bad, pa.int64()), *[b.column(3 + k) for k in range(len(keep))]], names=["doc_id", "held_out", "score", "predicted", "n_good_lines", "n_bad_lines", *keep])

    return arrow_map(docs.select(docs["doc_id"], held_out("doc_id").alias("_held"), docs["text"].alias("_text"), *[docs[c].alias(f"_k_{c}") for c in keep]), run, schema)
