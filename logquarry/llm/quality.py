"""Quality classifier: a sparse ensemble of rules over text statistics.

statistics() measures whole texts (Arrow batches). fit() grows boosted trees on a bounded sample of labelled
rows, takes every path from a root as a conjunctive rule, and fits a lasso logistic regression over the
rules; score() compiles the rules that kept a weight into one Spark column expression.

Nulls and empty texts have zero statistics and get the score those lead to. Labels that are null are not
learned from; several labels of one id count as the lowest. Without labels, or with one class only, the score
is the share of label 1 (0.5 without any). Repeated rows and equal texts get equal scores.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .common import text_bytes

STATISTICS = (
    "log_words", "word_length", "upper", "digit", "bang", "symbol", "bar", "stop", "comma", "blank", "high",
    "lines", "line_length", "distinct_words", "repeats", "distinct_lines",
)

#: Labelled rows that the model is fitted on, at most about as many.
SAMPLE = 20_000
#: score >= THRESHOLD is predicted as label 1.
THRESHOLD = 0.7

_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*@^~+=<>_\\{}[]", np.uint8)


def measure(raw: bytes) -> tuple[float, ...]:
    n = len(raw)
    if not n:
        return (0.0,) * len(STATISTICS)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(len(words), 1)
    blank = int(c[9:14].sum() + c[32])
    repeats = sum(map(operator.eq, words, islice(words, 1, None)))
    return (
        float(np.log1p(len(words))), (n - blank) / w, c[_UPPER].sum() / n, c[_DIGIT].sum() / n, c[33] / n,
        c[_SYMBOL].sum() / n, c[124] / n, c[46] / w, c[44] / w, blank / n, c[128:].sum() / n, len(lines) / w,
        float(np.log1p(n / len(lines))), len(set(words)) / w, repeats / w, len(set(lines)) / len(lines),
    )


def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        yield pd.DataFrame(np.array([measure(x) for x in t], np.float64).reshape(len(t), len(STATISTICS)), columns=STATISTICS)


def statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """docs with a struct of STATISTICS of its text."""
    ship_package(docs.sparkSession)
    udf = F.pandas_udf(_statistics, ", ".join(f"{s} double" for s in STATISTICS)).asNondeterministic()
    return docs.withColumn(name, udf(text_bytes()))


@dataclass(frozen=True)
class Rule:
    """low < statistic <= high for each listed statistic."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, low, high in self.bounds:
            out &= (x[:, j] > low) & (x[:, j] <= high)
        return out

    def column(self, struct: str) -> Column:
        out = F.lit(True)
        for j, low, high in self.bounds:
            value = F.col(f"{struct}.{STATISTICS[j]}")
            if low > -np.inf:
                out = out & (value > F.lit(float(low)))
            if high < np.inf:
                out = out & (value <= F.lit(float(high)))
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, struct: str = "statistics") -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(struct), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, depth: int, least: int) -> list[tuple[dict, float, bool]]:
    """Nodes below the root of a least-squares tree: (bounds by statistic, mean of the target, whether a leaf)."""
    nodes: list[tuple[dict, float, bool]] = []

    def grow(rows: np.ndarray, bounds: dict, left: int) -> bool:
        if not left or len(rows) < 2 * least:
            return False
        t, best = target[rows], (1e-9, None, 0)
        total, n = t.sum(), len(rows)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            k = codes[rows, j]
            below = np.cumsum(np.bincount(k, minlength=len(cut) + 1))[:-1]
            part = np.cumsum(np.bincount(k, weights=t, minlength=len(cut) + 1))[:-1]
            ok = (below >= least) & (n - below >= least)
            if not ok.any():
                continue
            gain = np.where(ok, part**2 / np.maximum(below, 1) + (total - part) ** 2 / np.maximum(n - below, 1) - total**2 / n, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], j, i)
        if best[1] is None:
            return False
        _, j, i = best
        under = codes[rows, j] <= i
        low, high = bounds.get(j, (-np.inf, np.inf))
        for side, b in ((rows[under], (low, min(high, cuts[j][i]))), (rows[~under], (max(low, cuts[j][i]), high))):
            node = bounds | {j: b}
            nodes.append((node, float(target[side].mean()), not grow(side, node, left - 1)))
        return True

    grow(np.arange(len(x)), {}, depth)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, l1: float = 1e-3, steps: int = 300, seed: int = 1) -> Model:
    """x: rows of STATISTICS, y: 0 or 1."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 50))) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        p = 1 / (1 + np.exp(-score))
        nodes = _tree(x[rows], (y - p)[rows], cuts, codes[rows], depth, max(5, len(rows) // 500))
        for bounds, mean, leaf in nodes:
            rule = Rule(tuple((j, low, high) for j, (low, high) in sorted(bounds.items())))
            rules.setdefault(rule, None)
            if leaf:  # a leaf moves its rows towards its mean residual
                held = rule.holds(x)
                score[held] += rate * 4 * mean
    names = list(rules)
    design = np.stack([r.holds(x) for r in names], axis=1).astype(np.float32) if names else np.zeros((len(y), 0), np.float32)
    weights, intercept = _lasso(design, y, l1, steps, float(np.log(share / (1 - share))))
    kept = [(r, float(w)) for r, w in zip(names, weights, strict=True) if abs(w) > 1e-4]
    return Model(intercept, tuple(kept))


def _lasso(design: np.ndarray, y: np.ndarray, l1: float, steps: int, intercept: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss plus l1 times the absolute weights."""
    n, m = design.shape
    w = v = np.zeros(m + 1)
    w[-1] = v[-1] = intercept
    x = np.hstack([design, np.ones((n, 1), np.float32)])
    u = np.ones(m + 1)
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        u = x.T @ (x @ (u / np.linalg.norm(u)))
    step, t = 4 * n / max(np.linalg.norm(u), 1e-9) * 0.95, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ v)))
        z = v - step * (x.T @ (p - y)) / n
        new = np.sign(z) * np.maximum(np.abs(z) - step * l1, 0)
        new[-1] = z[-1]
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = new, new + (before - 1) / t * (new - w)
    return w[:-1], float(w[-1])


def held_out(column="doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` labelled documents, chosen by a hash of the id, none of them held out.

    A label's id counts with one text: the one of the least hash, if several rows have it.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # bounded by the sample
    one = own.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.col("text"))).alias("t"))
    chosen = statistics(one.select("doc_id", "label", F.col("t.text").alias("text")))
    rows = chosen.select("doc_id", "label", "statistics.*").toPandas().sort_values(["doc_id", "label"])
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score double and predicted int (in place of columns so named)."""
    rated = statistics(docs, "__statistics").withColumn("score", model.column("__statistics")).drop("__statistics")
    return rated.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
