"""Quality by a sparse rule ensemble: tree paths as conjunctive rules, lasso logistic weights, compiled into one Spark column.

1. text statistics are Spark expressions; 2. small boosted trees are grown on a sample of about SAMPLE labelled rows (the bound of what
is fitted), drawn by a hash of the key; 3. each path from a root to a node is a rule; 4. a logistic regression with an L1 penalty weighs the rules, most
of them with zero; 5. the rest becomes a CASE expression over the statistics, so scoring needs no Python.

Null and empty texts have statistics of zero and are scored by them. Repeated rows get equal scores. Rows with a null label are
not learned from; without both labels in the sample the score is constant. Columns called ``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, THRESHOLDS, LEAST_ROWS = 24, 3, 24, 20
PENALTY = 0.002
NAMES = ["words", "word_length", "distinct", "upper", "symbols", "digits", "lines"]
Condition = tuple[int, bool, float]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of NAMES, all doubles."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, r"[\x20\t-\r]+", -1), lambda w: w != "")
    chars = F.greatest(F.length(body), F.lit(1))
    left = lambda dropped: F.length(F.regexp_replace(body, dropped, ""))
    return {
        "words": F.size(words).cast("double"),
        "word_length": left(r"[\x20\t-\r]+") / F.greatest(F.size(words), F.lit(1)),
        "distinct": F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)),
        "upper": left(r"\P{Lu}+") / chars,
        "symbols": left(r"[\p{L}\p{N}\s]+") / chars,
        "digits": left(r"[^0-9]+") / chars,
        "lines": left(r"[^\n]+") / chars,
    }



@dataclass
class RuleModel:
    """Conjunctions of (statistic, is greater, threshold), and their weights."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self, values: dict[str, Column]) -> Column:
        """Probability of label 1 over columns of the statistics."""
        columns = [values[n] for n in NAMES]

        def holds(conditions: tuple[Condition, ...]) -> Column:
            return reduce(Column.__and__, [columns[f] > t if greater else columns[f] <= t for f, greater, t in conditions])

        total = reduce(Column.__add__, [F.when(holds(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, strongest first."""
        said = lambda c: " and ".join(f"{NAMES[f]} {'>' if g else '<='} {t:.4g}" for f, g, t in c)
        return [f"{w:+.3f} if {said(c)}" for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _grow(codes: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: tuple[Condition, ...], out: list, step: np.ndarray) -> None:
    """One regression tree by Newton gain over counted codes; adds the paths of its nodes to ``out`` and leaf values to ``step``."""
    g, h = residual[rows], weight[rows]
    if path:
        out.append(path)
    best = None
    if len(path) < DEPTH:
        base = g.sum() ** 2 / (h.sum() + 1)
        for f, thresholds in enumerate(cuts):
            if not len(thresholds):
                continue
            of = codes[rows, f]
            gl, hl, n = (np.cumsum(np.bincount(of, w, len(thresholds) + 1))[:-1] for w in (g, h, None))
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            gain[np.minimum(n, len(rows) - n) < LEAST_ROWS] = -np.inf
            t = int(gain.argmax())
            if best is None or gain[t] > best[0] + 1e-12:
                best = float(gain[t]), f, t
    if best is None or best[0] < 1e-3:
        step[rows] = g.sum() / (h.sum() + 1)
        return
    _, f, t = best
    left = codes[rows, f] <= t
    _grow(codes, residual, weight, rows[left], cuts, (*path, (f, False, float(cuts[f][t]))), out, step)
    _grow(codes, residual, weight, rows[~left], cuts, (*path, (f, True, float(cuts[f][t]))), out, step)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds half-way between neighbouring quantiles."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS + 1), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def _paths(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """Paths of TREES boosted trees, each over all rows."""
    cuts = [_cuts(x[:, f]) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    margin, out = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        _grow(codes, y - p, p * (1 - p), np.arange(len(y)), cuts, (), out, step)
        margin += 0.3 * step
    return list(dict.fromkeys(tuple(sorted(c)) for c in out))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    return np.all([x[:, f] > t if greater else x[:, f] <= t for f, greater, t in conditions], axis=0)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss with an L1 penalty, by accelerated proximal gradient steps; the intercept goes free."""
    n, k = z.shape
    ones = np.column_stack([z, np.ones(n)])
    rate = 4 / max(np.linalg.eigvalsh(ones.T @ ones / n)[-1], 1e-9)
    w = last = np.zeros(k + 1)
    for i in range(steps):
        v = w + i / (i + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(ones @ v, -30, 30)))
        new = v - rate * (ones.T @ (p - y) / n)
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        last, w = w, new
    return w[:k], float(w[k])


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights from statistics (in the order of NAMES) and labels 0 or 1."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], float(np.log(share / (1 - share))))
    paths = _paths(x, y)
    if not paths:
        share = y.mean()
        return RuleModel([], float(np.log(share / (1 - share))))
    z = np.column_stack([_holds(x, c) for c in paths]).astype(np.float64)
    weights, intercept = _lasso(z, y, PENALTY)
    return RuleModel([(c, float(w)) for c, w in zip(paths, weights, strict=True) if abs(w) > 1e-6], intercept)


def train(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> RuleModel:
    """Fit on about SAMPLE rows of ``labels(key, label)``; the sample is small enough to broadcast to the documents."""
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).alias("__y"))
    n = known.count()
    if n > SAMPLE:
        known = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < (SAMPLE << 20) // n)
    rows = docs.select(key, text).join(F.broadcast(known), key).select(key, "__y", *(c.alias(n) for n, c in statistics(F.col(text)).items())).toArrow()
    order = np.lexsort([rows.column(n).to_numpy() for n in NAMES] + [rows.column(key).to_numpy()])
    x = np.column_stack([rows.column(n).to_numpy() for n in NAMES])[order]
    return fit(x, rows.column("__y").to_numpy()[order].astype(np.float64))


def scored(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    names = {n: f"__stat_{n}" for n in NAMES}
    kept = [c for c in docs.columns if c != "score"]
    with_stats = docs.select(*kept, *(c.alias(names[n]) for n, c in statistics(F.col(text)).items()))
    return with_stats.select(*kept, model.score({n: F.col(c) for n, c in names.items()}).alias("score"))
