"""Quality classifier: a sparse ensemble of rules over text statistics, scored by Spark's own columns.

Statistics are column expressions. On a bounded sample of labelled rows small trees are boosted; each path from a root to
a node is a rule, a conjunction of comparisons; a logistic model with an absolute-value penalty keeps few of them, its
penalty chosen on a part of the sample kept back. The rules left are compiled to one column expression, so scoring is a scan.

Bounds: `SAMPLE` labelled rows at most reach the driver, as numbers only; the model is RULES terms at most.

Defined results. Null or empty text: its statistics are 0, and it is scored like any other. Labels that are null or other
than 0 and 1 are not learned from; if one class alone is left, or none, the score is that class's rate, or 0.5. Of several
labels for one doc_id each counts as a row. Null ids are carried, are not held out and have no label. Repeated rows get
equal scores; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import held_out, text_of

SAMPLE, RULES = 20_000, 60
TREES, DEPTH, BINS = 24, 3, 24


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.regexp_count(text, F.lit("\n")) + 1
    share = lambda chars: F.regexp_count(text, F.lit(chars)) / n
    return {
        "log_chars": F.log1p(F.char_length(text).cast("double")),
        "upper": share("[A-Z]"),
        "digit": share("[0-9]"),
        "marks": share(r"[#$%&*+<=>@^_`|~\\{}\[\]/]"),
        "loud": share("[!?]"),
        "stops": share("[.,;:]"),
        "word_length": n / n_words,
        "distinct": F.size(F.array_distinct(words)) / n_words,
        "longest": F.coalesce(F.array_max(F.transform(words, F.char_length)), F.lit(0)).cast("double"),
        "line_words": n_words / lines,
    }


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, whether it is above, threshold) that all must hold, and the weight then added."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        tests = [F.col(s) > t if above else F.col(s) <= t for s, above, t in self.tests]
        return F.when(reduce(lambda a, b: a & b, tests), F.lit(self.weight)).otherwise(F.lit(0.0))

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {t:.6g}" for s, above, t in self.tests) + f": {self.weight:+.3f}"


@dataclass(frozen=True)
class Model:
    base: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, (r.column() for r in self.rules), F.lit(self.base))
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """Adds the paths of a tree fitted to gradients g and curvatures h to out; returns its values for rows."""
    value = lambda r: g[r].sum() / (h[r].sum() + 1.0)
    if path:
        out.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j, cut in enumerate(cuts):
            at = np.searchsorted(cut, x[rows, j], side="left")
            gs = np.cumsum(np.bincount(at, g[rows], len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(at, h[rows], len(cut) + 1))[:-1]
            ns = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            gain[(ns < 10) | (len(rows) - ns < 10)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (j, float(cut[int(np.argmax(gain))])))
    if best[1] is None:
        return np.full(len(rows), value(rows))
    j, t = best[1]
    low = x[rows, j] <= t
    got = np.empty(len(rows))
    got[low] = _tree(x, cuts, g, h, rows[low], depth - 1, (*path, (j, False, t)), out)
    got[~low] = _tree(x, cuts, g, h, rows[~low], depth - 1, (*path, (j, True, t)), out)
    return got


def tree_paths(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Distinct paths of boosted trees, as tuples of (column, above, threshold)."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    z, out = np.full(len(y), np.log(rate / (1 - rate))), []
    for _ in range(trees):
        p = _sigmoid(z)
        z += 0.3 * _tree(x, cuts, y - p, p * (1 - p), np.arange(len(y)), depth, (), out)
    return list(dict.fromkeys(out))


def fires(x: np.ndarray, path: tuple) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > t) == above for j, above, t in path])


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model with an absolute-value penalty, by accelerated proximal gradient steps."""
    n = len(y)
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, b, v, c, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    for _ in range(rounds):
        r = _sigmoid(a @ v + c) - y
        w2 = v - step * (a.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit_arrays(x: np.ndarray, y: np.ndarray, names: list[str], most: int = RULES) -> Model:
    """A model from statistics x and labels y."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(rate / (1 - rate))), ())
    paths = tree_paths(x, y)
    if not paths:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = np.stack([fires(x, p) for p in paths], axis=1).astype(float)
    mean, spread = a.mean(0), np.maximum(a.std(0), 1e-3)
    scaled = (a - mean) / spread
    back = np.arange(len(y)) % 4 == 3
    best = None
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001):
        b, w = lasso(scaled[~back], y[~back], penalty)
        if best is not None and (w != 0).sum() > most:
            break
        p = np.clip(_sigmoid(scaled[back] @ w + b), 1e-6, 1 - 1e-6)
        loss = -(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = lasso(scaled, y, best[1])
    if (w != 0).sum() > most:  # the strongest rules alone, fitted again
        kept = np.argsort(-np.abs(w), kind="stable")[:most]
        w = np.zeros(len(w))
        b, w[kept] = lasso(scaled[:, kept], y, best[1])
    rules = tuple(Rule(tuple((names[j], above, t) for j, above, t in paths[i]), float(w[i] / spread[i])) for i in np.flatnonzero(w))
    return Model(float(b - (w / spread * mean).sum()), rules)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labels (doc_id, quality) of documents that are not held out."""
    told = labels.where(F.col("quality").isin(0, 1) & ~held_out(3, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    n = told.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    told = told.withColumn("draw", draw).where(F.col("draw") <= min(1.0, 0.95 * sample / max(n, 1)))
    stats = statistics(text_of())
    rows = told.join(docs.select("doc_id", "text"), "doc_id").select("draw", "doc_id", "label", *(c.alias(k) for k, c in stats.items())).orderBy("draw", "doc_id", "label", *stats).limit(sample)
    got = rows.drop("draw", "doc_id").toArrow()
    x = np.stack([got.column(k).to_numpy() for k in stats], axis=1).astype(float) if len(got) else np.zeros((0, len(stats)))
    return fit_arrays(x, got.column("label").to_numpy().astype(float), list(stats))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text)."""
    used = {s for r in model.rules for s, _, _ in r.tests}
    rows = docs.select("doc_id", *(c.alias(k) for k, c in statistics(text_of()).items() if k in used))
    return rows.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels that are not held out and scores all of docs."""
    return predict(docs, fit(docs, labels)).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
