"""Quality classifier: a sparse rule ensemble, compiled into Spark column expressions.

Paths of small boosted trees over text statistics become conjunctive rules. A logistic model with a lasso
penalty over the rules (proximal gradient steps) keeps a few of them; the penalty is the strongest
within TOLERANCE of the best loss on rows kept out. The score is a column expression: the sum of the
weights of the rules that hold, under a logistic function. The model learns from at most MAX_TRAIN
labelled rows, those with the least hashes of doc_id; that is the only bound.

Defined cases: null texts count as empty, and empty texts get a score; without labelled rows the score is
0.5 for all; a doc_id that has several labels counts as good only if all of them say so; repeated rows
each get the score; columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees

MAX_TRAIN = 20_000
TREES = 24
DEPTH = 3
TOLERANCE = 0.003
THRESHOLD = 0.3
FEATURES = ["n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share", "exclaim_share", "accent_share", "line_words", "distinct_share"]
SPACES = r"[\x20\x09-\x0D]+"


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the statistics of FEATURES, as doubles."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a = docs.select(*keep, text.alias("_text")).withColumn("_words", F.filter(F.split("_text", SPACES), lambda x: x != ""))
    a = a.select(*keep, "_text", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_distinct"), F.array_join("_words", "").alias("_solid"))
    solid = F.greatest(F.length("_solid"), F.lit(1))
    share = lambda pattern: (F.length("_solid") - F.length(F.regexp_replace("_solid", pattern, ""))).cast("double") / solid
    n = F.greatest(F.col("_n"), F.lit(1))
    lines = F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1
    return a.select(
        *keep,
        F.col("_n").cast("double").alias("n_words"),
        (F.length("_solid").cast("double") / n).alias("mean_word"),
        share(r"[#*$%&|<>]").alias("symbol_share"),
        share(r"\p{Lu}").alias("upper_share"),
        share(r"[0-9]").alias("digit_share"),
        share(r"[.,;:?]").alias("mark_share"),
        share(r"!").alias("exclaim_share"),
        ((F.octet_length("_solid") - F.length("_solid")).cast("double") / solid).alias("accent_share"),
        (F.col("_n").cast("double") / lines).alias("line_words"),
        (F.col("_distinct").cast("double") / n).alias("distinct_share"),
    )


@dataclass
class Rules:
    bias: float
    rules: list[list[tuple[int, bool, float]]]
    weights: list[float]

    def score(self) -> Column:
        """The score as a column over FEATURES."""
        terms = [F.lit(self.bias)]
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = reduce(lambda a, b: a & b, [F.col(FEATURES[f]) <= t if low else F.col(FEATURES[f]) > t for f, low, t in rule])
            terms.append(F.when(holds, F.lit(w)).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.rules:
            z += holds(self.rules, x) @ np.array(self.weights)
        return 1 / (1 + np.exp(-z))


def holds(rules: list[list[tuple[int, bool, float]]], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, low, t in rule:
            out[:, k] *= (x[:, f] <= t) if low else (x[:, f] > t)
    return out


def _simplify(path: list[tuple[int, bool, float]]) -> tuple[tuple[int, bool, float], ...]:
    """One bound at most for each side of a feature."""
    low: dict[tuple[int, bool], float] = {}
    for f, below, t in path:
        had = low.get((f, below))
        low[f, below] = t if had is None else (min if below else max)(had, t)
    return tuple(sorted((f, below, t) for (f, below), t in low.items()))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under penalty * sum |w|, by accelerated proximal gradient steps; the bias is free."""
    n, k = r.shape
    mean = r.mean(axis=0)
    c = r - mean
    size = 0.25 * (np.linalg.norm(c, 2) ** 2 / n + 1)
    w = v = np.zeros(k)
    b = vb = float(np.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(y.mean(), 1e-3, 1 - 1e-3))))
    t = 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(c @ v + vb))) - y
        step = v - c.T @ e / n / size
        nw = np.sign(step) * np.maximum(np.abs(step) - penalty / size, 0)
        nb = vb - float(e.mean()) / size
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b - float(mean @ w), w


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Trees, their rules and lasso weights from rows of FEATURES and labels 0 or 1."""
    if not len(y):
        return Rules(0.0, [], [])
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(p / (1 - p))), [], [])
    out = np.arange(len(y)) % 5 == 0 if len(y) >= 100 else np.zeros(len(y), bool)
    _, grown = trees.boost(x[~out], y[~out], TREES, DEPTH, 0.3, min_rows=max(2, min(20, len(y) // 50)))
    rules = [list(p) for p in sorted({_simplify(p) for t in grown for p in t.paths()})]
    r = holds(rules, x)
    _, at = np.unique(r, axis=1, return_index=True)
    rules, r = [rules[i] for i in sorted(at)], r[:, sorted(at)]
    check = out if out.any() else ~out

    def loss(b: float, w: np.ndarray) -> float:
        z = r[check] @ w + b
        return float((np.logaddexp(0, z) - y[check] * z).mean())

    path = [(pen, *lasso(r[~out], y[~out], pen)) for pen in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)]
    losses = [loss(b, w) for _, b, w in path]
    pen = next(p for (p, _, _), v in zip(path, losses, strict=True) if v <= min(losses) + TOLERANCE)
    b, w = lasso(r, y, pen, 800)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules(float(b), [rules[i] for i in kept], [float(w[i]) for i in kept])


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Rules:
    """Fits on at most limit labelled documents; labels: doc_id, quality."""
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # at most `limit` short rows
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    t = features(known, ["doc_id", "_y"]).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(2 * limit).toArrow()
    x = np.column_stack([t.column(c).to_numpy() for c in FEATURES]) if len(t) else np.empty((0, len(FEATURES)))
    return fit(x, (t.column("_y").to_numpy() > 0).astype(float) if len(t) else np.empty(0))


def score(docs: DataFrame, model: Rules, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id unless said), score and predicted of every row."""
    keep = keep or ["doc_id"]
    scored = features(docs, keep).select(*keep, model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Rules) -> DataFrame:
    """The rows of docs, all columns as they are, that score THRESHOLD or more."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    scored = features(rows, ["_doc"]).select("_doc", model.score().alias("score"))
    # a filter would be pushed below the score and repeat the statistics for every rule; rows that explode to nothing are not
    return scored.select(F.explode(F.when(F.col("score") >= THRESHOLD, F.array("_doc"))).alias("_doc")).select("_doc.*")
