"""URL filter: host and path rules, else gradient-boosted trees on lexical features.

Features of a URL: lengths, depth, digit and hyphen shares, character entropy, parameter counts, host
labels, and statistics of its host's suffixes (the smoothed share of labelled URLs to block among those
with the same suffix, out of fold while training). The trees learn from at most MAX_TRAIN labelled
URLs, those with the least hashes; suffix statistics come from the same URLs. Both are bounded by that.

Defined cases: a null URL or one without `://` has an empty host and path and is judged on the rest of
its features; equal URLs get equal verdicts; without labelled URLs all are allowed; non-ASCII
characters count as their UTF-8 bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .runtime import ship

MAX_TRAIN = 20_000
TREES = 60
DEPTH = 4
RATE = 0.2
FOLDS = 5
#: Share of the features that a tree may use, so that no single one decides.
COLUMNS = 0.4
#: Labelled URLs weigh as many more at the common rate in a suffix's share.
PRIOR = 5.0
FEATURES = ["length", "host_length", "path_length", "depth", "digit_share", "host_digits", "hyphens", "host_hyphens", "entropy", "host_entropy", "params", "query_length", "labels", "longest_label", "suffix_rate", "suffix_labels", "top_rate"]

Rule = tuple[str, str, str]
"""(action, host, path)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
        for a, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def _suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def _entropy(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    c = np.bincount(owner * 256 + flat, minlength=n * 256).reshape(n, 256).astype(float)
    total = c.sum(axis=1)
    logs = np.log2(np.maximum(c, 1))
    return np.where(total > 0, np.log2(np.maximum(total, 1)) - (c * logs).sum(axis=1) / np.maximum(total, 1), 0.0)


def lexical(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    """All features but the statistics of suffixes, which stay 0."""
    n = len(urls)
    x = np.zeros((n, len(FEATURES)))

    def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        return np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(n), size), size

    def count(f: np.ndarray, owner: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.bincount(owner[which], minlength=n).astype(float)

    u, uo, un = flat(urls)
    h, ho, hn = flat(hosts)
    p, po, pn = flat(paths)
    at = {name: i for i, name in enumerate(FEATURES)}
    digits = lambda f: (f >= 48) & (f <= 57)
    x[:, at["length"]], x[:, at["host_length"]], x[:, at["path_length"]] = un, hn, pn
    x[:, at["depth"]] = count(p, po, p == 47)
    x[:, at["digit_share"]] = count(u, uo, digits(u)) / np.maximum(un, 1)
    x[:, at["host_digits"]] = count(h, ho, digits(h)) / np.maximum(hn, 1)
    x[:, at["hyphens"]] = count(u, uo, u == 45) / np.maximum(un, 1)
    x[:, at["host_hyphens"]] = count(h, ho, h == 45)
    x[:, at["entropy"]], x[:, at["host_entropy"]] = _entropy(u, uo, n), _entropy(h, ho, n)
    x[:, at["params"]] = count(u, uo, u == 61)
    x[:, at["query_length"]] = [len(t.partition("?")[2]) for t in urls]
    x[:, at["labels"]] = [t.count(".") + 1 if t else 0 for t in hosts]
    x[:, at["longest_label"]] = [max(map(len, t.split("."))) for t in hosts]
    return x


@dataclass
class Model:
    start: float
    grown: list[trees.Tree]
    suffixes: dict[str, tuple[float, int]]
    """suffix -> (labelled URLs to block, labelled URLs)"""
    rate: float

    def features(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        x = lexical(urls, hosts, paths)
        x[:, -3:] = suffix_features(hosts, self.suffixes, self.rate)
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for t in self.grown:
            z += RATE * t.predict(x)
        return 1 / (1 + np.exp(-z))


def suffix_features(hosts: list[str], suffixes: dict[str, tuple[float, int]], rate: float) -> np.ndarray:
    """Of the longest known suffix: its smoothed share and number of labels; then the last label's share."""
    out = np.zeros((len(hosts), 3))
    share = lambda s: (suffixes[s][0] + PRIOR * rate) / (suffixes[s][1] + PRIOR) if s in suffixes else rate
    for i, h in enumerate(hosts):
        chain = _suffixes(h)
        known = next((s for s in chain if s in suffixes), "")
        out[i] = share(known), known.count(".") + 1 if known else 0, share(chain[-1])
    return out


def fit(urls: list[str], hosts: list[str], paths: list[str], y: np.ndarray) -> Model:
    """y: 1 to block, 0 to allow."""
    rate = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(20.0 if len(y) and y.min() == 1 else -20.0, [], {}, rate)

    def table(rows: np.ndarray) -> dict[str, tuple[float, int]]:
        counts: dict[str, tuple[float, int]] = {}
        for i in rows:
            for s in _suffixes(hosts[i]):
                a, b = counts.get(s, (0.0, 0))
                counts[s] = (a + y[i], b + 1)
        return counts

    x = lexical(urls, hosts, paths)
    fold = np.array([sum(h.encode("utf-8", "surrogatepass")) % FOLDS for h in hosts])
    for k in range(FOLDS):
        rows = np.flatnonzero(fold == k)
        x[rows, -3:] = suffix_features([hosts[i] for i in rows], table(np.flatnonzero(fold != k)), rate)
    start, grown = trees.boost(x, y.astype(float), TREES, DEPTH, RATE, min_rows=max(1, min(10, len(y) // 100)), columns=COLUMNS)
    return Model(start, grown, table(np.arange(len(y))), rate)


def seed_labels(pages: DataFrame, words: list[str]) -> DataFrame:
    """url and label (1: block) by seed words among the hyphenated parts of host labels."""
    parts = F.split(host_of(F.col("url")), r"[.\-]")
    return pages.where(F.col("url").isNotNull()).select("url", F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])).cast("int").alias("label"))


def train(labelled: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """Fits on at most limit of the rows url, label."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    t = rows.orderBy(F.xxhash64("url"), "url", "label").limit(limit).toArrow()
    return fit(t.column("url").to_pylist(), t.column("host").to_pylist(), t.column("path").to_pylist(), (t.column("label").to_numpy() > 0).astype(float) if len(t) else np.empty(0))


def judge(pages: DataFrame, rules: list[Rule], model: Model, key: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict, score (the trees') of every row."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    a = pages.select(F.col(key), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    a = a.select(key, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    a = a.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("_r")).select(key, "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.action").alias("action"))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, len(b), 2000):
                p = b.slice(at, 2000)
                s = m.score(m.features(p.column("url").to_pylist(), p.column("host").to_pylist(), p.column("path").to_pylist()))
                verdict = [a or ("block" if v >= threshold else "allow") for a, v in zip(p.column("action").to_pylist(), s, strict=True)]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column("host"), p.column("path"), p.column("rule"), pa.array(verdict, pa.string()), pa.array(s)], names=[key, "host", "path", "rule", "verdict", "score"])

    return a.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, score double")
