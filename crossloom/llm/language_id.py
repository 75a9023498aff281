"""Language identification: averaged hashed subword embeddings under a linear softmax.

Letters are lower-cased (A-Z) bytes; digits, punctuation and white space separate words. The subwords
of a text are all runs of 2, 3 and 4 bytes inside or at the edge of words, hashed into BUCKETS. The
mean of their embeddings goes into a linear softmax. Both are trained by stochastic gradient descent in
numpy on at most MAX_TRAIN labelled texts (those with the least hashes of doc_id, whole texts), the only
bound here. A temperature fitted on texts kept out of the descent calibrates the scores, and the score
below which REJECT of those texts fall is the rejection threshold.

Defined cases: a text that is null or has no letter gets `und`, score 0 and rejected; without any labelled
text everything does; rows with a null language or text teach nothing; repeated rows are repeated examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import chunks, ship
from .words import LOWER, U

BUCKETS = 1 << 15
DIM = 16
SIZES = (2, 3, 4)
MAX_TRAIN = 4000
EPOCHS = 6
REJECT = 0.01
UNDETERMINED = "und"
_MULTIPLIER = {2: U(0x9E3779B97F4A7C15), 3: U(0xC2B2AE3D27D4EB4F), 4: U(0x165667B19E3779F9)}
#: ASCII letters and bytes of longer characters stay; all else is a word's edge.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_CLASS = _CLASS[LOWER]


def subwords(flat: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: (buckets of all subwords, where each document's begin and end)."""
    # an edge on either side of every document
    at = np.arange(len(offsets))
    x = np.full(len(flat) + len(at), 32, np.uint8)
    keep = np.ones(len(x), bool)
    keep[offsets + at] = False
    x[keep] = _CLASS[flat]
    starts = offsets + at
    edge = x == 32
    found = []
    wide = x.astype(U)
    for n in SIZES:
        m = len(x) - n + 1
        if m <= 0:
            continue
        code, inner = np.zeros(m, U), np.zeros(m, bool)
        for k in range(n):
            code = (code << U(8)) | wide[k : k + m]
            if 0 < k < n - 1:
                inner |= edge[k : k + m]
        if n == 2:
            inner = edge[:m] & edge[1:]
        else:
            inner |= edge[:m] & edge[n - 1 :] & (n == 3)
        # a run may begin or end with an edge, not hold one inside
        good = np.flatnonzero(~inner)
        with np.errstate(over="ignore"):
            buckets = ((code[good] * _MULTIPLIER[n]) >> U(64 - 15)).astype(np.int64)
        found.append((buckets, np.searchsorted(good, starts)))
    return found


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    """BUCKETS x languages: embeddings times softmax weights."""
    bias: np.ndarray
    temperature: float
    threshold: float

    def __post_init__(self) -> None:
        self.columns = [np.ascontiguousarray(self.table[:, j]) for j in range(len(self.languages))]

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, a row for each document."""
        sums, total = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1, np.int64)
        for b, cut in subwords(flat, offsets):
            n = np.diff(cut)
            some = np.flatnonzero(n)
            total += n
            if len(some):
                for j in range(len(self.languages)):
                    sums[some, j] += np.add.reduceat(self.columns[j][b], cut[some])
        z = (sums / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Model | None:
    """Trains on whole texts; None without labels."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(v) for v in labels])
    docs = []
    for t in texts:
        x = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        b = np.concatenate([b for b, _ in subwords(x, np.array([0, len(x)]))] or [np.empty(0, np.int64)])
        docs.append(np.unique(b, return_counts=True))
    rng = np.random.Generator(np.random.PCG64(seed))
    k = len(languages)
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    usable = [i for i in range(len(docs)) if len(docs[i][0])]
    kept_out = set(usable[::5]) if len(usable) >= 50 else set()
    train = np.array([i for i in usable if i not in kept_out], np.int64)
    steps, done = max(1, EPOCHS * len(train)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            lr = 0.5 * (1 - done / steps) + 0.01
            done += 1
            ids, n = docs[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # the mean divides by the text's length; the step makes up for it
            emb[ids] -= (lr * min(len(ids), 50)) * share[:, None] * back[None, :]
    model = Model(languages, (emb @ out).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    check = sorted(kept_out) or usable
    if check:
        z = np.array([(docs[i][1] / docs[i][1].sum()) @ model.table[docs[i][0]] + model.bias for i in check])
        want = y[check]

        def loss(t: float) -> float:
            s = z / t
            top = s.max(axis=1)
            return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(check)), want]).mean())

        model.temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        model.threshold = float(np.quantile((p / p.sum(axis=1, keepdims=True)).max(axis=1), REJECT))
    return model


def training_rows(docs: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """At most limit texts with a language, those with the least hash of doc_id."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(ids.distinct()), "doc_id").select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text")).limit(limit)


def train(docs: DataFrame, limit: int = MAX_TRAIN) -> Model | None:
    rows = training_rows(docs, limit).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = 0
            letters = np.array([t is not None and _has_letter(t) for t in b.column(1).to_pylist()], bool)
            for keys, flat, off in chunks(b.column(0), b.column(1)):
                n, ok = len(keys), letters[at : at + len(keys)]
                if m is None:
                    pred, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                else:
                    p = m.scores(flat, off)
                    pred = np.where(ok, np.array(m.languages, object)[p.argmax(axis=1)], UNDETERMINED)
                    score = np.where(ok, p.max(axis=1), 0.0)
                least = m.threshold if m else 0.0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array((pred == UNDETERMINED) | (score < least))], names=["doc_id", "lang_pred", "score", "rejected"])
                at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
