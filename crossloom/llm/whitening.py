"""PCA whitening of embedding tables by Chan's pairwise merging of moments.

Entries become whole numbers, x = floor(SCALE * c) + SHIFT. Each task has the count, the exact sums and the scatter
about its own mean of its vectors, batch by batch; treeReduce merges them pairwise, in which the scatter of two parts is
the sum of theirs and of n1 * n2 / (n1 + n2) times the product of the difference of their means with itself. So
nothing is squared before it is centred, however far the entries lie from zero. The driver has one matrix of
the vectors' width and takes its eigenvectors; a second pass whitens all vectors, merges their moments the
same way and says how far their covariance is from the identity.

Defined cases: rows whose vector is null, or has a null, NaN or infinite entry, are dropped, and so are vectors of
another length than the commonest one (of equally common lengths, the longest); rows that repeat a vec_id and rows with a null
one are each answered on their own and count in the fit; a component whose variance is below RANK times the first one's
(copies, constant entries, fewer vectors than entries) has no direction in double precision and is not returned, so a table of equal
vectors gives no rows; an empty table gives an empty result; a deviation beyond a long is null; an entry whose x
is beyond 2 ** 52 is an error, as it is no exact whole number in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
RANK = 1e-10
#: Parts that meet in one step of treeReduce, about.
FAN_IN = 16
_EXACT = 2.0**52


@dataclass
class Moments:
    """Count, sums and centred scatter of vectors."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    def mean(self, base: np.ndarray) -> np.ndarray:
        """Less base: whole numbers near the mean leave a small rest, which keeps its digits."""
        return (self.sums - base * self.n) / self.n

    @property
    def base(self) -> np.ndarray:
        return self.sums // self.n

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        own = cls(len(x), x.sum(axis=0), np.empty(0))
        d = (x - own.base) - own.mean(own.base)
        return cls(own.n, own.sums, d.T @ d)

    def merge(self, other: Moments) -> Moments:
        apart, n = other.mean(self.base) - self.mean(self.base), self.n + other.n
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(the key and v: the vector as doubles, of all rows that count; the vectors' length)."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    width = common["k"] if common else 0
    return rows.where(F.size("v") == width), width


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of each batch that has rows."""
    for b in batches:
        if b.num_rows and width:
            y = np.floor(SCALE * b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            if np.abs(y).max() > _EXACT - SHIFT:
                raise ValueError("an entry is too large for an exact whole number")
            yield b.column(0), y.astype(np.int64) + SHIFT


def moments(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments | None:
    """Of all rows' x, or of what the function of makes of a batch of them; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, x in _matrices(batches, width):
            m = Moments.of(of(x) if of else x)
            own = own.merge(m) if own else m
        if own:
            yield pa.RecordBatch.from_pydict({"n": pa.array([own.n], pa.int64()), "sums": [own.sums.tobytes()], "scatter": [own.scatter.tobytes()]})

    kind = np.float64 if of else np.int64

    def read(row) -> Moments:
        sums = np.frombuffer(row["sums"], kind)
        return Moments(row["n"], sums, np.frombuffer(row["scatter"]).reshape(len(sums), -1))

    parts = rows.select("vec_id", "v").mapInArrow(run, "n long, sums binary, scatter binary").rdd.map(lambda r: [read(r)])
    tasks = parts.getNumPartitions()
    if not tasks:
        return None
    # a table without rows leaves all tasks empty-handed: the empty list stands for them
    got = parts.union(rows.sparkSession.sparkContext.parallelize([[]], 1)).treeReduce(lambda a, b: [a[0].merge(b[0])] if a and b else a or b, max(2, math.ceil(math.log(tasks + 1, FAN_IN))))
    return got[0] if got else None


@dataclass
class Whitening:
    """What the fit has found: count, exact sums, eigenvalues (falling) and their unit eigenvectors as columns, the trace, and the length of the vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.from_mean(x) / self.n) @ (self.vectors / np.sqrt(self.values))


def solve(m: Moments, components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance; the sign makes each one's largest entry positive."""
    cov = m.scatter / m.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero((values > 0) & (values > RANK * values[0]))[:components]
    values, vectors = values[keep], vectors[:, keep]
    top = np.abs(vectors).argmax(axis=0)
    return Whitening(m.n, m.sums, values, vectors * np.sign(vectors[top, np.arange(len(keep))]), float(np.trace(cov)))


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows from usable; None without rows."""
    m = moments(rows, width)
    return solve(m, components) if m else None


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    m = moments(rows, width, model.whitened)
    return float(np.abs(m.scatter / m.n - np.eye(len(model.values))).max()) if m and len(model.values) else 0.0


def deviations(away: np.ndarray) -> pa.Array:
    """Exact sums of squares of the rows; null beyond a long."""
    out = list((away * away).sum(axis=1))
    for i in np.flatnonzero((away.astype(np.float64) ** 2).sum(axis=1) > 2.0**62):
        exact = sum(int(a) ** 2 for a in away[i])
        out[i] = exact if exact < 2**63 else None
    return pa.array(out, pa.int64())


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row and component."""
    spark = table.sparkSession
    ship(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, width = usable(table, key, vector)
    model = fit(rows, width, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error, shared = identity_error(rows, width, model), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, explained = len(m.values), m.values / m.trace
        for ids, x in _matrices(batches, width):
            at = pa.array(np.repeat(np.arange(len(x)), k))
            n = len(at)
            cols = [ids.take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(n, m.n), deviations(m.from_mean(x)).take(at), m.whitened(x).ravel(), np.tile(explained, len(x)), np.full(n, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
