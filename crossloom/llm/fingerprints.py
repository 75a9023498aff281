"""Document fingerprints from improbable byte windows, in chained Bloom filters.

Every WINDOW-byte window has an entropy, quantised to LEVELS. A level's rank is its rarity over the
whole corpus (rare first). A window's popularity is how often it has the leftmost lowest rank of the
SPAN windows around it; windows that reach POPULAR are the features. Hashes of distinct features go,
in order, into Bloom filters of FILTER_BITS bits, FILTER_ITEMS features each. The likeness of two
fingerprints is the mean, over the filters of the shorter chain, of the best normalised bit overlap
in the other.

The fingerprint is text: for each filter the number of its features, a colon and its bits in base
64, joined by dots. Defined cases: a text shorter than a window is one feature as a whole; null and
empty texts have the empty fingerprint, like each other (1) and unlike all else (0); equal texts
have equal fingerprints; one row comes out for every row in. Rows of equal doc_id are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import chunks, ship, text_only, width
from .words import U, mix

WINDOW = 32
SPAN = 32
POPULAR = 8
LEVELS = 1000
FILTER_BITS = 2048
FILTER_ITEMS = 160
PROBES = 5
#: Overlap up to this share of the range from chance to full, or two standard deviations over chance, is no likeness.
CUT = 0.1
#: Rows a task digests at a time.
STEP_ROWS = 200
_BLOCK = 1 << 16
_COUNT = np.arange(WINDOW + 2, dtype=np.float64)
#: c * log2(c) in fixed point.
_CLOG = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * (1 << 20)).astype(np.int64)
_STEP = _CLOG[1:] - _CLOG[:-1]
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_WEIGHT = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, WINDOW // 8, dtype=np.uint64) * U(2) + U(1)


def _repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte occurs in the WINDOW - 1 bytes before it, and behind it."""
    before, behind = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for lo in range(0, len(x), _BLOCK):
        for d in range(1, WINDOW):
            a = max(lo, d)
            b = min(lo + _BLOCK, len(x))
            if a < b:
                same = (x[a:b] == x[a - d : b - d]).view(np.uint8)
                before[a:b] += same
                behind[a - d : b - d] += same
    return before, behind


def levels(x: np.ndarray) -> np.ndarray:
    """Quantised entropy of the window at each place (len(x) - WINDOW + 1 of them)."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int32)
    before, behind = _repeats(x)
    first = int(_CLOG[np.bincount(x[:WINDOW], minlength=256)].sum())
    w = np.empty(n, np.int64)
    w[0] = first
    if n > 1:
        # the byte that enters at s + WINDOW - 1 had `before` equals in the rest of the window, the one that left had `behind`
        np.cumsum(_STEP[before[WINDOW:]] - _STEP[behind[: n - 1]], out=w[1:])
        w[1:] += first
    most = int(_CLOG[WINDOW])
    return ((most - w) * LEVELS // (most + 1)).astype(np.int32)


def _whole(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which windows of the flat text lie within one document."""
    ok = np.ones(n, bool)
    for b in offsets[1:-1]:
        ok[max(0, b - WINDOW + 1) : b] = False
    return ok


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each level by its share of all windows of the corpus; at most LEVELS rows reach the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            for _, flat, off in chunks(b.column(0), b.column(1)):
                lv = levels(flat)
                total += np.bincount(lv[_whole(off, len(lv))], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], names=["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in text_only(docs).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    order = np.lexsort([np.arange(LEVELS + 1), counts])
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    return ranks


def features(x: np.ndarray, level: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows of one text, distinct, in order; level: of its windows."""
    if not len(x):
        return np.empty(0, U)
    n = len(x) - WINDOW + 1
    if n <= 0:
        padded = np.zeros(WINDOW, np.uint8)
        padded[: len(x)] = x
        return mix(_window_hash(padded[None, :]) + U(len(x)))
    shift = U(max(1, int(n - 1).bit_length()))
    key = (ranks[level].astype(U) << shift) | np.arange(n, dtype=U)
    span = min(SPAN, n)
    low, have = key, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    popular = np.bincount((low & ((U(1) << shift) - U(1))).astype(np.int64), minlength=n)
    chosen = np.flatnonzero(popular >= min(POPULAR, len(low)))
    if not len(chosen):
        chosen = np.array([int(np.argmax(popular))])
    h = _window_hash(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[chosen])
    _, at = np.unique(h, return_index=True)
    return h[np.sort(at)]


def _window_hash(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((mix(np.ascontiguousarray(rows).view(U)) * _WEIGHT).sum(axis=1, dtype=U))


class Digest:
    """A chain of Bloom filters: bits (filters x bytes) and the number of features in each."""

    def __init__(self, hashes: np.ndarray):
        n = -(-len(hashes) // FILTER_ITEMS)
        bits = np.zeros((n, FILTER_BITS), bool)
        if n:
            which = np.arange(len(hashes)) // FILTER_ITEMS
            for k in range(PROBES):
                bits[which, ((hashes >> U(11 * k)) & U(FILTER_BITS - 1)).astype(np.int64)] = True
        self.bits = np.packbits(bits, axis=1)
        self.items = np.bincount(np.arange(len(hashes)) // FILTER_ITEMS, minlength=n)
        self.ones = _BITS[self.bits].sum(axis=1, dtype=np.int64)

    def text(self) -> str:
        return ".".join(f"{k}:{base64.b64encode(b.tobytes()).decode()}" for k, b in zip(self.items, self.bits, strict=True))

    def likeness(self, other: Digest) -> float:
        a, b = sorted((self, other), key=lambda d: len(d.items))
        if not len(b.items):
            return 1.0
        if not len(a.items):
            return 0.0
        if np.array_equal(a.bits, b.bits):
            return 1.0
        both = _BITS[a.bits[:, None, :] & b.bits[None, :, :]].sum(axis=2, dtype=np.int64).astype(float)
        most = np.minimum(a.ones[:, None], b.ones[None, :])
        least = a.ones[:, None] * b.ones[None, :] / FILTER_BITS
        cut = least + np.maximum(CUT * (most - least), 2 * np.sqrt(least))
        score = np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0.0, 1.0)
        return float(score.max(axis=1).mean())


def digests(texts: list[str], ranks: np.ndarray) -> list[Digest]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    level, at, out = levels(flat), 0, []
    for r in raw:
        x = flat[at : at + len(r)]
        out.append(Digest(features(x, level[at : at + max(0, len(r) - WINDOW + 1)], ranks)))
        at += len(r)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""
    ranks = corpus_ranks(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), STEP_ROWS):
                part = b.slice(at, STEP_ROWS)
                out = [d.text() for d in digests(part.column(1).to_pylist(), ranks)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return text_only(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, lead: rows of a part belong together, in falling order of doc_id, then text.

    Documents are cut into ranges of doc_id. The first document of the range below (of the top range, for the
    lowest) is also dealt to a range as its last row, with lead false, so that no row needs another task's.
    Only one id for each range reaches the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "text")
    n = width(spark, 2)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    bounds = np.array(cuts, np.float64).astype(np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    parts = docs.withColumn("part", part_of("doc_id"))
    tops = sorted((r["part"], r["top"]) for r in parts.select("doc_id", "part").groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return parts.withColumns({"lead": F.lit(True)})
    halo = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]
    # as many rows as there are ranges
    guests = spark.createDataFrame(halo, "doc_id long, part int")
    first = docs.join(F.broadcast(guests), "doc_id").groupBy("doc_id", "part").agg(F.max("text").alias("text"))
    return parts.withColumn("lead", F.lit(True)).unionByName(first.select("doc_id", "text", "part", F.lit(False).alias("lead")))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    The edited text has the last floor(n / 2) code points replaced by the first as many of the next document in
    falling doc_id (after the last, the first). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null doc_id comes last in the order.
    """
    docs = text_only(docs)
    ranks = corpus_ranks(docs)
    near = _neighbours(docs)
    n = width(docs.sparkSession, 2)
    near = near.repartition(n, "part").sortWithinPartitions("part", F.desc("lead"), F.desc("doc_id"), F.desc("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for at in range(0, len(b), STEP_ROWS):
                rows = held + list(zip(*[c.to_pylist() for c in b.slice(at, STEP_ROWS).columns], strict=True))
                held = rows[-1:]
                # a text and the next one of its part
                pairs = [i for i in range(len(rows) - 1) if rows[i][3] and rows[i][2] == rows[i + 1][2]]
                halves = [len(rows[i][1]) // 2 for i in pairs]
                changed = [rows[i][1][: len(rows[i][1]) - h] + rows[i + 1][1][:h] for i, h in zip(pairs, halves, strict=True)]
                got = digests([r[1] for r in rows] + changed, ranks)
                own, edited = got[: len(rows)], got[len(rows) :]
                out = [
                    (None if rows[i][0] == -(2**63) else rows[i][0], len(rows[i][1]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), own[i].text(), e.text(), own[i].likeness(e), own[i].likeness(own[i + 1]))
                    for i, c, e in zip(pairs, changed, edited, strict=True)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return near.select("doc_id", "text", "part", "lead").mapInArrow(run, schema)
