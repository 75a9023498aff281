"""Removal of long repeated byte strings over the whole corpus, with run-length indexes of contested places.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller doc_id, or earlier in the
document). Strings are judged on the input; matches never cross documents.

1. Every window of LENGTH bytes has an anchor: its SEED-byte substring of least hash, the leftmost of equal
   ones. Windows with one anchor are neighbours; the bytes they cover are the anchor's context. Equal
   windows have equal anchors at equal places. Anchors are dealt by the hash of their bytes.
2. If an anchor's whole context occurs earlier, all its windows do: they go at once (in each task first, so that
   a text with very many copies costs a row a task). Anchors whose bytes have one context only are done.
3. What remains is contested: equal anchors in different contexts. Their contexts (one for each content)
   meet in shards, each of which builds a run-length index: the Burrows-Wheeler transform as runs, the text
   places at both ends of each run, and the length of the match between a run's head and the suffix before it.
   The suffix array serves to build it and is not kept. From these samples the index streams, in text order,
   every place's matching statistic: the suffix before it in suffix order, and how long the two match (within a
   run both follow from the sample before). Windows that match in LENGTH bytes form chains; all but the
   earliest window of a chain go. An anchor with more than PART contexts has several indexes, over all tasks, each of
   PART of its contexts; what each index leaves is the earliest window of every chain, and equal ones of
   these meet by the hash of their bytes, so that of them too all but the earliest go.

Defined cases: null and empty texts have nothing to remove; texts shorter than LENGTH stay whole; rows that
repeat a doc_id are ordered by text, and equal ones are as any copies; a null doc_id comes first; other
columns of the input are not read by ``spans`` and are kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from .runtime import blobs, chunks, compressed, materialize, pack, ship, text_only, width
from .words import U, mix, powers, prefix_hash

LENGTH = 100
SEED = 32
#: Contexts of one anchor in an index, at most.
PART = 5_000
#: Bytes of contexts in one index, unless one anchor has more.
INDEX_BYTES = 1 << 19
#: Bytes of text whose anchors are one hash range, on average.
RANGE_BYTES = 1 << 21
#: Anchors a task holds before it deals them out.
FLUSH = 200_000
#: Bytes of one document that are scanned at a time.
SLICE = 1 << 22
_TABLE = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE_BITS = U(24)
_KINDS = {"h": "u8", "c": "u8", "doc": "i8", "at": "u4", "n": "u2"}


def anchors(x: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one stretch of bytes: (hash of the anchor's bytes, hash of its context, first window, number of windows)."""
    n = len(x) - length + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    s = prefix_hash(x, _TABLE)
    _, inv = powers(len(s))
    with np.errstate(over="ignore"):
        g = mix((s[seed:] - s[:-seed]) * inv[: len(s) - seed])
        low = (g >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(g), dtype=U)
        have, span = 1, length - seed + 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        place = (low & U((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, n])
        ends = first + count + length - 1
        c = mix((s[ends] - s[first]) * inv[first] + mix((place[first] - first).astype(U) * U(1 << 20) + count.astype(U)))
    return g[place[first]], c, first, count


def _slices(x: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts of a long document such that each window lies in one."""
    for lo in range(0, max(1, len(x) - length + 1), SLICE):
        yield lo, x[lo : lo + SLICE + length - 1]


def _sorted(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort([e["at"], e["doc"], e["c"], e["h"]])
    return {k: v[order] for k, v in e.items()}


def _repeats(e: dict[str, np.ndarray]) -> np.ndarray:
    """Of sorted entries: which have the context of the one before."""
    same = np.zeros(len(e["h"]), bool)
    same[1:] = (e["h"][1:] == e["h"][:-1]) & (e["c"][1:] == e["c"][:-1])
    return same


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping and touching spans by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort([start, doc])
    doc, start, end = doc[order], start[order], end[order]
    new = np.r_[True, doc[1:] != doc[:-1]]
    # the furthest end so far within the document
    shift = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.r_[first[1:] - 1, len(doc) - 1]]


_OUT = "kind byte, doc long, start long, stop long, h long, range int, eh binary, ec binary, edoc binary, eat binary, en binary, bytes binary"
_TYPES = {"kind": pa.int8(), "range": pa.int32(), **{k: pa.binary() for k in ("eh", "ec", "edoc", "eat", "en", "bytes")}}


def _rows(kind: int | np.ndarray, n: int, **cols) -> pa.RecordBatch:
    names = [c.split()[0] for c in _OUT.split(", ")]
    data = {"kind": np.full(n, kind, np.int8)} | cols
    return pa.RecordBatch.from_arrays([pa.array(data[c], _TYPES.get(c, pa.int64())) if c in data else pa.nulls(n, _TYPES.get(c, pa.int64())) for c in names], names=names)


def _marks(doc: np.ndarray, at: np.ndarray, n: np.ndarray, length: int, ranges: int) -> pa.RecordBatch | None:
    """Kind 0: spans to remove."""
    doc, start, stop = _merge(doc.astype(np.int64), at.astype(np.int64), at.astype(np.int64) + n.astype(np.int64) + length - 1)
    return _rows(0, len(doc), doc=doc, start=start, stop=stop, range=(doc % ranges).astype(np.int32)) if len(doc) else None


def _deal(e: dict[str, np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    """Kind 2: entries sorted by h, a row for each range."""
    step = U((2**64 - 1) // ranges + 1) if ranges > 1 else U(0)
    edges = np.searchsorted(e["h"], np.arange(ranges, dtype=U) * step) if ranges > 1 else np.zeros(1, np.int64)
    ends = np.r_[edges[1:], len(e["h"])]
    for lo in range(0, ranges, 64):
        some = [k for k in range(lo, min(ranges, lo + 64)) if ends[k] > edges[k]]
        if some:
            yield _rows(2, len(some), range=np.array(some, np.int32), **{f"e{name}": [pack(e[name][edges[k] : ends[k]].astype(kind)) for k in some] for name, kind in _KINDS.items()})


class _Held:
    """Entries of a task, combined before they are dealt."""

    def __init__(self, length: int, ranges: int):
        self.length, self.ranges, self.parts, self.n = length, ranges, [], 0

    def add(self, h: np.ndarray, c: np.ndarray, doc: int, at: np.ndarray, n: np.ndarray) -> None:
        if len(h):
            self.parts.append((h, c, np.full(len(h), doc, np.int64), at, n))
            self.n += len(h)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        e = _sorted(dict(zip(_KINDS, (np.concatenate(p) for p in zip(*self.parts, strict=True)), strict=True)))
        self.parts, self.n = [], 0
        again = _repeats(e)
        if again.any() and (m := _marks(e["doc"][again], e["at"][again], e["n"][again], self.length, self.ranges)):
            yield m
        yield from _deal({k: v[~again] for k, v in e.items()}, self.ranges)


def _scan(docs: DataFrame, length: int, seed: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(length, ranges)
        for b in batches:
            for keys, flat, off in chunks(b.column(0), b.column(1), 1 << 19):
                for i, key in enumerate(keys):
                    for lo, x in _slices(flat[off[i] : off[i + 1]], length):
                        h, c, first, count = anchors(x, length, seed)
                        held.add(h, c, key, first + lo, count)
                if held.n >= FLUSH:
                    yield from held.flush()
        yield from held.flush()

    return docs.mapInArrow(run, _OUT)


def _entries(table: pa.Table) -> dict[str, np.ndarray]:
    return {name: np.concatenate(blobs(table, f"e{name}", kind)) for name, kind in _KINDS.items()}


def _meet(scan: DataFrame, length: int, ranges: int) -> DataFrame:
    """Kind 0: spans to remove; kind 1: contested anchors (start: first window, stop: number of windows); kind 4: those with several indexes, h then names one of them."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds == 0))]
        mine = table.filter(pa.array(kinds == 2))
        if len(mine):
            e = _sorted(_entries(mine))
            again = _repeats(e)
            if again.any() and (m := _marks(e["doc"][again], e["at"][again], e["n"][again], length, ranges)):
                out.append(pa.Table.from_batches([m]))
            e = {k: v[~again] for k, v in e.items()}
            del mine
            first = np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]])
            size = np.diff(np.r_[first, len(e["h"])])
            rank, size = np.arange(len(e["h"])) - np.repeat(first, size), np.repeat(size, size)
            several = size > PART
            e["h"] = np.where(several, mix(e["h"] ^ mix((rank // PART + 1).astype(U))), e["h"])
            for kind, at in ((1, (size > 1) & ~several), (4, several)):
                if at.any():
                    out.append(pa.Table.from_batches([_rows(kind, int(at.sum()), doc=e["doc"][at], start=e["at"][at], stop=e["n"][at], h=e["h"][at].view(np.int64), range=(e["doc"][at] % ranges).astype(np.int32))]))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return scan.repartition(max(1, ranges // 2), "range").groupBy("range").applyInArrow(run, _OUT)


def _fetch(texts: DataFrame, asked: DataFrame, length: int, ranges: int) -> DataFrame:
    """Bytes of contested contexts, by the range of h. Kind 3: all of an anchor; kind 5: of an anchor with several indexes."""
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "h", "kind")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        step = (2**64 - 1) // ranges + 1
        for batch in batches:
            for lo in range(0, len(batch), 500):
                b = batch.slice(lo, 500)
                asked = b.column("asked")
                rows = asked.flatten()
                start, count, h, kind = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                ends = np.cumsum(pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))
                got: dict[tuple[int, int], list] = {}
                at = 0
                for doc, z, to in zip(b.column("doc").to_pylist(), b.column("z"), ends.tolist(), strict=True):
                    x = unpack.decompress(z.as_py())
                    for i in range(at, to):
                        first, n = int(start[i]), int(count[i])
                        at_range = (int(h[i]) % 2**64) // step
                        got.setdefault((5 if kind[i] == 4 else 3, at_range), []).append((doc, first, n, int(h[i]), x[first : first + n + length - 1]))
                    at = to
                if got:
                    cols = {"range": [], "edoc": [], "eat": [], "en": [], "eh": [], "bytes": []}
                    for (_, k), parts in got.items():
                        d, a, n, e, p = zip(*parts, strict=True)
                        for name, value in zip(cols, (k, pack(np.array(d, "i8")), pack(np.array(a, "u4")), pack(np.array(n, "u2")), pack(np.array(e, "i8")), b"".join(p)), strict=True):
                            cols[name].append(value)
                    yield _rows(np.array([k for k, _ in got], np.int8), len(got), **cols)

    # joined alike at any size: a broadcast of what is asked would not last
    return texts.join(wanted.hint("merge"), "doc").mapInArrow(run, _OUT)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text with samples at the ends of its runs.

    run_byte, run_start: byte (-1: before the text's begin) and first row of each run. sample: text places of the
    run heads, rising; sample_before and sample_match: the suffix in the row before the head (the end of the run
    before; -1: none) and the length of its match with the head's.
    """

    def __init__(self, text: np.ndarray):
        self.length = n = len(text)
        sa = self._suffixes(text)
        before = np.where(sa > 0, text[sa - 1].astype(np.int16), -1)
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if n else np.empty(0, np.int64)
        self.run_byte, self.run_start, self.last_byte = before[heads], heads, int(text[-1]) if n else -1
        first, last = sa[heads], sa[np.r_[heads[1:], n] - 1] if n else heads
        neighbour = np.r_[-1, last[:-1]] if n else first
        match = np.zeros(len(first), np.int64)
        match[1:] = self._match(text, first[1:], neighbour[1:])
        order = np.argsort(first)
        self.sample, self.sample_before, self.sample_match = first[order], neighbour[order], match[order]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling from eight bytes on."""
        n = len(text)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = text
        key = np.zeros(n, U)
        for k in range(8):
            key = (key << U(8)) | padded[k : k + n]
        have = 8
        while True:
            order = np.argsort(key)
            ordered = key[order]
            new = np.zeros(n, np.int64)
            new[1:] = ordered[1:] != ordered[:-1]
            ranks = np.cumsum(new)
            if not n or ranks[-1] == n - 1 or have >= n:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = ranks
            follow = np.zeros(n, np.int64)
            follow[: n - have] = rank[have:] + 1
            key = rank.astype(U) * U(n + 1) + follow.astype(U)
            have *= 2

    @staticmethod
    def _match(text: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 128) -> np.ndarray:
        """How many bytes the suffixes at a and b share."""
        n, out = len(text), np.zeros(len(a), np.int64)
        padded = np.zeros(n + step, np.uint8)
        padded[:n] = text
        rows = np.lib.stride_tricks.sliding_window_view(padded, step)
        for lo in range(0, len(a), 1 << 15):
            x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
            far, going, left = np.zeros(len(x), np.int64), np.arange(len(x)), n - np.maximum(x, y)
            while len(going):
                differ = rows[x[going] + far[going]] != rows[y[going] + far[going]]
                ends = differ.any(axis=1)
                far[going] += np.where(ends, differ.argmax(axis=1), step)
                going = going[~ends & (far[going] < left[going])]
            out[lo : lo + (1 << 15)] = np.minimum(far, left)
        return out

    def statistics(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the text places lo to hi - 1: the suffix before each in suffix order, and the length of their match."""
        place = np.arange(lo, hi)
        k = np.searchsorted(self.sample, place, "right") - 1
        past = place - self.sample[k]
        none = self.sample_before[k] < 0
        return np.where(none, -1, self.sample_before[k] + past), np.where(none, 0, np.maximum(self.sample_match[k] - past, 0))

    def back(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte before each row's suffix, or -1; row of the suffix that begins with it): the index walked backwards."""
        size = np.diff(np.r_[self.run_start, self.length])
        by = np.lexsort([self.run_start, self.run_byte])
        target = np.empty(len(by), np.int64)
        # the rows lack the empty suffix, before which the last byte stands
        target[by] = np.cumsum(size[by]) - size[by] - (self.run_byte[by] < self.last_byte)
        k = np.searchsorted(self.run_start, rows, "right") - 1
        return self.run_byte[k], target[k] + rows - self.run_start[k]


def later_windows(parts: list[bytes], length: int, piece: int = 1 << 16) -> np.ndarray:
    """Which windows of the parts (in their order, all of each) equal an earlier one."""
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.full(int(sizes.sum()) + len(parts), 0xFF, np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8)
    index = RunLengthIndex(text)
    # each place points to the equal window before it in suffix order, the first of them to itself
    lead = np.arange(len(text))
    for lo in range(0, len(text), piece):
        before, match = index.statistics(lo, min(len(text), lo + piece))
        some = np.flatnonzero(match >= length)
        lead[lo + some] = before[some]
    while True:
        far = lead[lead]
        if (far == lead).all():
            break
        lead = far
    n = np.maximum(sizes - length + 1, 0)
    windows = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    lead = lead[windows]
    least = np.full(len(text), len(text))
    np.minimum.at(least, lead, windows)
    return windows > least[lead]


def _settle(fetched: DataFrame, length: int, ranges: int) -> DataFrame:
    """Kind 0: spans to remove among contested contexts; kind 2: windows that an index left of an anchor with several, by the hash of their bytes."""

    def run(mine: pa.Table) -> pa.Table:
        out = [_rows(0, 0)]
        lists = [blobs(mine, k, t) for k, t in (("edoc", "i8"), ("eat", "u4"), ("en", "u2"), ("eh", "i8"))]
        doc, at, n, h = (np.concatenate(x).astype(np.int64) for x in lists)
        several = np.repeat(mine.column("kind").to_numpy() == 5, [len(x) for x in lists[0]])
        raw = b"".join(mine.column("bytes").to_pylist())
        size = n + length - 1
        start = np.cumsum(size) - size
        order = np.lexsort([at, doc, h])
        # all contexts of an index's anchors, about INDEX_BYTES at a time
        heads = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        share = np.cumsum(size[order])[np.r_[heads[1:], len(order)] - 1] // INDEX_BYTES
        cuts = np.r_[heads[np.flatnonzero(np.r_[True, share[1:] != share[:-1]])], len(order)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[lo:hi]
            some = some[np.lexsort([at[some], doc[some]])]
            parts = [raw[start[i] : start[i] + size[i]] for i in some]
            later = later_windows(parts, length)
            windows = n[some]
            past = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            where, owner = np.repeat(at[some], windows) + past, np.repeat(doc[some], windows)
            if later.any() and (m := _marks(owner[later], where[later], np.ones(int(later.sum()), np.int64), length, ranges)):
                out.append(m)
            left = ~later & np.repeat(several[some], windows)
            if left.any():
                s = prefix_hash(np.frombuffer(b"".join(parts), np.uint8), _TABLE)
                _, inv = powers(len(s))
                place = (np.repeat(np.cumsum(size[some]) - size[some], windows) + past)[left]
                with np.errstate(over="ignore"):
                    w = (s[place + length] - s[place]) * inv[place]
                    e = {"h": mix(w ^ U(0x2545F4914F6CDD1D)), "c": mix(w), "doc": owner[left], "at": where[left], "n": np.ones(int(left.sum()), np.int64)}
                out.extend(_deal(_sorted(e), ranges))
        return pa.Table.from_batches(out)

    return fetched.repartition(max(1, ranges // 2), "range").groupBy("range").applyInArrow(run, _OUT)


def _across(left: DataFrame, length: int, ranges: int) -> DataFrame:
    """Kind 0: spans to remove among the windows that the indexes of one anchor left."""

    def run(table: pa.Table) -> pa.Table:
        e = _sorted(_entries(table))
        again = _repeats(e)
        return pa.Table.from_batches([_marks(e["doc"][again], e["at"][again], e["n"][again], length, ranges) or _rows(0, 0)])

    return left.repartition(max(1, ranges // 2), "range").groupBy("range").applyInArrow(run, _OUT)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Adds doc (long), unique and in the order of doc_id, to rows with doc_id and text; and whether doc is doc_id."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL OR doc_id < 0")
    if odd.isEmpty():
        return docs.withColumn("doc", F.col("doc_id")), True
    return materialize(docs.orderBy("doc_id", "text").withColumn("doc", F.monotonically_increasing_id()), "keyed"), False


def _removed(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """doc, z (compressed text) and further columns of every row, with its spans to remove (list of start, stop; null: none)."""
    spark = docs.sparkSession
    ship(spark)
    # tasks and their shares stay of one size as the corpus grows
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    ranges = max(width(spark, 2), int(size) // RANGE_BYTES)
    met = materialize(_meet(_scan(docs.select("doc", "text"), length, seed, ranges), length, ranges), "met")

    bare = compressed(docs.select("doc", "text"))
    settled = materialize(_settle(_fetch(bare, met.where("kind IN (1, 4)"), length, ranges), length, ranges), "settled")
    marks = met.where("kind = 0").unionByName(settled.where("kind = 0")).unionByName(_across(settled.where("kind = 2"), length, ranges))
    spans = marks.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    texts = compressed(docs.select("doc", "text", *[c for c in docs.columns if c not in ("doc", "text", "doc_id")]))
    return texts.join(spans.hint("merge"), "doc", "left")


def cut(x: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    kept, at, n = [], 0, 0
    stop = -1
    for a, b in spans:
        if a > stop:
            kept.append(x[at:a])
            n += 1
        stop = max(stop, b)
        at = stop
    kept.append(x[at:])
    rest = b"".join(kept)
    return rest, len(x) - len(rest), n


def _apply(removed: DataFrame, made: dict[str, DataType], row: Callable[..., tuple]) -> DataFrame:
    """doc, what row(text, rest, bytes removed, runs removed) makes of it, and the further columns of removed."""
    others = [f for f in removed.schema if f.name not in ("doc", "z", "spans")]
    names = ["doc", *made, *[f.name for f in others]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, len(b), 500):
                p = b.slice(at, 500)
                out = []
                for doc, z, spans in zip(p.column("doc").to_pylist(), p.column("z").to_pylist(), p.column("spans").to_pylist(), strict=True):
                    x = unpack.decompress(z)
                    out.append((doc, *row(x, *cut(x, [(s["start"], s["stop"]) for s in spans or ()]))))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], *[p.column(f.name) for f in others]], names=names)

    return removed.mapInArrow(run, StructType([StructField("doc", LongType()), *[StructField(c, t) for c, t in made.items()], *others]))


def spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    keyed, plain = _keyed(text_only(docs))
    made = {"n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType(), "kept_sha256": StringType()}
    out = _apply(_removed(keyed.select("doc", "text"), length, seed), made, lambda x, rest, gone, n: (len(x), gone, n, hashlib.sha256(rest).hexdigest()))
    return out.withColumnRenamed("doc", "doc_id") if plain else keyed.select("doc_id", "doc").join(out, "doc").drop("doc")


def clean(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with text and n_chars (if there) of what is left; code points that lose a byte go as a whole."""
    keep = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("text", "n_chars")}
    # the other columns go where the text goes, under names that meet no other
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`").alias(k) for c, k in keep.items()]).alias("_others"))
    out = _apply(_removed(_keyed(rows)[0], length, seed), {"_text": StringType()}, lambda x, rest, gone, n: (rest.decode("utf-8", "ignore"),))
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"_others.{keep[c]}").cast("long" if c == "doc_id" else docs.schema[c].dataType).alias(c) for c in docs.columns])


def oracle(length: int = LENGTH) -> str:
    """The same in DuckDB SQL, over every window of every text as hexadecimal digits."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM t WHERE length(h) >= {2 * length})),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {length}, true)::INT AS new FROM later)) GROUP BY doc_id, r),
cuts AS (SELECT doc_id, list({{a: a, b: b}} ORDER BY a) AS c FROM runs GROUP BY doc_id),
kept AS (SELECT t.doc_id, h, c, CASE WHEN c IS NULL THEN h ELSE array_to_string(list_concat([substr(h, 1, 2 * c[1].a)], list_transform(range(1, len(c) + 1), lambda k: substr(h, 2 * c[k].b + 1, 2 * (coalesce(c[k + 1].a, length(h) // 2) - c[k].b)))), '') END AS rest FROM t LEFT JOIN cuts USING (doc_id))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, ((length(h) - length(rest)) // 2)::BIGINT AS n_removed, coalesce(len(c), 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""
