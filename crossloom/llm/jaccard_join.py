"""N-gram Jaccard join by token groups, exact, with connected components.

Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of word shingles.

1. Documents with equal sets are one class; a class is known by a 128-bit hash of its set.
2. Reaching groups. For sizes up to `top`, linked sets differ in at most d shingles. Hash space is cut into
   more than d parts, so linked sets agree on the whole content of some part. A class whose set leaves too
   many parts empty also reports its empty parts. Classes that share the content of a part are a run. Within
   a run, classes stay apart if their sizes or their counts of shingles in COUNTERS hash buckets prove more
   than d differences; what stays together is joined into a group. A long run within one task is joined
   there and sent on as one node with the ranges of its members' sizes and counts, so a content that very many
   documents share costs a few rows a task. Runs of more than CHUNK nodes are dealt over tasks in chunks;
   what stays together in a chunk is one node of the next turn, until a run is one chunk.
3. Token-group matrix. Members of a group are read in turn; each known component keeps the union of its
   tokens; the overlap of a member with that union bounds its overlap with every document of the
   component, and only components whose bound qualifies are opened and compared.
   Groups of more than MAX_TOKENS are cut into blocks; their components' first documents are
   compared over the blocks again until one block holds them. What then is not yet in the group's largest
   component is compared with other blocks of its group: those whose token union has one of its rarest tokens, of
   which it has one more than it may lack, so that no block that qualifies is left out.
4. Links give components (alternating large-star and small-star steps over ids only).

Sets are compared as 64-bit shingle hashes. Defined cases: null, empty and blank texts have an empty set
and link with nothing; a text with fewer words than a shingle is one shingle as a whole; rows that repeat a
doc_id are one document to the components and rows of their own in the result; a null doc_id counts as -1; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import blobs, chunks, compressed, expanded, materialize, pack, ship, text_only, width
from .words import U, mix, shingle_hashes, words

#: Shingles and sets in a block of a group, at most (but for one set with more).
MAX_TOKENS = 400_000
BLOCK_SETS = 512
#: Signatures a task holds before it deals them out.
FLUSH = 1_500_000
#: Least and most buckets in which a set's shingles are counted; about one for every eight shingles.
COUNTERS = (64, 4096)
#: Longer runs within a task become a node for each part of them that stays together.
LOCAL_RUN = 64
#: Nodes of a run that one task tells apart at a time.
CHUNK = 512
#: Documents in a block of components' first documents, at most.
HEADS = 256
#: Nodes that a step of the components broadcasts, at most: each has more than one in so many of all edges' ends.
CENTRES = 10_000


class Bounds:
    """What a share of percent/100 implies for sizes and differences."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must lie in (0, 100]")
        self.percent = percent
        self.tops = [1]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // percent))

    def level(self, n: int) -> int:
        """Index of the size class of n."""
        return int(np.searchsorted(self.tops, n))

    def differ(self, a: int, b: int) -> int:
        """Most elements in which linked sets of sizes a and b can differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def parts(self, level: int) -> int:
        d = self.differ(self.tops[level], self.tops[level])
        return d + 1 + (d // 16 + 1 if d else 0)

    def linked(self, both: np.ndarray | int, a: int, b: np.ndarray | int) -> np.ndarray | bool:
        return 100 * both >= self.percent * (a + b - both)


def signatures(s: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Hashes of the contents of parts of the sorted set s, at its own size class and the next."""
    n, out = len(s), []
    own = bounds.level(n)
    for level in (own, own + 1):
        top, m = bounds.tops[level], bounds.parts(level)
        seed = U((level << 40) & (2**64 - 1))
        if m == 1:
            starts, part = np.zeros(1, np.int64), np.zeros(1, U)
        else:
            step = (2**64 - 1) // m + 1
            edges = np.searchsorted(s, np.arange(1, m, dtype=U) * U(step))
            at = np.r_[0, edges]
            filled = np.diff(np.r_[at, n]) > 0
            starts, part = at[filled], np.flatnonzero(filled).astype(U)
        sums = np.add.reduceat(mix(s), starts)
        size = np.diff(np.r_[starts, n]).astype(U)
        with np.errstate(over="ignore"):
            out.append(mix(sums + mix(part + seed) + size * U(0xD6E8FEB86659FD93)))
            if len(part) <= bounds.differ(n, min(top, n * 100 // bounds.percent)):
                empty = np.setdiff1d(np.arange(m, dtype=U), part)
                out.append(mix(mix(empty + seed) ^ U(0xA5A5A5A5A5A5A5A5)))
    return np.concatenate(out)


def _runs(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with the first place and the length of each signature's run."""
    order = np.lexsort([cls, sig])
    sig, cls = sig[order], cls[order]
    if not len(sig):
        return sig, cls, np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
    sig, cls = sig[new], cls[new]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    return sig, cls, first, np.diff(np.r_[first, len(sig)])


def counters(s: np.ndarray) -> np.ndarray:
    """Shingles of a set in each hash bucket, up to 65535; large sets have more buckets."""
    k = COUNTERS[0]
    while k < COUNTERS[1] and 8 * k < len(s):
        k *= 2
    return np.minimum(np.bincount((s & U(k - 1)).astype(np.int64), minlength=k), 65535).astype(np.uint16)


Box = tuple[int, int, np.ndarray, np.ndarray]
"""Least and greatest size of some sets, and of their counts in each bucket."""
ANY: Box = (1, 1 << 40, np.zeros(COUNTERS[0], np.uint16), np.full(COUNTERS[0], 65535, np.uint16))


def around(boxes: list[Box]) -> Box:
    """The least box that holds all of these."""
    lo, hi = folded(boxes)
    return min(b[0] for b in boxes), max(b[1] for b in boxes), lo.min(axis=0).clip(0, 65535).astype(np.uint16), hi.max(axis=0).clip(0, 65535).astype(np.uint16)


def folded(boxes: list[Box]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts of the boxes in as many buckets as the fewest of them."""
    k = min(len(b[2]) for b in boxes)
    lo, hi = (np.array([b[i].astype(np.int32).reshape(-1, k).sum(axis=0) for b in boxes]) for i in (2, 3))
    return lo, hi


def together(boxes: list[Box], bounds: Bounds) -> np.ndarray:
    """A number for each box; boxes differ in it only if sizes or counts prove that no chain of links joins their sets."""
    n, p = len(boxes), bounds.percent
    least, most = np.array([b[0] for b in boxes], np.int64), np.array([b[1] for b in boxes], np.int64)
    lo, hi = folded(boxes)
    label, rest, k = np.full(n, -1), np.arange(n), 0
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        label[todo[0]] = k
        while todo and len(rest):
            i = todo.pop()
            at = np.flatnonzero(100 * np.minimum(most[rest], most[i]) >= p * np.maximum(least[rest], least[i]))
            if len(at):
                gap = np.maximum(lo[rest[at]] - hi[i], lo[i] - hi[rest[at]]).clip(0).sum(axis=1)
                at = at[gap * (100 + p) <= (most[rest[at]] + most[i]) * (100 - p)]
                found = rest[at]
                label[found] = k
                todo += found.tolist()
                rest = np.delete(rest, at)
        k += 1
    return label


def _set_of(h: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(h, size))


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a sorted set."""
    with np.errstate(over="ignore"):
        a = mix(s).sum(dtype=U) + U(len(s))
        b = mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
    return int(mix(np.array([a], U))[0].view(np.int64)), int(mix(np.array([b], U))[0].view(np.int64))


_SCAN = "kind byte, doc_id long, n_shingles long, class_a long, class_b long, range int, sig binary, cls binary, counts binary"


def _scan(docs: DataFrame, size: int, percent: int, ranges: int) -> DataFrame:
    """Rows of kind 0: a document and its class; 1: an edge class_a -> class_b; 2: signatures of a range; 4: a node (class_a) for several classes, its least and greatest size (n_shingles, class_b) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(percent)
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        sizes: dict[int, tuple[int, np.ndarray]] = {}
        held = 0
        # nodes of different tasks are different
        import uuid

        salt = uuid.uuid4().int >> 64

        def row_batch(kind: int, **cols: list) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            types = {"kind": pa.int8(), "range": pa.int32(), "sig": pa.binary(), "cls": pa.binary(), "counts": pa.binary()}
            data = {"kind": [kind] * n} | cols
            names = [c.split()[0] for c in _SCAN.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(data[c], types.get(c, pa.int64())) if c in data else pa.nulls(n, types.get(c, pa.int64())) for c in names], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sigs, owners, held
            if not sigs:
                return
            sig, cls, first, length = _runs(np.concatenate(sigs), np.concatenate(owners))
            sigs, owners, held = [], [], 0
            keep, extra, a, b = np.ones(len(sig), bool), [], [], []
            for at, n in zip(first[length > LOCAL_RUN], length[length > LOCAL_RUN], strict=True):
                own = cls[at : at + n]
                have = [(size, size, c, c) for size, c in (sizes[int(c)] for c in own.view(np.int64))]
                label = together(have, bounds)
                for k in np.flatnonzero(np.bincount(label) > 1):
                    members = np.flatnonzero(label == k)
                    node = mix(own[members[:1]] ^ sig[at] ^ U(salt))
                    keep[at + members] = False
                    extra.append((sig[at], node[0], around([have[i] for i in members])))
                    a.append(own[members])
                    b.append(np.full(len(members), node[0], U))
            if extra:
                nodes = np.array([e[1] for e in extra], U).view(np.int64)
                yield row_batch(4, doc_id=(nodes & 0xFFFFF), class_a=nodes, n_shingles=[e[2][0] for e in extra], class_b=[e[2][1] for e in extra], counts=[pack(np.r_[e[2][2], e[2][3]]) for e in extra])
                yield row_batch(1, doc_id=(np.concatenate(a).view(np.int64) & 0xFFFFF), class_a=np.concatenate(a).view(np.int64), class_b=np.concatenate(b).view(np.int64))
                sig, cls = np.r_[sig[keep], np.array([e[0] for e in extra], U)], np.r_[cls[keep], np.array([e[1] for e in extra], U)]
                order = np.argsort(sig, kind="stable")
                sig, cls = sig[order], cls[order]
            # signatures are sorted: a range is a slice
            edges = np.searchsorted(sig, np.arange(ranges, dtype=U) * U((2**64 - 1) // ranges + 1) if ranges > 1 else np.zeros(1, U))
            ends = np.r_[edges[1:], len(sig)]
            for lo in range(0, ranges, 64):
                rows = [k for k in range(lo, min(ranges, lo + 64)) if ends[k] > edges[k]]
                if rows:
                    yield row_batch(2, range=rows, sig=[pack(sig[edges[k] : ends[k]]) for k in rows], cls=[pack(cls[edges[k] : ends[k]]) for k in rows])

        for b in batches:
            for keys, flat, off in chunks(b.column(0), b.column(1)):
                h, at, _ = words(flat, off)
                n, ca, cb, counts = [], [], [], []
                for i in range(len(keys)):
                    s = _set_of(h[at[i] : at[i + 1]], size)
                    x, y = _class_of(s)
                    n.append(len(s))
                    ca.append(x)
                    cb.append(y)
                    own = counters(s)
                    counts.append(pack(own) if len(s) else None)
                    if len(s) and x not in sizes:
                        sizes[x] = (len(s), own)
                        new = signatures(s, bounds)
                        sigs.append(new)
                        owners.append(np.full(len(new), x, np.int64).view(U))
                        held += len(new)
                yield row_batch(0, doc_id=keys, n_shingles=n, class_a=ca, class_b=cb, counts=counts)
                if held >= FLUSH:
                    yield from flush()
                    sizes.clear()
        yield from flush()

    return docs.mapInArrow(run, _SCAN)


_FOUND = "kind byte, doc_id long, n_shingles long, class_a long, class_b long, counts binary"


def _met(scan: DataFrame) -> DataFrame:
    """Kinds 0, 1 and 4 of the scan, and of kind 3 the members (class_a) of runs (class_b) with their lengths (doc_id), each distinct run once a range."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        rest = table.filter(pa.array(kinds != 2)).select(["kind", "doc_id", "n_shingles", "class_a", "class_b", "counts"])
        mine = table.filter(pa.array(kinds == 2))
        if not len(mine):
            return rest
        _, cls, first, length = _runs(np.concatenate(blobs(mine, "sig", "u8")), np.concatenate(blobs(mine, "cls", "u8")))
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(cls), first) + length.astype(U))
        _, once = np.unique(name, return_index=True)
        once = once[length[once] > 1]
        n = length[once]
        at = np.repeat(first[once] - np.cumsum(n) + n, n) + np.arange(n.sum())
        none = pa.nulls(len(at), pa.int64())
        runs = pa.table({"kind": pa.array(np.full(len(at), 3, np.int8)), "doc_id": np.repeat(n, n), "n_shingles": none, "class_a": cls[at].view(np.int64), "class_b": np.repeat(name[once], n).view(np.int64), "counts": pa.nulls(len(at), pa.binary())})
        return pa.concat_tables([rest, runs])

    return scan.groupBy("range").applyInArrow(run, _FOUND)


def _boxed(size_lo: int | None, size_hi: int | None, counts: bytes | None) -> Box:
    if size_lo is None or counts is None:
        return ANY
    c = np.frombuffer(counts, np.uint16)
    return (size_lo, size_hi, c[: len(c) // 2], c[len(c) // 2 :])


_TOLD = "a long, b long, run long, lo long, hi long, counts binary"


def _chunks_told(nodes: DataFrame, percent: int, n: int) -> DataFrame:
    """Of every chunk (run, chunk, parts, cls, lo, hi, counts): edges a -> b that join what stays together, and where a run has several parts, one row (a: null) for each such component b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, at, rows = Bounds(percent), None, []

        def close(out: list[tuple]) -> None:
            if not rows or at is None:
                return
            boxes = [_boxed(*r[4:]) for r in rows]
            label = together(boxes, bounds) if len(rows) > 1 else np.zeros(1, np.int64)
            lead: dict[int, int] = {}
            for r, k in zip(rows, label.tolist(), strict=True):
                if lead.setdefault(k, r[3]) != r[3]:
                    out.append((r[3], lead[k], None, None, None, None))
            if rows[0][2] > 1:
                for k, node in lead.items():
                    box = around([boxes[i] for i in np.flatnonzero(label == k)])
                    out.append((None, node, at[0], box[0], box[1], pack(np.r_[box[2], box[3]])))

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], names=["a", "b", "run", "lo", "hi", "counts"])

        for b in batches:
            out: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:2] != at:
                    close(out)
                    at, rows = r[:2], []
                rows.append(r)
            if out:
                yield batch(out)
        out = []
        close(out)
        if out:
            yield batch(out)

    return nodes.repartition(n, "run", "chunk").sortWithinPartitions("run", "chunk", "cls").select("run", "chunk", "parts", "cls", "lo", "hi", "counts").mapInArrow(run, _TOLD)


def _told_apart(runs: DataFrame, percent: int, n: int) -> DataFrame:
    """Edges a -> b that join what stays together of each run; runs: run, length, cls, lo, hi (sizes; null: unknown), counts.

    A long run goes through turns of chunks. Where a turn leaves most of what it had, its nodes are joined: they
    are then told apart by their tokens, in the group's blocks.
    """
    edges, turn = None, 0
    while True:
        parts = F.ceil(F.col("length") / CHUNK).cast("int")
        dealt = runs.withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(turn)), F.col("parts")).cast("int"))
        told = materialize(_chunks_told(dealt, percent, n), "told-apart")
        new = told.where("a IS NOT NULL").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        left = told.where("a IS NULL").select("run", F.col("b").alias("cls"), "lo", "hi", "counts")
        length = materialize(left.groupBy("run").agg(F.count(F.lit(1)).alias("length"), F.min("cls").alias("first")), "run-lengths")
        if length.isEmpty():
            return edges
        before = runs.groupBy("run").agg(F.max("length").alias("_before")) if turn else runs.where(f"length > {CHUNK}").groupBy("run").agg(F.max("length").alias("_before"))
        length = length.join(before, "run").withColumn("_stuck", F.col("length") * 2 > F.col("_before"))
        runs = materialize(left.join(length.drop("_before"), "run"), "run-nodes")
        edges = edges.unionByName(runs.where("_stuck AND cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")))
        runs = runs.where("NOT _stuck").drop("_stuck", "first")
        turn += 1


def _to_least(pairs: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """pairs a, b with m of their a; least: a, m, n (pairs of a; over all rows at most ends).

    Nodes with more than their share of all pairs are sent to where these are. As each has such a share, there are
    fewer than CENTRES of them at any size; the other nodes meet their pairs by a shuffle.
    """
    most = ends // CENTRES
    centres = F.broadcast(least.where(F.col("n") > most).select("a", F.col("m").alias("_centre")))
    met = pairs.join(centres, "a", "left")
    others = met.where("_centre IS NULL").select("a", "b").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return met.where("_centre IS NOT NULL").select("a", "b", F.col("_centre").alias("m")).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """node -> component (the least node it is joined with) for all nodes of the edges a, b (long)."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, n = None, e.count()
    if not n:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # large star: every neighbour above a node joins the least of its neighbourhood; written down, as the small star reads it five times
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = materialize(_to_least(both.where("b > a"), least, 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-stars")
        # small star: a node and its neighbours below it join the least of them; the node does so in the row of that least one
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _to_least(large, low, n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        e = materialize(small, "stars")
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if (n, total) == before:
            break
        before = (n, total)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


class Matrix:
    """Components of sets read so far, each with the union of its tokens."""

    def __init__(self, bounds: Bounds):
        self.bounds = bounds
        self.ids: list[list[int]] = []
        self.sets: list[list[np.ndarray]] = []
        self.union: list[np.ndarray] = []
        self.sizes: list[tuple[int, int]] = []

    def reaches(self, k: int, s: np.ndarray) -> bool:
        """Whether a document of component k may link with s, by sizes and by the overlap with its union."""
        p, (lo, hi) = self.bounds.percent, self.sizes[k]
        if 100 * lo * 100 < p * len(s) * 100 and 100 * hi < p * len(s) or 100 * len(s) < p * lo:
            return False
        u = self.union[k]
        at = np.searchsorted(u, s)
        return 100 * int((u[np.minimum(at, len(u) - 1)] == s).sum()) >= p * len(s)

    def partner(self, k: int, s: np.ndarray) -> int | None:
        """A document of component k that links with s."""
        for i, t in zip(self.ids[k], self.sets[k], strict=True):
            a, b = (s, t) if len(s) <= len(t) else (t, s)
            if 100 * len(a) < self.bounds.percent * len(b):
                continue
            at = np.searchsorted(b, a)
            if self.bounds.linked(int((b[np.minimum(at, len(b) - 1)] == a).sum()), len(a), len(b)):
                return i
        return None

    def links(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(component, a partner in it) for every component that s links with."""
        return [(k, i) for k in range(len(self.ids)) if self.reaches(k, s) and (i := self.partner(k, s)) is not None]

    def add(self, key: int, s: np.ndarray) -> None:
        found = [k for k, _ in self.links(s)]
        if not found:
            self.ids.append([key])
            self.sets.append([s])
            self.union.append(s)
            self.sizes.append((len(s), len(s)))
            return
        k, *rest = found
        self.ids[k].append(key)
        self.sets[k].append(s)
        joined = [s]
        for r in reversed(rest):
            self.ids[k] += self.ids.pop(r)
            self.sets[k] += self.sets.pop(r)
            joined.append(self.union.pop(r))
            lo, hi = self.sizes.pop(r)
            self.sizes[k] = (min(lo, self.sizes[k][0]), max(hi, self.sizes[k][1]))
        self.union[k] = np.union1d(self.union[k], np.concatenate(joined))
        self.sizes[k] = (min(len(s), self.sizes[k][0]), max(len(s), self.sizes[k][1]))


def _by_block(df: DataFrame, keys: list[str], work: Callable[[list[tuple]], list[tuple[int, int]]], n: int) -> DataFrame:
    """Edges a, b from the rows of each block; a task holds one block at a time."""
    names = [*keys, "query", "node", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if rows and (e := work(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*e, strict=True)], names=["a", "b"])

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in names], strict=True):
                if r[: len(keys)] != at:
                    yield from close()
                    at, rows = r[: len(keys)], []
                rows.append((r[-3], r[-2], np.frombuffer(r[-1], U)))
        yield from close()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, "query", "node").select(*names).mapInArrow(run, "a long, b long")


def _inside(percent: int) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    """Joins the documents of a block into components: edges to a component's least document, itself included."""

    def work(rows: list[tuple]) -> list[tuple[int, int]]:
        m = Matrix(Bounds(percent))
        for _, key, s in sorted(rows, key=lambda r: (len(r[2]), r[1])):
            m.add(key, s)
        return [(i, min(ids)) for ids in m.ids for i in ids]

    return work


def _across(percent: int) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    """Edges between the queries dealt to a block and its own documents: one for each component that a query links with."""

    def work(rows: list[tuple]) -> list[tuple[int, int]]:
        m = Matrix(Bounds(percent))
        for _, key, s in sorted((r for r in rows if not r[0]), key=lambda r: (len(r[2]), r[1])):
            m.add(key, s)
        return [(key, i) for q, key, s in rows if q for _, i in m.links(s)]

    return work


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """grp, block, node, class and tokens of the wanted documents (doc_id, class_a, class_b, grp, block); other texts of their ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for keys, flat, off in chunks(b.column("doc_id"), expanded(b.column("z"))):
                h, w, _ = words(flat, off)
                sets = [_set_of(h[w[i] : w[i + 1]], size) for i in range(len(keys))]
                part = b.slice(at, len(keys))
                asked = zip(part.column("class_a").to_pylist(), part.column("class_b").to_pylist(), strict=True)
                own = [i for i, (x, s) in enumerate(zip(asked, sets, strict=True)) if _class_of(s) == x]
                part = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("grp", "block", "doc_id", "class_a", "class_b")], pa.array([pack(sets[i]) for i in own], pa.binary())], names=["grp", "block", "node", "class_a", "class_b", "tokens"])
                at += len(keys)

    # joined alike at any size: a broadcast of the wanted ids would not last
    return compressed(docs).join(wanted.hint("merge"), "doc_id").mapInArrow(run, "grp long, block int, node long, class_a long, class_b long, tokens binary")


def join(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id it is linked with, directly or not; itself at least)."""
    spark = docs.sparkSession
    ship(spark)
    docs = text_only(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    ranges = width(spark)
    scan = _scan(docs, shingle, percent, ranges)
    scan = scan.withColumn("range", F.coalesce("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")))
    found = materialize(_met(scan), "met")
    rows = found.where("kind = 0").select("doc_id", "n_shingles", "class_a", "class_b")
    classes = materialize(found.where("kind = 0 AND n_shingles > 0").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.first("counts").alias("counts")), "classes")
    runs = found.where("kind = 3").select(F.col("class_b").alias("run"), F.col("doc_id").alias("length"), F.col("class_a").alias("cls")).distinct()
    # should two sets share a first hash, their sizes and counts are unknown
    size = F.when(F.count(F.lit(1)) == 1, F.max("n"))
    known = classes.groupBy(F.col("class_a").alias("cls")).agg(size.alias("lo"), size.alias("hi"), F.max(F.concat("counts", "counts")).alias("counts"))
    known = known.unionByName(found.where("kind = 4").select(F.col("class_a").alias("cls"), F.col("n_shingles").alias("lo"), F.col("class_b").alias("hi"), "counts"))
    near = _told_apart(runs.join(known, "cls", "left"), percent, width(spark, 2))
    reach = components(near.unionByName(found.where("kind = 1").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))))
    # groups of two classes and more, cut into blocks by their number of shingles
    grouped = classes.join(reach.withColumnsRenamed({"node": "class_a", "component": "grp"}), "class_a")
    blocks = grouped.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / MAX_TOKENS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    wanted = grouped.join(blocks, "grp").select("grp", F.pmod(F.xxhash64("class_a", "class_b"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("doc_id"), "class_a", "class_b", "blocks", "n")
    wanted = materialize(wanted, "wanted")
    sets = materialize(_sets(docs, wanted.drop("blocks", "n"), shingle).dropDuplicates(["node", "class_a", "class_b"]), "sets")
    links = _link(sets, wanted, percent)
    # an id with several texts joins their classes
    several = rows.groupBy("doc_id").agg(F.min(F.struct("class_a", "class_b")).alias("x"), F.max(F.struct("class_a", "class_b")).alias("y")).where("x <> y").select("doc_id")
    several = materialize(several, "several-texts")
    repeated = not several.isEmpty()
    if repeated:
        shared = rows.join(several, "doc_id", "left_semi").select("doc_id", "class_a", "class_b").distinct().join(classes, ["class_a", "class_b"])
        links = links.unionByName(shared.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    linked = components(links)
    comp = classes.join(linked, "node", "left").select("class_a", "class_b", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(comp, ["class_a", "class_b"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    if repeated:
        one = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
        out = out.join(one, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))
    return out


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, that come first in their component: least doc_id.

    Every row is a document of its own, also where it has no doc_id or that of another row. Rows of a component with
    equal ids come in no set order, and those without one come last.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    if ids.where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.join(join(docs, shingle, percent).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    # numbers take the place of the ids; written down, so that they stay the same
    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"), F.monotonically_increasing_id().alias("doc_id")), "numbered")
    place = rows.select("doc_id", F.struct(F.col("_doc.doc_id").isNull().alias("none"), F.col("_doc.doc_id").cast("long").alias("own"), "doc_id").alias("place"))
    first = join(rows.select("doc_id", "text"), shingle, percent).join(place, "doc_id").groupBy("component_id").agg(F.min("place")["doc_id"].alias("doc_id"))
    return rows.join(first.select("doc_id"), "doc_id", "left_semi").select("_doc.*")


def _tokens_of(sets: DataFrame, keys: str) -> DataFrame:
    """keys (longs, or int for block) and token: a row for each distinct token of the sets of a task's batch with equal keys."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                rows: dict[tuple, list[np.ndarray]] = {}
                for *k, t in zip(*[c.to_pylist() for c in b.slice(lo, 256).columns], strict=True):
                    rows.setdefault(tuple(k), []).append(np.frombuffer(t, np.int64))
                found = {k: np.unique(np.concatenate(v)) for k, v in rows.items()}
                sizes = [len(v) for v in found.values()]
                cols = [pa.array(np.repeat(np.array(c), sizes), pa.int32() if n == "block" else pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(list(found.values())))], names=[*names, "token"])

    return sets.select(*names, "tokens").mapInArrow(run, f"{keys}, token long")


def _link(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Edges between nodes that make the exact components of every group."""
    spark = sets.sparkSession
    n = width(spark, 2)
    plain = sets.withColumn("query", F.lit(False)).select("grp", "block", "query", "node", "tokens")
    inner = materialize(_by_block(plain, ["grp", "block"], _inside(percent), n), "inner")
    split = wanted.where("blocks > 1").select("grp", F.col("doc_id").alias("node"), F.col("block").alias("home"), "n")
    if split.isEmpty():
        return inner
    # first documents of the components of each block meet in fewer blocks, until a group has one
    edges, heads, shrink = inner, inner.select(F.col("b").alias("node")).distinct().join(split, "node"), 1
    while True:
        heads = materialize(heads, "heads")
        size = heads.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / HEADS), F.ceil(F.sum("n") / MAX_TOKENS)).cast("int").alias("parts"))
        again = heads.join(size, "grp").select("grp", "node", F.pmod(F.xxhash64("node", F.lit(shrink)), F.col("parts")).cast("int").alias("block"), "parts")
        more = materialize(_by_block(sets.select("node", "tokens").join(again, "node").withColumn("query", F.lit(False)), ["grp", "block"], _inside(percent), n), "heads-linked")
        edges = edges.unionByName(more)
        left = materialize(more.select(F.col("b").alias("node")).distinct().join(heads, "node").select("node", "grp", "home", "n"), "heads-left")
        # a group that hardly shrinks has few links left; what follows finds them
        if again.where("parts > 1").isEmpty() or left.count() > 0.8 * heads.count():
            break
        heads, shrink = left, shrink + 1
    # all but the largest component of a group
    comp = components(edges)
    placed = split.join(comp, "node", "left").select("grp", "node", "home", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("grp").agg(F.max_by("component", F.struct("k", F.col("component"))).alias("main"))
    minor = materialize(placed.join(largest, "grp").where("component <> main").select("grp", "node", "home"), "minor")
    if minor.isEmpty():
        return edges
    own = plain.join(minor.select("grp").distinct(), "grp", "left_semi")
    unions = materialize(_tokens_of(own, "grp long, block int").distinct(), "unions")
    spread = unions.groupBy("grp", "token").agg(F.count(F.lit(1)).alias("blocks"))
    asking = minor.join(sets.select("node", "tokens"), "node")
    rare = _tokens_of(asking, "grp long, node long").join(spread, ["grp", "token"])
    ranked = rare.groupBy("grp", "node").agg(F.sort_array(F.collect_list(F.struct("blocks", "token"))).alias("t"))
    size = F.size("t")
    # it shares at least percent of its tokens with a block that qualifies, so one of these at least
    first = F.slice("t", F.lit(1), size - F.ceil(size * F.lit(percent) / 100).cast("int") + 1)
    candidates = ranked.select("grp", "node", F.explode(first).alias("t")).select("grp", "node", "t.token").join(unions, ["grp", "token"]).select("grp", "node", "block").distinct()
    # within its own block all links are known
    asked = candidates.join(asking.select("node", "home", "tokens"), "node").where("block <> home").select("grp", "block", F.lit(True).alias("query"), "node", "tokens")
    return edges.unionByName(_by_block(own.unionByName(asked), ["grp", "block"], _across(percent), n))


def oracle(shingle: int, percent: int) -> str:
    """The same in DuckDB SQL: sets of shingles as text, all pairs that share one, closure of the links."""
    whole = "[array_to_string(ws, ' ')]"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN {whole}
  ELSE list_distinct(list_transform(range(1, len(ws) - {shingle - 2}), lambda i: array_to_string(list_slice(ws, i, i + {shingle - 1}), ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(g) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = other)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""
