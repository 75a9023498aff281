"""Alignment of two tokenizers over a corpus: which tokens of one meet which of the other, and how often.

Side A is byte-level BPE of a space and the text, side B sentencepiece BPE of the text, which puts that space
itself. Both cover the same bytes. Where tokens of both end, a group ends; each stretch between neighbouring ends lies in one token
of either side and is the link of these two.

Both tokenizers cut at a space between two solid characters, so texts are dealt with part by part (``parts``), and a
part that a worker remembers is neither encoded nor aligned again. New parts are aligned at once: ends of tokens
as flat arrays, groups where both have an end, links from the merged ends.

Links are striped by the id of side B (id modulo STRIPES). A task writes, for each batch of texts and stripe, which cells (row of
the B id in its stripe, A id) each document links, and how often. Counting sums them in each task, then by stripe and
salt, then by stripe: np.add.at puts a stripe's cells into a dense block of ROWS x A ids, whose row maxima say which
counts are the best of a B id. Scoring deals links by stripe too; a stripe with many links is dealt to several tasks,
by salts that follow its bytes, each with a copy of the stripe's counts (a block at most). What a task
finds of a batch's documents is summed before it is sent to where the batch's documents are.

Memory: a task holds one dense block, one batch of texts or links, and sums of bounded size.

Defined cases: null and empty texts, and texts whose joined bytes on a side differ from space and text (those with the escaped-space
character), have no tokens: zeros and an empty digest; special tokens' strings are plain text; very
long texts are batches of their own; rows that repeat a doc_id, and rows with a null one, are each answered on their own and
count in the corpus; an empty table gives an empty result; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import WordCoder
from .parts import parts
from .pieces import SPACE, PieceModel, split_words
from .runtime import materialize, ship, text_only

#: B ids in a stripe: a dense block has so many rows.
ROWS = 256
#: Characters of text in a batch, about.
BATCH = 1 << 21
#: Parts a worker remembers between batches; beyond that it forgets all.
REMEMBER = 300_000
#: Cells a task holds before it hands on their counts, and documents' sums.
FLUSH = 4_000_000
#: Bytes of links that a salt of a stripe has, about.
SALT_BYTES = 16 << 20
#: Tasks whose counts of a stripe meet in one, about.
FAN_IN = 256
#: Bits of a cell, and of a document's place in its batch, in the key of a link.
_BITS = 24
DOCS = ["n_a", "n_b", "n_groups", "n_links"]


def _put(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.ascontiguousarray(a).view(np.uint8) for a in arrays]).tobytes())


def _get(z: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of equal length and the given types."""
    raw = zstandard.ZstdDecompressor().decompress(z)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * size
    return out


class Sides:
    """Both tokenizers: ids of parts and the bytes that each id covers."""

    def __init__(self, path_a: str, path_b: str):
        self.coder, self.model = WordCoder(path_a), PieceModel(path_b)
        vocabulary = self.coder.whole.get_vocab()
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.model.n
        if ROWS * self.size_a > 1 << _BITS:
            raise ValueError(f"cells of {ROWS} rows of {self.size_a} ids take more than {_BITS} bits")
        self.bytes_a, self.bytes_b = np.zeros(self.size_a, np.int64), np.zeros(self.size_b, np.int64)
        # byte-level entries have one character for each byte
        self.bytes_a[list(vocabulary.values())] = list(map(len, vocabulary))
        self.bytes_b[:] = [1 if t is None else len(t.encode()) for t in self.model.shown]
        self.digits = [str(i) for i in range(max(self.size_a, self.size_b))]

    def encode(self, some: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each part on either side. A part begins with a space."""
        words = [split_words(p[1:]) for p in some]
        found = iter(self.model.encode_words([w for ws in words for w in ws]))
        return [self.coder.part(p) for p in some], [[i for _ in ws for i in next(found)] for ws in words]


class Aligned:
    """Parts that a worker knows: counts, links as cells, and groups as text."""

    def __init__(self, sides: Sides):
        self.sides, self.stripes = sides, -(-sides.size_b // ROWS)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self._counts, self._cells, self._stripes = [np.empty((0, 3), np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int16)]

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A, of B and groups of each part; cells and stripes of all parts' links)."""
        for own in (self._counts, self._cells, self._stripes):
            own[:] = [np.concatenate(own)]
        return self._counts[0], self._cells[0], self._stripes[0]

    def learn(self, wanted: set[str]) -> None:
        fresh = list(wanted - self.at.keys())
        if len(self.at) + len(fresh) > REMEMBER:
            self.forget()
            fresh = list(wanted)
        if not fresh:
            return
        ids_a, ids_b = self.sides.encode(fresh)
        n = np.array([list(map(len, ids_a)), list(map(len, ids_b))])
        a, b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.sides.bytes_a[a]), np.cumsum(self.sides.bytes_b[b])
        last = np.cumsum(n, axis=1) - 1
        if not np.array_equal(end_a[last[0]], end_b[last[1]]):
            raise ValueError("the sides cover different bytes")
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        ends = np.union1d(end_a, end_b)
        link_a, link_b = a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)]
        n_groups = np.diff(np.searchsorted(cuts, end_a[last[0]]), prepend=-1)
        self._counts.append(np.stack([n[0], n[1], n_groups], axis=1))
        self._cells.append((link_b // self.stripes * self.sides.size_a + link_a).astype(np.int32))
        self._stripes.append((link_b % self.stripes).astype(np.int16))
        self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh)), strict=True))
        self.groups.extend(self._as_text(ids_a, ids_b, n_groups, np.diff(np.searchsorted(end_a, cuts), prepend=-1), np.diff(np.searchsorted(end_b, cuts), prepend=-1)))

    def _as_text(self, ids_a: list[list[int]], ids_b: list[list[int]], n_groups: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> Iterator[str]:
        """Each part's groups; in_a, in_b: tokens of either side in each group."""
        digits, sizes = self.sides.digits, zip(in_a.tolist(), in_b.tolist(), strict=True)
        for a, b, k in zip(ids_a, ids_b, n_groups.tolist(), strict=True):
            i = j = 0
            out = []
            for _ in range(k):
                p, q = next(sizes)
                out.append(f"{','.join([digits[x] for x in a[i : i + p]])}|{','.join([digits[x] for x in b[j : j + q]])}")
                i, j = i + p, j + q
            yield ";".join(out)


_aligned: dict[tuple[str, str], Aligned] = {}


def aligned(path_a: str, path_b: str) -> Aligned:
    key = (path_a, path_b)
    if key not in _aligned:
        _aligned[key] = Aligned(Sides(path_a, path_b))
    return _aligned[key]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts in batches of about BATCH characters, across the batches that Spark makes."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if size and size + len(t) > BATCH:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


class Batch:
    """The parts of some texts: which, whose, and what they hold."""

    def __init__(self, known: Aligned, texts: list[str]):
        # an escaped space in a text is a space on side B alone
        self.split = [parts(" " + t) if t and SPACE not in t else [] for t in texts]
        known.learn(set().union(*self.split))
        self.known, n = known, len(texts)
        self.owner = np.repeat(np.arange(n), list(map(len, self.split)))
        self.part = np.fromiter((known.at[p] for ps in self.split for p in ps), np.int64, len(self.owner))
        counts, self._cells, self._stripes = known.tables
        own = counts[self.part]
        self.counts = np.stack([np.bincount(self.owner, own[:, k], n).astype(np.int64) for k in range(3)], axis=1)
        self._links = own[:, 0] + own[:, 1] - own[:, 2]
        every = counts[:, 0] + counts[:, 1] - counts[:, 2]
        self._first = np.cumsum(every) - every

    def groups(self) -> list[str]:
        get, at = self.known.groups.__getitem__, self.known.at.__getitem__
        return [";".join(map(get, map(at, ps))) for ps in self.split]

    def links(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(stripe, documents, cells, how often), a stripe at a time."""
        total = int(self._links.sum())
        place = np.repeat(self._first[self.part] - np.cumsum(self._links) + self._links, self._links) + np.arange(total)
        key = (self._stripes[place].astype(np.int64) << 2 * _BITS) | (self._cells[place].astype(np.int64) << _BITS) | np.repeat(self.owner, self._links)
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else np.empty(0, np.int64)
        times, key = np.diff(new, append=total), key[new]
        stripe = key >> 2 * _BITS
        edges, low = np.searchsorted(stripe, np.arange(self.known.stripes + 1)), (1 << _BITS) - 1
        for s in np.flatnonzero(np.diff(edges)):
            at = slice(edges[s], edges[s + 1])
            yield int(s), (key[at] & low).astype(np.int32), ((key[at] >> _BITS) & low).astype(np.int32), times[at].astype(np.int32)


#: Stripe of the rows that hold a batch's documents.
_DOCS = -1


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """batch, stripe, z: what each batch of texts has in each stripe, and its documents."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligned(path_a, path_b)
        for ids, texts in _batched(batches):
            for lo in range(0, len(ids), 1 << _BITS):
                got = Batch(known, texts[lo : lo + (1 << _BITS)])
                number = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
                text = [g.encode() for g in got.groups()]
                sha = np.frombuffer(b"".join([hashlib.sha256(g).digest() for g in text]), "V32")
                own = ids[lo : lo + (1 << _BITS)]
                key = np.array([i or 0 for i in own], np.int64), np.array([i is None for i in own], bool)
                rows = [(_DOCS, _put(*key, *got.counts.T, sha))]
                rows += [(s, _put(d, c, k)) for s, d, c, k in got.links()]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["batch", "stripe", "z"])

    return text_only(docs).mapInArrow(run, "batch long, stripe int, z binary")


def _summed(batches: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sums of (stripe, cells, counts), whatever the order; sums of a stripe may come in several."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def combined(s: int) -> tuple[np.ndarray, np.ndarray]:
        cells, at = np.unique(np.concatenate([c for c, _ in held[s]]), return_inverse=True)
        out = np.zeros(len(cells), np.int64)
        np.add.at(out, at, np.concatenate([n for _, n in held[s]]))
        return cells, out

    size = 0
    for s, cells, n in batches:
        held.setdefault(s, []).append((cells, n))
        size += len(cells)
        if size > FLUSH:
            held = {k: [combined(k)] for k in held}
            size = sum(len(v[0][0]) for v in held.values())
            if size > FLUSH // 2:
                yield from ((k, *v[0]) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, *combined(k)) for k in held)


def _sums(rows: DataFrame, kind: str) -> DataFrame:
    """stripe, part (of the task), z: a task's sums of rows of stripe and z, whose counts have the type kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = int.from_bytes(uuid.uuid4().bytes[:4], "little") >> 1

        def read() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for b in batches:
                for s, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield s, *_get(z, *(["<i4", "<i4", "<i4"] if kind == "<i4" else ["<i4", "<i8"]))[-2:]

        for s, cells, n in _summed(read()):
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "part": pa.array([part], pa.int32()), "z": [_put(cells, n)]})

    return rows.select("stripe", "z").mapInArrow(run, "stripe int, part int, z binary")


def _blocks(sums: DataFrame, size_a: int) -> DataFrame:
    """stripe, z: cells, counts and whether they are the best of their row, of rows (of stripe and z) that lie by stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((s, z) for b in batches for s, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        block = np.zeros((ROWS, size_a), np.int64)
        for s, own in groupby(pairs, key=lambda x: x[0]):
            block[:] = 0
            for _, z in own:
                np.add.at(block.reshape(-1), *_get(z, "<i4", "<i8"))
            cells = np.flatnonzero(block)
            n = block.reshape(-1)[cells]
            best = n == block.max(axis=1)[cells // size_a]
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "z": [_put(cells.astype("<i4"), n, best)]})

    return sums.select("stripe", "z").mapInArrow(run, "stripe int, z binary")


def _by_stripe(links: DataFrame, size_a: int) -> DataFrame:
    """stripe, z: every cell of every stripe with its count in the corpus and whether that is the best of its B id."""
    spark = links.sparkSession
    local = _sums(links, "<i4")
    salts = max(1, local.rdd.getNumPartitions() // FAN_IN)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = _sums(local.withColumn("part", F.col("part") % salts).repartition(n, "stripe", "part"), "<i8")
    return materialize(_blocks(met.repartition(n, "stripe").sortWithinPartitions("stripe"), size_a), "pair-counts")


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """id_b, id_a, n, best (whether n is the highest of id_b) of every pair of ids that some text links."""
    sides = Sides(path_a, path_b)
    size, stripes = sides.size_a, -(-sides.size_b // ROWS)
    links = materialize(linked(docs, path_a, path_b), "links").where(F.col("stripe") != _DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells, n, best = _get(z, "<i4", "<i8", "?")
                yield pa.RecordBatch.from_pydict({"id_b": pa.array(cells // size * stripes + s, pa.int32()), "id_a": pa.array(cells % size, pa.int32()), "n": n, "best": best})

    return _by_stripe(links, size).mapInArrow(run, "id_b int, id_a int, n long, best boolean")


def _scored(links: DataFrame, blocks: DataFrame, size_a: int) -> DataFrame:
    """batch, stripe (0), z: documents of a batch with their best links and sums of counts, from some of their links."""
    spark = links.sparkSession
    salts = links.groupBy("stripe").agg((1 + F.sum(F.length("z")) / SALT_BYTES).cast("int").alias("salts"))
    # a row for each stripe
    salts = F.broadcast(spark.createDataFrame(salts.collect(), "stripe int, salts int"))
    own = links.join(salts, "stripe").select("stripe", F.pmod("batch", "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "batch", "z")
    counts = blocks.join(salts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), "z")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(counts).repartition(n, "stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bests = np.zeros(ROWS * size_a, np.int64), np.zeros(ROWS * size_a, bool)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for number, (best, count) in held.items():
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "stripe": pa.array([0], pa.int32()), "z": [_put(at.astype("<i4"), best[at].astype("<i8"), count[at].astype("<i8"))]})
            held.clear()

        for b in batches:
            for kind, number, z in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True):
                if kind == 0:
                    block[:], bests[:] = 0, False
                    cells, n, best = _get(z, "<i4", "<i8", "?")
                    block[cells], bests[cells] = n, best
                    continue
                docs, cells, times = _get(z, "<i4", "<i4", "<i4")
                most = int(docs.max()) + 1
                add = [_added(docs, times * bests[cells], most), _added(docs, times * block[cells], most)]
                if number in held:
                    add = [_longer(x, y) for x, y in zip(held[number], add, strict=True)]
                else:
                    size += most
                held[number] = (add[0], add[1])
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return dealt.mapInArrow(run, "batch long, stripe int, z binary")


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def _longer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Their sum, as long as the longer one."""
    if len(x) < len(y):
        x, y = y, x
    x[: len(y)] += y
    return x


def _documents(rows: DataFrame) -> DataFrame:
    """Documents of batches whose rows lie together, documents first, then what was found of them."""
    schema = ", ".join(f"{c} long" for c in ["doc_id", *DOCS, "n_best", "count_sum"]) + ", groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for _, own in groupby(pairs, key=lambda x: x[0]):
            _, _, z = next(own)
            key, null, a, b, groups, sha = _get(z, "<i8", "?", "<i8", "<i8", "<i8", "V32")
            best, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            for _, _, found in own:
                at, some, n = _get(found, "<i4", "<i8", "<i8")
                best[at] += some
                count[at] += n
            text = [x.tobytes().hex() if n else "" for x, n in zip(sha, a.tolist(), strict=True)]
            cols = [pa.array(key, mask=null), *[pa.array(x) for x in (a, b, groups, a + b - groups, best, count)], pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *DOCS, "n_best", "count_sum", "groups_sha256"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "batch").sortWithinPartitions("batch", "stripe").mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    sides = Sides(path_a, path_b)
    found = materialize(linked(docs, path_a, path_b), "links")
    is_docs = F.col("stripe") == _DOCS
    links = found.where(~is_docs)
    return _documents(found.where(is_docs).unionByName(_scored(links, _by_stripe(links, sides.size_a), sides.size_a)))


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups (as text: `a1,a2|b1;a3|b2,b3`) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(Batch(aligned(path_a, path_b), texts).groups(), pa.string())], names=["doc_id", "groups"])

    return text_only(docs).mapInArrow(run, "doc_id long, groups string")
