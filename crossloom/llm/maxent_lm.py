"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(class | context) * P(word | class, context). The context gives three hashed
features (last token, last two tokens, the one before the last: two n-grams and a skip). Both factors are
softmaxes over sums of weights: each feature's bucket has a weight for every class, and each pair of feature
and class a weight for every word of the class. Each class has one output for each of its commonest words and
one for all others; these share that output's probability by add-one counts, an unknown token is one more of them.

Classes follow from the corpus: a token belongs to the class of its last three bytes (hashed into TAILS
buckets), and those are clustered by how often which endings stand beside them. The end token is a class.

Training covers every training text: counts of tokens and of neighbouring endings, then ROUNDS of distributed
gradient updates. A round deals with its share of the documents (each is in one round, by a hash of its id). Each
task starts from the common weights, steps them batch by batch (AdaGrad over sparse rows of both softmaxes
and all templates), and sends how far each row moved. The moves' means, weighted by the tokens that met the row, say
where to; how far follows from how many tokens met the row in all tasks (``reach``), so that rows which each task has
seldom seen move as far as if one task had seen all. What is left of the split: on 1000 documents, held-out log10 a token
falls by 0.03 from one task to eight (by 0.07 with plain means). The model's size is fixed, so driver and tasks hold no more than it. Tasks are the
input's partitions; small ones are put together until a task has about TASK_TOKENS tokens, so that what
tasks send is a bounded share of the input. Counts of the HOT commonest tokens are broadcast (a fixed
number); all others meet their counts in a join, which has no hot keys then.

Defined cases: null and empty texts are the end token alone; without training texts every token is
unknown; tokens are known by 52 bits of a hash and the bucket of their ending; rows that repeat a doc_id are scored each on its own and
count twice in training; a null doc_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import chunks, materialize, pack, ship, text_only
from .words import LOWER, U, mix, words

#: Classes; the last is the end token's.
CLASSES = 64
#: Outputs of a class: its commonest words, and one for all others.
SLOTS = 64
#: Bits of the buckets of each feature template, for both softmaxes.
BITS = (13, 13, 12)
TAILS = 2048
#: Buckets of endings on each side that describe a tail.
BESIDE = 128
HOT = 400_000
ROUNDS = 3
RATE = 0.3
BATCH = 4096
#: Tokens that a row of weights meets before more of them hardly move it.
ENOUGH = 100
#: Tokens a task holds before it hands on their counts.
FLUSH = 4_000_000
#: Tokens that a task of a round has at least, unless the cluster would run fewer tasks than it can.
TASK_TOKENS = 1_000_000
END = 0x454E44000 + TAILS
_SIZES = [1 << b for b in BITS]
_BASE = np.cumsum([0, *_SIZES])
_OPEN = U(0x0B05)
_LAST = CLASSES - 1
#: Low bits of a token's key, which hold its tail; the other bits are its hash's.
_TAIL_BITS = U(0xFFF)
#: In place of a tail: the key counts a pair of neighbours.
_PAIR = 0xFFF
_BLOCK = 512
_ONES = np.ones(SLOTS, np.float32)


def tokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of tokens with an end after each document, where each document's begin and end)."""
    h, at, pos = words(flat, offsets)
    n = len(offsets) - 1
    place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))
    starts, ends = pos
    tail = np.zeros(len(h), U)
    for k in (1, 2, 3):
        has = ends - k >= starts
        tail = (tail << U(8)) | np.where(has, LOWER[flat[np.maximum(ends - k, 0)]], 0).astype(U)
    out = np.full(len(h) + n, END, U)
    out[place] = (h & ~_TAIL_BITS) | (mix(tail) % U(TAILS))
    return out, at + np.arange(n + 1)


def tail_of(tok: np.ndarray) -> np.ndarray:
    """Bucket of the last three bytes; TAILS for ends."""
    return (tok & _TAIL_BITS).astype(np.int64)


def contexts(tok: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Hash of each template for every token."""
    last, before = np.empty_like(tok), np.empty_like(tok)
    last[1:], before[2:] = tok[:-1], tok[:-2]
    first = cuts[:-1]
    last[first] = _OPEN
    before[first] = _OPEN
    second = first + 1
    before[second[second < cuts[1:]]] = _OPEN
    with np.errstate(over="ignore"):
        return [mix(last ^ U(0x51)), mix(last * U(3) ^ mix(before)), mix(before ^ U(0x77))]


def rows_of(ctx: list[np.ndarray], cls: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of the weights that each token's features have: with classes, those of its words' softmax."""
    out = []
    for k, (x, bits) in enumerate(zip(ctx, BITS, strict=True)):
        if cls is not None:
            with np.errstate(over="ignore"):
                x = mix(x + cls.astype(U) * U(0x9E3779B97F4A7C15))
        out.append(_BASE[k] + (x >> U(64 - bits)).astype(np.int64))
    return out


def cluster(beside: np.ndarray, k: int, turns: int = 15) -> np.ndarray:
    """Class (below k) of each row of counts: weighted k-means over the square roots of its smoothed shares."""
    n = beside.sum(axis=1)
    prior = (beside.sum(axis=0) + 1) / (beside.sum() + beside.shape[1])
    x = np.sqrt((beside + 20 * prior) / (n[:, None] + 20))
    weight = np.sqrt(n + 1)
    centers = [x[int(n.argmax())]]
    near = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k:
        centers.append(x[int((weight * near).argmax())])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(axis=1))
    c = np.array(centers)
    for _ in range(turns):
        label = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        total = np.bincount(label, n + 1e-9, k)
        for j in np.flatnonzero(total > 0):
            own = label == j
            c[j] = np.average(x[own], axis=0, weights=n[own] + 1e-9)
    return label


class Vocabulary:
    """Class of every token, and its slot in the class: that of its own, or the last for the class's other words."""

    def __init__(self, of_tail: np.ndarray, listed: np.ndarray, slots: np.ndarray):
        self.of_tail, self.listed, self.slots = of_tail, listed, slots
        # direct tables by other bits of the hash each, until every listed token has a place of its own
        self.tables, left, shift = [], np.arange(len(listed)), 48
        while len(left) and shift >= 0:
            key = (listed[left] >> U(shift)).astype(np.int64) & 0xFFFF
            table = np.full(1 << 16, -1, np.int32)
            table[key[::-1]] = left[::-1]
            self.tables.append((U(shift), table))
            left, shift = left[table[key] != left], shift - 12
        if len(left):
            raise ValueError("listed tokens repeat")

    def place(self, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cls, slot = self.of_tail.take(tail_of(tok)), np.full(len(tok), SLOTS - 1)
        for shift, table in self.tables:
            at = table.take((tok >> shift).astype(np.int64) & 0xFFFF)
            some = np.flatnonzero(at >= 0)
            at = at[some]
            hit = self.listed[at] == tok[some]
            slot[some[hit]] = self.slots[at[hit]]
        return cls, slot


def logits(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Sums of the weights of the rows and the bias; which: row of the bias of each, if it has several."""
    if which is None:
        z = weights.take(rows[0], axis=0)
        z += bias
    else:
        z = bias.take(which, axis=0)
        z += weights.take(rows[0], axis=0)
    z += weights.take(rows[1], axis=0)
    z += weights.take(rows[2], axis=0)
    if len(z) and z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    return z


def log_likelihood(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, y: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each y."""
    z = logits(weights, rows, bias, which)
    own = z[np.arange(len(z)), y]
    return own - np.log(np.exp(z, out=z) @ _ONES)


def bucket_sums(p: np.ndarray, by: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of p's rows, taken in the order by, of stretches of by: first places and sizes, which fall. Most are short: those are added row by row."""
    out = p.take(by[first], axis=0)
    longer = np.searchsorted(-size, -np.arange(5), "left")
    for k in range(1, 4):
        more = longer[k]
        out[:more] += p.take(by[first[:more] + k], axis=0)
    long = longer[4]
    if long:
        rest = size[:long] - 4
        starts = np.cumsum(rest) - rest
        some = np.repeat(first[:long] + 4 - starts, rest) + np.arange(rest.sum())
        out[:long] += np.add.reduceat(p.take(by[some], axis=0), starts, axis=0)
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Rows as single items, which numpy writes faster by index."""
    return x.view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0]


class Steps:
    """A task's copy of the weights of one softmax, stepped batch by batch."""

    def __init__(self, weights: np.ndarray):
        self.start, self.weights = weights, weights.copy()
        self.squares, self.seen = np.ones_like(weights), np.zeros(len(weights), np.int64)

    def step(self, rows: list[np.ndarray], bias: np.ndarray, y: np.ndarray, which: np.ndarray | None = None) -> None:
        p = logits(self.weights, rows, bias, which)
        np.exp(p, out=p)
        p *= (-1 / (p @ _ONES))[:, None]
        p[np.arange(len(p)), y] += 1
        weights, squares = _whole(self.weights), _whole(self.squares)
        for k, f in enumerate(rows):
            by = np.argsort((f - _BASE[k]).astype(np.int16), kind="stable")
            f = f[by]
            first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            size = np.diff(first, append=len(f))
            falling = np.argsort((-size).astype(np.int16), kind="stable")
            first, size = first[falling], size[falling]
            some, g = f[first], bucket_sums(p, by, first, size)
            self.seen[some] += size
            square = self.squares.take(some, axis=0)
            square += g * g
            squares[some] = _whole(square)
            g /= np.sqrt(square, out=square)
            g *= RATE
            g += self.weights.take(some, axis=0, out=square, mode="clip")
            weights[some] = _whole(g)

    def moved(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, rows in it, tokens that met them, how far they moved)."""
        for k in range(0, len(self.seen), _BLOCK):
            at = np.flatnonzero(self.seen[k : k + _BLOCK])
            if len(at):
                yield k // _BLOCK, at, self.seen[k + at], self.weights[k + at] - self.start[k + at]


class _Rounds:
    """One task's part of a round."""

    def __init__(self, shared):
        self.vocabulary, (first, self.bias), (second, self.word_bias) = shared.value
        self.classes, self.words = Steps(first), Steps(second)

    def __call__(self, tok: np.ndarray, cuts: np.ndarray) -> None:
        cls, slot = self.vocabulary.place(tok)
        ctx = contexts(tok, cuts)
        for lo in range(0, len(tok), BATCH):
            part, c = [x[lo : lo + BATCH] for x in ctx], cls[lo : lo + BATCH]
            self.classes.step(rows_of(part), self.bias, c)
            inner = np.flatnonzero(c != _LAST)
            if len(inner):
                c = c[inner]
                self.words.step(rows_of([x[inner] for x in part], c), self.word_bias, slot[lo : lo + BATCH][inner], c)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        yield from self.classes.moved()
        blocks = len(self.classes.seen) // _BLOCK
        for k, *rest in self.words.moved():
            yield (k + blocks, *rest)


def _gathered(docs: DataFrame, make: Callable, rows: int, width: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over tasks, of weight * value, of weight, and of tasks that have the row, by row. make() takes a task's tokens and then has its parts; kind: type of the values sent."""
    schema = "block int, at binary, n binary, tasks binary, value binary"

    def send(parts: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], kind: str) -> Iterator[pa.RecordBatch]:
        for k, at, n, tasks, value in parts:
            cols = [pa.array([k], pa.int32()), *[pa.array([pack(x.astype(t))], pa.binary()) for x, t in ((at, "<i4"), (n, "<i8"), (tasks, "<i4"), (value, kind))]]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "at", "n", "tasks", "value"])

    def read(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for k, *x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            at, n, tasks, value = (np.frombuffer(v, t) for v, t in zip(x, ("<i4", "<i8", "<i4", kind), strict=True))
            yield k, at, n, tasks, value.reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            for _, flat, off in chunks(b.column(0), b.column(1)):
                work = work or make()
                work(*tokens(flat, off))
        if work:
            yield from send(((k, at, n, np.ones(len(at)), value) for k, at, n, value in work.parts()), kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, at, n, met, value in read(b, kind):
                weight, tasks, total = have.setdefault(k, (np.zeros(_BLOCK, np.int64), np.zeros(_BLOCK, np.int64), np.zeros((_BLOCK, width))))
                weight[at] += n
                tasks[at] += met
                total[at] += n[:, None] * value.astype(np.float64)
        yield from send(((k, np.arange(_BLOCK), *x) for k, x in have.items()), "<f8")

    total, weight, tasks = np.zeros((rows, width)), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    summed = docs.mapInArrow(run, schema).repartition(-(-rows // _BLOCK), "block").mapInArrow(add, schema)
    for batch in summed.toArrow().to_batches():
        for k, at, n, met, value in read(batch, "<f8"):
            total[k * _BLOCK + at] += value
            weight[k * _BLOCK + at] += n
            tasks[k * _BLOCK + at] += met
    return total, weight, tasks


def reach(seen: np.ndarray, tasks: np.ndarray, enough: float) -> np.ndarray:
    """How many times the tasks' mean move one task would go that met all their tokens.

    AdaGrad's steps go as far as the root of how many there were, until the row has met `enough` tokens and stays about where it is.
    """
    own = np.maximum(seen, 1) / np.maximum(tasks, 1)
    return np.sqrt(np.minimum(seen, np.maximum(enough, own)) / own)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def neighbours(tok: np.ndarray) -> np.ndarray:
    """Counts (tail, its neighbours' buckets: before, then behind), flat."""
    tails = tail_of(tok)
    inner = np.flatnonzero((tails[1:] < TAILS) & (tails[:-1] < TAILS))
    a, b = tails[inner], tails[inner + 1]
    return np.bincount(np.r_[b * 2 * BESIDE + a % BESIDE, a * 2 * BESIDE + BESIDE + b % BESIDE], minlength=TAILS * 2 * BESIDE)


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, n of every token in the texts; and of every pair of a tail and a bucket beside it, whose h ends in _PAIR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pairs = np.zeros(TAILS * 2 * BESIDE, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                held = []
                for lo in range(0, len(u), 100_000):
                    s = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(u[s])), pa.array(n[s])], names=["h", "n"])

        for b in batches:
            for _, flat, off in chunks(b.column(0), b.column(1)):
                held.append(tokens(flat, off)[0])
                pairs += neighbours(held[-1])
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
        yield from flush()
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array((some << 12) | _PAIR), pa.array(pairs[some])], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Model:
    """vocabulary; weights and bias of classes and of words; log10 of the denominator of each class's other words."""

    def __init__(self, counts: DataFrame, pairs: DataFrame, docs: DataFrame):
        spark = docs.sparkSession
        of_tail_n, of_tail_kinds = np.zeros(TAILS + 1), np.zeros(TAILS + 1)
        for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(int(_TAIL_BITS))).alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            of_tail_n[r["tail"]], of_tail_kinds[r["tail"]] = r["n"], r["v"]
        self.n, self.v = int(of_tail_n.sum()), int(of_tail_kinds.sum())
        docs = docs.coalesce(max(2 * spark.sparkContext.defaultParallelism, math.ceil(self.n / TASK_TOKENS)))
        beside, found = np.zeros(TAILS * 2 * BESIDE), pairs.toArrow()
        beside[found.column("h").to_numpy() >> 12] = found.column("n").to_numpy()
        of_tail = np.r_[cluster(beside.reshape(TAILS, -1), CLASSES - 1), _LAST]

        hot = counts.orderBy(F.desc("n"), "h").limit(HOT).toArrow()
        h, n = hot.column("h").to_numpy().view(U), hot.column("n").to_numpy().astype(np.int64)
        listed, slots, cls = [], [], of_tail[tail_of(h)]
        in_slot = np.zeros((CLASSES, SLOTS))
        kinds = np.bincount(of_tail, of_tail_kinds, CLASSES)
        for c in range(CLASSES - 1):
            own = np.flatnonzero(cls == c)[: SLOTS - 1]
            listed.append(h[own])
            slots.append(np.arange(len(own)))
            in_slot[c, : len(own)] = n[own]
            kinds[c] -= len(own)
        size = np.bincount(of_tail, of_tail_n, CLASSES)
        in_slot[:, -1] = size - in_slot.sum(axis=1)
        self.vocabulary = Vocabulary(of_tail, np.concatenate(listed), np.concatenate(slots))
        self.log_rest = np.log10(in_slot[:, -1] + kinds + 1)
        self.bias = np.log((size + 1) / (size.sum() + CLASSES)).astype(np.float32)
        # the last slot is always open, as unknown words go there
        odds = in_slot + (in_slot > 0) * 0.5
        odds[:, -1] = in_slot[:, -1] + 1
        with np.errstate(divide="ignore"):
            self.word_bias = np.maximum(np.log(odds / odds.sum(axis=1, keepdims=True)), -1e4).astype(np.float32)
        self.weights, self.word_weights = (np.zeros((int(_BASE[-1]), k), np.float32) for k in (CLASSES, SLOTS))
        share = F.pmod(F.xxhash64(F.coalesce("doc_id", F.length("text").cast("long"))), F.lit(ROUNDS))
        for turn in range(ROUNDS if self.n else 0):
            self._learn(docs.where(share == turn))
        order = np.argsort(h)
        self.hot = spark.sparkContext.broadcast((h[order], np.log10(n[order] + 1.0)))
        self.shared = self._share(spark)

    def _share(self, spark):
        return spark.sparkContext.broadcast((self.vocabulary, (self.weights, self.bias), (self.word_weights, self.word_bias)))

    def _learn(self, docs: DataFrame) -> None:
        shared, half = self._share(docs.sparkSession), int(_BASE[-1])
        total, seen, tasks = _gathered(docs, lambda: _Rounds(shared), 2 * half, CLASSES, "<f2")
        step = (total / np.maximum(seen, 1)[:, None] * reach(seen, tasks, ENOUGH)[:, None]).astype(np.float32)
        self.weights, self.word_weights = self.weights + step[:half], self.word_weights + step[half:]
        shared.unpersist()


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the counts h, n of its tokens."""
    ship(docs.sparkSession)
    docs = text_only(docs)
    found = materialize(count_tokens(docs), "token-counts")
    is_pair = F.col("h").bitwiseAND(F.lit(int(_TAIL_BITS))) == _PAIR
    counts = found.where(~is_pair)
    return Model(counts, found.where(is_pair), docs), counts


def log10_of(tok: np.ndarray, cuts: np.ndarray, shared: tuple, log_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each token, less log10(count + 1) for those that have no slot of their own; which those are)."""
    vocabulary, (weights, bias), (word_weights, word_bias) = shared
    cls, slot = vocabulary.place(tok)
    ctx, value = contexts(tok, cuts), np.empty(len(tok))
    for lo in range(0, len(tok), BATCH):
        part, c = [x[lo : lo + BATCH] for x in ctx], cls[lo : lo + BATCH]
        value[lo : lo + BATCH] = log_likelihood(weights, rows_of(part), bias, c)
        inner = np.flatnonzero(c != _LAST)
        if len(inner):
            c = c[inner]
            value[lo + inner] += log_likelihood(word_weights, rows_of([x[inner] for x in part], c), word_bias, slot[lo : lo + BATCH][inner], c)
    value /= np.log(10)
    other = (slot == SLOTS - 1) & (cls != _LAST)
    value[other] -= log_rest[cls[other]]
    return value, other


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    hot, shared, log_rest = model.hot, model.shared, model.log_rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, logs = hot.value
        # a document's rows share a number that no other document has
        import uuid

        turn = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
        for b in batches:
            at, ids = 0, b.column(0)
            for keys, flat, off in chunks(ids, b.column(1)):
                tok, cuts = tokens(flat, off)
                value, other = log10_of(tok, cuts, shared.value, log_rest)
                order = np.argsort(tok)
                ordered = tok[order]
                near = np.minimum(np.searchsorted(top, ordered), max(0, len(top) - 1))
                hit = top[near] == ordered if len(top) else np.zeros(len(tok), bool)
                known, gain = np.zeros(len(tok), bool), np.zeros(len(tok))
                known[order] = hit
                gain[order[hit]] = logs[near[hit]]
                value[other] += gain[other]
                first = cuts[:-1]
                add = lambda x: np.add.reduceat(x, first)
                rare = np.flatnonzero(~known)
                owner = np.searchsorted(cuts, rare, "right") - 1
                n = len(keys)
                with np.errstate(over="ignore"):
                    row = _signed(mix(U(turn % 2**64) + np.arange(n, dtype=U)))
                turn += n
                zero, none = np.zeros(len(rare)), np.zeros(len(rare), np.int64)
                doc = pa.concat_arrays([ids.slice(at, n), pa.nulls(len(rare), pa.int64())])
                at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[row, row[owner]]), pa.array(np.r_[row, _signed(tok[rare])]), pa.array(np.r_[np.zeros(n, np.int32), np.ones(len(rare), np.int32)]), doc, pa.array(np.r_[np.diff(cuts), none]), pa.array(np.r_[add(known.astype(np.int64)), none]), pa.array(np.r_[add(gain), zero]), pa.array(np.r_[add(value), zero])],
                    names=["row", "h", "rare", "doc_id", "n_tokens", "n_known", "gain", "value"],
                )

    schema = "row long, h long, rare int, doc_id long, n_tokens long, n_known long, gain double, value double"
    rows = materialize(text_only(docs).mapInArrow(run, schema), "lookups")
    met = rows.join(counts.withColumnRenamed("n", "c"), "h", "left").withColumn("c", F.when(F.col("rare") == 1, F.col("c")))
    known = F.when(F.col("c").isNotNull(), 1).otherwise(0)
    # rare tokens have no slot of their own, so what their counts add is the same for both scores
    gained = F.sum(F.when(F.col("c").isNotNull(), F.log10(F.col("c") + 1.0)).otherwise(0.0))
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.sum(known)).alias("n_known"), (F.sum("gain") + gained).alias("gain"), (F.sum("value") + gained).alias("value"))
    size = float(np.log10(model.n + model.v + 1))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n_tokens") * F.lit(size)).alias("base_score"), F.col("value").alias("score"))
