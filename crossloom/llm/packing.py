"""Best-fit-decreasing packing of tokenised documents into sequences.

What best-fit decreasing does depends only on how many pieces there are of each length, so the fit
is computed once from those counts: at most CAPACITY of them, however large the corpus. A segment
tree over remaining capacities finds the tightest open bin for a length in logarithmic time; bins
of equal capacity that were filled alike are kept as one run, and a run takes its pieces at once.
The resulting plan says which ranks of each length go where. Every piece gets its rank among pieces
of its length (salted by a hash of its document, with offsets from counts, so that a length which a
third of all pieces have is no hot key) and looks up its place.

Defined cases: null and empty texts are the end token alone; longer documents than CAPACITY are cut
into CAPACITY-token pieces, the first of which may be shorter; rows that repeat a doc_id are packed
each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, ship, text_only

CAPACITY = 1024
END_ID = 2
#: Salts of a length, at least; beyond that a salt has about SALT_ROWS pieces, should all have one length.
SALTS = 64
SALT_ROWS = 250_000
SPECIAL = "<|endoftext|>"


class CapacityTree:
    """Which remaining capacities have open bins; tightest(n) is the least of them that is n or more, or -1."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        while i and self.open[i] != is_open:
            self.open[i] = is_open
            i //= 2
            is_open = self.open[2 * i] or self.open[2 * i + 1] if i else False

    def tightest(self, least: int) -> int:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1 and not (i % 2 == 0 and self.open[i + 1]):
            i //= 2
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing over counts of lengths.

    Rows: length, rank (first of the run), each (pieces a bin takes), bins, sequence (first bin), offset. Pieces
    rank .. rank + each * bins - 1 of that length fill bins sequence .. sequence + bins - 1, each in turn.
    """
    tree, runs, rows, opened = CapacityTree(capacity), {}, [], 0
    for length in sorted((n for n, k in counts.items() if k and n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                bins = max(1, left // each)
                first, fill = opened, 0
                opened += bins
            else:
                first, bins = runs[room].pop()
                if not runs[room]:
                    tree.put(room, False)
                each, fill = room // length, capacity - room
            each = min(each, left)
            use = min(bins, left // each)
            rows.append((length, rank, each, use, first, fill))
            rank += each * use
            left -= each * use
            for rest, at, n in ((capacity - fill - each * length, first, use), (capacity - fill, first + use, bins - use)):
                if n and rest:
                    runs.setdefault(rest, []).append((at, n))
                    tree.put(rest, True)
    return pd.DataFrame(rows, columns=["length", "rank", "each", "bins", "sequence", "offset"], dtype="int64")


class WordCoder:
    """Byte-level BPE ids of whole texts; part codes any text without the special token's string."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.part = self._word_encoder(path)

    @staticmethod
    def _word_encoder(path: str):
        """The same vocabulary and merge ranks in a quicker library."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece != SPECIAL}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for t in texts:
            # only the file's own library knows the special token's string
            ids = self.whole.encode(t, add_special_tokens=False).ids if SPECIAL in t else self.part(t)
            yield np.fromiter(ids, np.uint32, len(ids))


_coders: dict[str, WordCoder] = {}


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids if asked for, of every document's pieces."""
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = WordCoder(path)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(keys), 500):
                rows = []
                for key, ids in zip(keys[lo : lo + 500], _coders[path].encode(texts[lo : lo + 500]), strict=True):
                    raw = np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes()
                    for k, (start, length) in enumerate(cut(len(ids) + 1, capacity)):
                        part = raw[4 * start : 4 * (start + length)]
                        rows.append((key, k, start, length, zlib.crc32(part), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return text_only(docs).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with doc_id, piece and length."""
    spark = pieces.sparkSession
    ship(spark)
    salts = max(SALTS, pieces.count() // SALT_ROWS)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "length-counts")
    # at most `capacity` rows, whatever the corpus
    totals = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    fit = spark.sparkContext.broadcast({c: v.to_numpy() for c, v in plan(totals, capacity).items()})
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")) - 1
    ranked = pieces.withColumn("_rank", rank).join(offsets.drop("_n"), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = fit.value
        # rows of the plan lie by falling length, then rising rank
        shift = int(p["rank"].max()) + int((p["each"] * p["bins"]).max()) + 1
        key = (capacity - p["length"]) * shift + p["rank"]
        i = np.searchsorted(key, (capacity - length.to_numpy()) * shift + rank.to_numpy(), "right") - 1
        nth = rank.to_numpy() - p["rank"][i]
        return pd.DataFrame({"sequence_id": p["sequence"][i] + nth // p["each"][i], "offset": p["offset"][i] + nth % p["each"][i] * length.to_numpy()})

    return ranked.withColumn("_at", where("length", "_rank")).select(*[F.col(c) for c in pieces.columns if c != "_salt"], "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. Token ids are recoverable with ``tokenize``."""
    return place(materialize(tokenize(docs, path, capacity), "pieces"), capacity)
