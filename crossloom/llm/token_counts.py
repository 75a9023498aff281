"""Token counts through a cache of digests.

A text is known by the SHA-256 digest of its normalised content, a tokenizer by that of its file and its
library's version. Digests of a table's texts are joined to the counts that the cache has for this tokenizer; only
distinct texts that it lacks are encoded, once each, and their counts are appended to it. A cache is a folder of
Parquet files, one folder for each tokenizer version and run in it: runs do not touch each other's files, a run that fails leaves
counts that are right, and rows that repeat count once.

Normalised content is the text itself for byte-level BPE, which tells all texts apart, and the text with
escaped spaces as spaces for sentencepiece models, which read both alike.

Digests are made distinct before the cache is joined, and texts before they are shuffled, so that copies of one text meet as
one row for each task at most. Where the cache lacks no more than FEW texts, their digests (32 bytes each) are broadcast
and other texts are not shuffled at all; beyond that digests meet by a join.

Defined cases: a null text counts as empty and has no tokens; empty and very long texts are texts like all others;
rows that repeat a doc_id, and rows with a null one, are each answered on their own; an empty table gives an empty
result; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import SPECIAL, WordCoder
from .parts import parts
from .runtime import materialize, shared_dir, ship, text_only

LIMIT = 512
#: Digests that may be broadcast.
FEW = 100_000
#: Words a worker remembers between texts; beyond that it forgets all.
REMEMBER = 400_000
#: Counts in a file of the cache, about.
FILE_ROWS = 2_000_000


def version_of(path: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    with open(path, "rb") as f:
        own = hashlib.sha256(f.read())
    own.update(version("sentencepiece" if path.endswith(".model") else "tokenizers").encode())
    return own.hexdigest()


def normalised(text: Column, path: str) -> Column:
    """Content that decides the count."""
    return F.replace(text, F.lit("▁"), F.lit(" ")) if path.endswith(".model") else text


class _Sizes(dict):
    """Number of ids of each word, found when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.encode(word))
        return n


def _splits_by_word(path: str) -> bool:
    """Whether the file is plain byte-level BPE, which WordCoder knows."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return plain and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and [t["content"] for t in spec["added_tokens"]] == [SPECIAL]


def counter(path: str) -> Callable[[str], int]:
    """Number of tokens of a text as the file's library gives them, without tokens that it adds."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    if not _splits_by_word(path):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return lambda text: len(whole.encode(text, add_special_tokens=False))
    coder = WordCoder(path)
    sizes = _Sizes(coder.part)

    def count(text: str) -> int:
        if SPECIAL in text:
            return len(coder.whole.encode(text, add_special_tokens=False))
        if len(sizes) > REMEMBER:
            sizes.clear()
        return sum(map(sizes.__getitem__, parts(text)))

    return count


_counters: dict[str, Callable[[str], int]] = {}


def encode(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of rows with a digest and a text."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = counter(path)
        count = _counters[path]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


class Cache:
    """Counts by digest for one tokenizer version, in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str, path: str):
        self.spark, self.folder = spark, f"{folder}/version={version_of(path)}"

    def read(self) -> DataFrame:
        """digest, n_tokens; each digest once."""
        schema = "digest binary, n_tokens long"
        try:
            rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, n: int) -> None:
        counts.coalesce(1 + n // FILE_ROWS).write.parquet(f"{self.folder}/run={uuid.uuid4().hex}")


def count_tokens(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, encoded (whether this call has encoded the text) of every row. Without a folder, a new cache is made in the cluster's shared one."""
    spark = docs.sparkSession
    cache = Cache(spark, folder or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}", path)
    texts = text_only(docs).withColumn("digest", F.unhex(F.sha2(normalised(F.col("text"), path), 256)))
    seen = materialize(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "text-digests")
    met = materialize(seen.select("digest").distinct().join(cache.read(), "digest", "left"), "digests-met")
    misses, hits = met.where(F.col("n_tokens").isNull()).select("digest"), met.where(F.col("n_tokens").isNotNull())
    n = misses.count()
    known = hits.select("*", F.lit(False).alias("encoded"))
    if n:
        fresh = materialize(encode(_texts_of(texts.select("digest", "text"), misses, n, n < met.count()), path), "fresh-counts")
        cache.append(fresh, n)
        known = known.unionByName(fresh.select("*", F.lit(True).alias("encoded")))
    return seen.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", "encoded")


def _texts_of(texts: DataFrame, misses: DataFrame, n: int, some: bool) -> DataFrame:
    """digest, text of each of n misses, once; some: whether other texts are no misses."""
    if some and n <= FEW:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    once = texts.groupBy("digest").agg(F.first("text").alias("text"))
    return once.join(misses, "digest", "left_semi") if some and n > FEW else once


def over_limit(docs: DataFrame, path: str, limit: int = LIMIT, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    return count_tokens(docs, path, folder).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
