"""Shared folders, worker imports and Arrow plumbing of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Text bytes that a task works on at a time; one longer document is a batch of its own.
CHUNK_BYTES = 1 << 21


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One is set only where the session names none and runs on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="crossloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession, factor: int = 4) -> int:
    """Number of key ranges of blob shuffles; follows the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def text_only(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id (long) and text (string; null: empty), nothing else."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def compressed(texts: DataFrame) -> DataFrame:
    """The first column (a long) and z: the second one's UTF-8 bytes, compressed, for shuffles; then the other columns as they are."""
    name, _, *others = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            small = pa.array([z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), small, *b.columns[2:]], names=[name, "z", *others])

    return texts.mapInArrow(run, StructType([StructField(name, LongType()), StructField("z", BinaryType()), *[StructField(c, texts.schema[c].dataType) for c in others]]))


def expanded(z: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x) for x in z.to_pylist()], pa.large_binary())


def chunks(ids: pa.Array, text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, flat UTF-8 bytes, offsets) for runs of whole documents of about limit bytes. A null id becomes -1."""
    col = text.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    key = np.asarray(pc.fill_null(ids, -1).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield key[at:to], data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def blobs(table: pa.Table, name: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid else np.empty(0, dtype) for x in table.column(name)]
