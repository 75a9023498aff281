"""Tapes as streams: clean records without repeats, and bins of time with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLEAN
from ..sources import files


def read_clean(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of clean Parquet files as a stream."""
    r = spark.readStream.schema(CLEAN)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def once_each(tape: DataFrame, late: str = "1 day") -> DataFrame:
    """Trades once each; a repeat counts if it comes within late of the first."""
    return tape.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["slug", "venue", "trade_id"])


def vwap_bins(tape: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """slug, venue, start, trades, quantity, vwap of bins of time."""
    bins = tape.withWatermark("timestamp", late).groupBy("slug", "venue", F.window("timestamp", width))
    out = bins.agg(F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("quantity"), (F.sum(F.col("yes_price") * F.col("quantity")) / F.sum("quantity")).alias("vwap"))
    return out.select("slug", "venue", F.col("window.start").alias("start"), "trades", "quantity", "vwap")


def land(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there to Parquet and returns; a later call resumes after it. Data without its checkpoint is an error, as they would be appended to from the start."""
    spark = stream.sparkSession
    if files.exists(spark, path) and not files.exists(spark, checkpoint):
        raise FileExistsError(f"{path} exists without its checkpoint {checkpoint}")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
