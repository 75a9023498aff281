"""Raw and clean tapes in files, and sinks that never overwrite unless told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLEAN, RAW_EXCHANGE, RAW_FILLS, RAW_LOGS

RAW = {"exchange": RAW_EXCHANGE, "fills": RAW_FILLS, "logs": RAW_LOGS}
#: A raw record without one of these is an error.
NEEDED = {"exchange": ["trade_id", "created_time", "yes_price_dollars", "no_price_dollars", "count_fp", "taker_outcome_side"], "fills": ["id", "timestamp", "price", "size", "side", "market"], "logs": ["topics", "data", "transactionHash", "logIndex", "blockTimestamp"]}


def read_raw(spark: SparkSession, kind: str, path: str | list[str], partitions: int | None = None, folder: bool = False) -> DataFrame:
    """JSON lines, gzip or not, globs allowed; fails on malformed or incomplete records. partitions deals out gzip files, which one task each reads. folder: adds the name of the event's folder, above raw."""
    df = spark.read.schema(RAW[kind]).option("mode", "FAILFAST").json(path)
    if folder:
        df = df.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/raw/[^/]+$", 1))
    if partitions:
        df = df.repartition(partitions)
    checked = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{kind} record without {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in NEEDED[kind]}
    return df.withColumns(checked)


def same_ticker(raw: DataFrame, ticker: Column | str) -> DataFrame:
    """raw; a record of another ticker is an error when it is read."""
    other: Column = F.raise_error(F.concat(F.lit("foreign ticker "), F.coalesce("ticker", F.lit("null"))))
    return raw.withColumn("ticker", F.when(F.col("ticker") == ticker, F.col("ticker")).otherwise(other.cast("string")))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Clean tapes exported as CSV; blanks are null. Only the columns that a query needs are parsed."""
    return spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False).schema(CLEAN).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def write(df: DataFrame, path: str, force: bool = False, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Writes a table; an existing one is an error unless force."""
    w = df.write.mode("overwrite" if force else "errorifexists").format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def write_lines(lines: DataFrame, path: str, force: bool = False, gzip: bool = False) -> None:
    """Verbatim lines (column value)."""
    write(lines.select("value"), path, force, "text") if not gzip else lines.select("value").write.mode("overwrite" if force else "errorifexists").option("compression", "gzip").text(path)


def write_text(spark: SparkSession, text: str, path: str, force: bool = False) -> None:
    """A small text as one file, by whatever file system the path names; an existing one is an error unless force."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, force)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
