"""One tape of both venues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round3, round6
from ..schemas import MERGED


def chain_id(trade_id: Column, log_index: Column) -> Column:
    """Transaction without 0x, with ;log_index where there is one."""
    bare = F.regexp_replace(trade_id, "^0x", "")
    return F.when(log_index.isNotNull(), F.concat_ws(";", bare, log_index.cast("string"))).otherwise(bare)


def merge(clean: DataFrame) -> DataFrame:
    """Clean rows of both venues as schemas.MERGED; chain sizes are whole contracts, and rows under one go."""
    exchange = clean.where(F.col("venue") == "kalshi").select(
        "slug", F.col("unix_ts").alias("timestamp"), F.col("trade_id").alias("id"), F.lit("kalshi").alias("market"), F.lower("outcome").alias("side"), F.col("quantity").alias("size"), "yes_price", round6(1 - F.col("yes_price")).alias("no_price")
    )
    whole, yes = F.col("quantity").cast("long"), round3("yes_price")
    chain = clean.where((F.col("venue") == "polymarket") & (whole > 0)).select(
        "slug", F.col("unix_ts").alias("timestamp"), chain_id(F.col("trade_id"), F.col("log_index")).alias("id"), F.lit("poly").alias("market"), F.upper("outcome").alias("side"), whole.cast("double").alias("size"), yes.alias("yes_price"), round3(1 - yes).alias("no_price")
    )
    both = exchange.unionByName(chain)
    return both.select(*[F.col(f.name).cast(f.dataType) for f in MERGED])


def party_key(tx_hash: Column, maker: Column, taker: Column) -> Column:
    """The older sort key of chain trades: transaction without 0x, maker and taker."""
    return F.concat_ws("-", F.regexp_replace(tx_hash, "^0x", ""), maker, taker)


def ordered(merged: DataFrame) -> DataFrame:
    """In the tape's order: time, then id as text."""
    return merged.orderBy("slug", "timestamp", "id")


def prefer_chain(logs: DataFrame | None, fills: DataFrame | None) -> DataFrame:
    """The chain's tape where there is one, else the index's."""
    if logs is None and fills is None:
        raise ValueError("no tape of the chain venue")
    return logs if logs is not None else fills  # type: ignore[return-value]
