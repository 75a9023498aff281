"""Schemas of raw, clean, merged and matched tapes."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in text.split(", "))])


RAW_EXCHANGE = "trade_id string, ticker string, created_time string, yes_price_dollars string, no_price_dollars string, count_fp string, taker_outcome_side string, is_block_trade boolean"
RAW_FILLS = "id string, transactionHash string, timestamp string, price string, size string, side string, maker struct<id:string>, taker struct<id:string>, market string"
RAW_LOGS = "topics array<string>, data string, transactionHash string, logIndex string, blockTimestamp string"
CLEAN = _schema("slug string, venue string, timestamp timestamp, unix_ts long, trade_id string, log_index long, outcome string, side string, price double, quantity double, notional_usd double, yes_price double, tx_hash string, maker string, taker string, is_block_trade boolean")
MERGED = _schema("slug string, timestamp long, id string, market string, side string, size double, yes_price double, no_price double")
MATCH = _schema("slug string, match_seq long, poly_time long, kalshi_time long, poly_yes double, poly_no double, kalshi_yes double, kalshi_no double, arb_size long, depleted double, poly_side string, kalshi_side string, poly_id string, kalshi_id string")
