"""A two-venue tape from the generic events table, and feed records from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.clean import _conform

#: Tokens and exchange address of the records below.
TOKENS = ("11", "22")
EXCHANGE = "0x" + "e" * 40


def tape(events: DataFrame) -> DataFrame:
    """schemas.CLEAN: users are dealt to three markets and two venues, k is the price in cents."""
    cents = F.greatest(F.get_json_object("props", "$.k").cast("int"), F.lit(1))
    outcome = F.when(F.col("event_type").isin("click", "purchase", "signup"), "YES").otherwise("NO")
    rows = events.select(
        F.concat(F.lit("m"), F.pmod(F.floor(F.col("user_id") / 2), F.lit(3)).cast("string")).alias("slug"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "kalshi").otherwise("polymarket").alias("venue"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("unix_ts"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("trade_id"),
        outcome.alias("outcome"),
        F.lit("BUY").alias("side"),
        (F.when(outcome == "YES", cents).otherwise(100 - cents) / 100.0).alias("price"),
        F.col("value").alias("quantity"),
        (cents / 100.0).alias("yes_price"),
    )
    return _conform(rows)


def _cents() -> Column:
    return F.col("l_partkey") % 99 + 1


def exchange_records(lines: DataFrame) -> DataFrame:
    """schemas.RAW_EXCHANGE, a record for each order line; ticker names one of three markets."""
    dollars = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 2, "0"), F.lit("00"))
    return lines.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("trade_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("ticker"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":30:15.250Z")).alias("created_time"),
        dollars(_cents()).alias("yes_price_dollars"),
        dollars(100 - _cents()).alias("no_price_dollars"),
        F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".50")).alias("count_fp"),
        F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("taker_outcome_side"),
        (F.col("l_linenumber") == 1).alias("is_block_trade"),
    )


def _when() -> Column:
    return F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber")


def fill_records(lines: DataFrame) -> DataFrame:
    """schemas.RAW_FILLS: line 7 is the exchange's own, line 6 of another token, parts divisible by 50 have no price."""
    token = F.when(F.col("l_linenumber") == 6, "33").when(F.col("l_linestatus") == "O", TOKENS[0]).otherwise(TOKENS[1])
    party = lambda name, x: F.struct(x.alias("id")).alias(name)
    return lines.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.lit("0x"), F.hex("l_orderkey")).alias("transactionHash"),
        _when().cast("string").alias("timestamp"),
        F.when(F.col("l_partkey") % 50 == 0, "0.0000001").otherwise(F.concat(F.lit("0."), F.lpad(_cents().cast("string"), 2, "0"))).alias("price"),
        (F.col("l_quantity").cast("long") * _cents() * 10_000).cast("string").alias("size"),
        F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL").alias("side"),
        party("maker", F.concat(F.lit("0xm"), F.col("l_suppkey").cast("string"))),
        party("taker", F.when(F.col("l_linenumber") == 7, EXCHANGE).otherwise(F.lit("0xt"))),
        token.alias("market"),
    )


def log_records(lines: DataFrame) -> DataFrame:
    """schemas.RAW_LOGS: line 7 is the exchange's own, line 6 trades two tokens."""
    word = lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 64, "0")
    topic = lambda x: F.concat(F.lit("0x"), F.lpad(x, 64, "0"))
    token = F.when(F.col("l_linestatus") == "O", 11).otherwise(22)
    paid, usdc, amount = F.col("l_returnflag") == "R", F.col("l_quantity").cast("long") * _cents() * 10_000, F.col("l_quantity").cast("long") * 1_000_000
    two = F.when(F.col("l_linenumber") == 6, 33).otherwise(0)
    words = [F.when(paid, two).otherwise(token), F.when(paid, token).otherwise(two), F.when(paid, usdc).otherwise(amount), F.when(paid, amount).otherwise(usdc)]
    taker = F.when(F.col("l_linenumber") == 7, EXCHANGE[2:]).otherwise("b" * 40)
    return lines.select(
        F.array(F.lit("signature"), F.lit("order"), topic(F.lower(F.hex("l_suppkey"))), topic(taker)).alias("topics"),
        F.concat(F.lit("0x"), *[word(w) for w in words]).alias("data"),
        F.concat(F.lit("0x"), F.lower(F.hex("l_orderkey"))).alias("transactionHash"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.col("l_linenumber").cast("long") + 10))).alias("logIndex"),
        F.concat(F.lit("0x"), F.lower(F.hex(_when()))).alias("blockTimestamp"),
    )
