"""Raw records of three feeds to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import abi_word, address, hex_long, round6
from ..functions.chain import token_hex, word_amount
from ..schemas import CLEAN


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _hex(token: Column | str) -> Column:
    """A token as a chain word; columns have it so already."""
    return F.lit(token_hex(token)) if isinstance(token, str) else token


def _conform(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLEAN])


def outcome_of(token: Column, yes: Column, no: Column) -> Column:
    """YES, NO, or the token itself if it is neither."""
    return F.when(token == yes, F.lit("YES")).when(token == no, F.lit("NO")).otherwise(token)


def implied_yes(outcome: Column, price: Column) -> Column:
    return F.when(outcome == "YES", price).otherwise(round6(1 - price))


def flip_side(side: Column) -> Column:
    """The taker's side from the maker's; other values raise an error."""
    up = F.upper(side)
    return F.when(up == "BUY", F.lit("SELL")).when(up == "SELL", F.lit("BUY")).otherwise(F.raise_error(F.concat(F.lit("unknown side "), F.coalesce(side, F.lit("null")))).cast("string"))


def clean_exchange(raw: DataFrame, slug: Column | str) -> DataFrame:
    """Exchange trades; the taker always buys the outcome it is long of. Columns: schemas.RAW_EXCHANGE."""
    yes, no, qty = (F.col(c).cast("double") for c in ("yes_price_dollars", "no_price_dollars", "count_fp"))
    outcome, at = F.upper("taker_outcome_side"), F.to_timestamp("created_time")
    price = F.when(outcome == "YES", yes).otherwise(no)
    rows = raw.select(
        _slug(slug), F.lit("kalshi").alias("venue"), at.alias("timestamp"), F.unix_seconds(at).alias("unix_ts"), "trade_id", outcome.alias("outcome"), F.lit("BUY").alias("side"),
        round6(price).alias("price"), qty.alias("quantity"), round6(price * qty).alias("notional_usd"), round6(yes).alias("yes_price"), "is_block_trade",
    )
    return _conform(rows)


def clean_fills(raw: DataFrame, slug: Column | str, exchange: Column | str, tokens: tuple[Column | str, Column | str]) -> DataFrame:
    """Indexed fills: size is the collateral leg in millionths, side the maker's; aggregate rows and zero prices go. Columns: schemas.RAW_FILLS."""
    price = round6(F.col("price").cast("double"))
    notional = F.col("size").cast("decimal(20,0)").cast("double") / 1e6
    outcome = outcome_of(F.col("market"), _lit(tokens[0]), _lit(tokens[1]))
    at = F.col("timestamp").cast("long")
    rows = raw.where(fill_kind(exchange) == "trade").select(
        _slug(slug), F.lit("polymarket").alias("venue"), F.timestamp_seconds(at).alias("timestamp"), at.alias("unix_ts"), F.col("id").alias("trade_id"), outcome.alias("outcome"), flip_side(F.col("side")).alias("side"),
        price.alias("price"), round6(notional / price).alias("quantity"), round6(notional).alias("notional_usd"), implied_yes(outcome, price).alias("yes_price"),
        F.col("transactionHash").alias("tx_hash"), F.col("maker.id").alias("maker"), F.col("taker.id").alias("taker"),
    )
    return _conform(rows)


def fill_kind(exchange: Column | str) -> Column:
    """aggregate (the exchange itself is the taker), unpriced, or trade."""
    return F.when(F.col("taker.id") == _lit(exchange), "aggregate").when(round6(F.col("price").cast("double")) <= 0, "unpriced").otherwise("trade")


def log_kind(exchange: Column | str) -> Column:
    """aggregate, anomaly (neither asset is the collateral), or trade."""
    zero = "0" * 64
    return F.when(address(F.col("topics")[3]) == _lit(exchange), "aggregate").when((abi_word(F.col("data"), 0) != zero) & (abi_word(F.col("data"), 1) != zero), "anomaly").otherwise("trade")


def clean_logs(raw: DataFrame, slug: Column | str, exchange: Column | str, tokens: tuple[Column | str, Column | str]) -> DataFrame:
    """Chain logs: the asset that is zero is the collateral; the maker's is tested first. Tokens are decimal ids, or columns of chain words. Columns: schemas.RAW_LOGS."""
    words = raw.where(log_kind(exchange) == "trade").select("*", *[abi_word(F.col("data"), i).alias(f"_w{i}") for i in range(4)])
    paid = F.col("_w0") == "0" * 64
    a, b = word_amount(F.col("_w2")), word_amount(F.col("_w3"))
    usdc, token = F.when(paid, a).otherwise(b), F.when(paid, b).otherwise(a)
    asset = F.when(paid, F.col("_w1")).otherwise(F.col("_w0"))
    outcome = outcome_of(asset, _hex(tokens[0]), _hex(tokens[1]))
    amounts = words.select("*", usdc.cast("double").alias("_usdc"), token.cast("double").alias("_token"), outcome.alias("_outcome"))
    price = F.when(F.col("_token") != 0, round6(F.col("_usdc") / F.col("_token")))
    at = hex_long(F.col("blockTimestamp"))
    rows = amounts.select(
        _slug(slug), F.lit("polymarket").alias("venue"), F.timestamp_seconds(at).alias("timestamp"), at.alias("unix_ts"), F.col("transactionHash").alias("trade_id"), hex_long(F.col("logIndex")).alias("log_index"),
        F.col("_outcome").alias("outcome"), F.when(paid, "SELL").otherwise("BUY").alias("side"), price.alias("price"), (F.col("_token") / 1e6).alias("quantity"), round6(F.col("_usdc") / 1e6).alias("notional_usd"),
        implied_yes(F.col("_outcome"), price).alias("yes_price"), F.col("transactionHash").alias("tx_hash"), address(F.col("topics")[2]).alias("maker"), address(F.col("topics")[3]).alias("taker"),
    )
    return _conform(rows)


def _slug(slug: Column | str) -> Column:
    return (F.lit(slug) if isinstance(slug, str) else slug).alias("slug")


def summary(clean: DataFrame) -> DataFrame:
    """Per slug and venue: trades by outcome, totals and ranges."""
    return clean.groupBy("slug", "venue").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("outcome") == "YES").alias("yes_trades"), F.count_if(F.col("outcome") == "NO").alias("no_trades"), F.sum("notional_usd").alias("notional_usd"), F.sum("quantity").alias("quantity"),
        F.min("yes_price").alias("min_yes"), F.max("yes_price").alias("max_yes"), F.min("unix_ts").alias("first_ts"), F.max("unix_ts").alias("last_ts"),
    )
