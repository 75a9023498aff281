"""Words of hexadecimal chain data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(topic: Column) -> Column:
    """Address in the last 20 bytes of a 32-byte topic."""
    return F.concat(F.lit("0x"), F.right(topic, F.lit(40)))


def hex_long(x: Column) -> Column:
    """Hexadecimal text with or without 0x, up to 16 digits, as a long."""
    return F.conv(F.regexp_replace(x, "^0x", ""), 16, 10).cast("long")


def abi_word(data: Column, i: int) -> Column:
    """The i-th 32-byte word as 64 hexadecimal digits."""
    return F.substring(data, 3 + 64 * i, 64)


def word_amount(word: Column) -> Column:
    """A word as decimal(20,0); words of more than 16 digits raise an error."""
    big = F.ltrim(F.left(word, F.lit(48)), F.lit("0")) != ""
    low = F.conv(F.right(word, F.lit(16)), 16, 10).cast("decimal(20,0)")
    return F.when(big, F.raise_error(F.concat(F.lit("amount exceeds 64 bits: "), word)).cast("decimal(20,0)")).otherwise(low)


def token_hex(token: int | str) -> str:
    """A decimal token id as 64 hexadecimal digits."""
    return format(int(token), "064x")
