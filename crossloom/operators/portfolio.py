"""Positions (y, z): cash and net YES contracts by venue; settlement and running paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEDGED = 1e-9


def legs(matches: DataFrame, *keep: str) -> DataFrame:
    """slug, match_seq, book_time, venue, side, size, yes, no: two rows a match; and what else to keep of it."""
    both = F.array(*[F.struct(F.lit(v).alias("venue"), F.col(f"{v}_side").alias("side"), F.col("arb_size").alias("size"), F.col(f"{v}_yes").alias("yes"), F.col(f"{v}_no").alias("no")) for v in ("poly", "kalshi")])
    rows = matches.select("slug", "match_seq", F.greatest("poly_time", "kalshi_time").alias("book_time"), *keep, F.explode(both).alias("_leg"))
    return rows.select("slug", "match_seq", "book_time", *keep, "_leg.*")


def cash(side: Column, size: Column, yes: Column, no: Column) -> Column:
    """Change of y: buying YES pays its price; buying NO is selling YES at one less the NO price."""
    return F.when(side == "YES", -size * yes).otherwise(size * (1 - no))


def contracts(side: Column, size: Column) -> Column:
    """Change of z."""
    return F.when(side == "YES", size).otherwise(-size)


def positions(matches: DataFrame) -> DataFrame:
    """slug, venue, y, z."""
    args = [F.col(c) for c in ("side", "size", "yes", "no")]
    return legs(matches).groupBy("slug", "venue").agg(F.sum(cash(*args)).alias("y"), F.sum(contracts(*args[:2])).alias("z"))


def value(y: Column, z: Column, yes: Column | float) -> Column:
    """Worth of a position at a YES price."""
    return y + z * yes


def portfolio(matches: DataFrame) -> DataFrame:
    """slug, y and z of both venues, locked_in, hedge_delta, is_hedged."""
    by = positions(matches).groupBy("slug").agg(*[F.coalesce(F.sum(F.when(F.col("venue") == v, F.col(c))), F.lit(0)).alias(f"{c}_{v}") for v in ("poly", "kalshi") for c in ("y", "z")])
    delta = F.abs("z_poly") - F.abs("z_kalshi")
    return by.select("*", (F.col("y_poly") + F.col("y_kalshi")).alias("locked_in"), delta.alias("hedge_delta"), (F.abs(delta) <= HEDGED).alias("is_hedged"))


def settlement(matches: DataFrame, resolution: Column) -> DataFrame:
    """slug, venue, tokens, expense, payback, earnings, net; resolution: YES or NO for a row of matches."""
    args = [F.col(c) for c in ("side", "size", "yes", "no")]
    rows = legs(matches.withColumn("_res", F.upper(F.coalesce(resolution, F.lit("YES")))), "_res")
    price = F.when(F.col("side") == "YES", F.col("yes")).otherwise(F.col("no"))
    yes = F.when(F.col("_res") == "YES", 1.0).otherwise(0.0)
    out = rows.groupBy("slug", "venue").agg(
        F.sum(contracts(*args[:2])).alias("tokens"), F.sum(F.col("size") * price).alias("expense"), F.sum(F.when(F.col("side") == F.col("_res"), F.col("size")).otherwise(0)).alias("payback"), F.sum(cash(*args)).alias("_y"), F.max(yes).alias("_yes")
    )
    return out.select("slug", "venue", "tokens", "expense", "payback", (F.col("payback") - F.col("expense")).alias("earnings"), value(F.col("_y"), F.col("tokens"), F.col("_yes")).alias("net"))


#: Bits of an order's lowest stretches; each level above takes as many more.
BITS = 16
LEVELS = 4


def running_sums(rows: DataFrame, key: str, order: str, sums: list[str], level: int = 1, whole: bool = True) -> DataFrame:
    """rows (key, order: a long from 0 on) with their running sums in that order within key; whole: the row's own value included.

    Orders that are equal but for their low bits are a stretch, so no window has more than 2 ** BITS orders. What lies before a
    stretch is a running sum over the stretches' totals, found the same way, with stretches of stretches, up to the highest bits.
    """
    until = Window.unboundedPreceding, 0 if whole else -1
    if level == LEVELS:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(*until)
        return rows.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})
    part = f"_stretch{level}"
    rows = rows.withColumn(part, F.shiftright(order, BITS))
    totals = rows.groupBy(key, part).agg(*[F.sum(c).alias(c) for c in sums])
    before = running_sums(totals, key, part, sums, level + 1, False).select(key, part, *[F.col(c).alias(f"_0{c}") for c in sums])
    w = Window.partitionBy(key, part).orderBy(order).rowsBetween(*until)
    return rows.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).join(before, [key, part]).withColumns({c: F.col(c) + F.col(f"_0{c}") for c in sums}).drop(part, *[f"_0{c}" for c in sums])


def path(matches: DataFrame) -> DataFrame:
    """Running z by venue and locked-in cash in the order of execution, with the time both legs were filled."""
    step = lambda v: (F.col(f"{v}_side"), F.col("arb_size"), F.col(f"{v}_yes"), F.col(f"{v}_no"))
    rows = matches.select("slug", "match_seq", F.greatest("poly_time", "kalshi_time").alias("book_time"), (cash(*step("poly")) + cash(*step("kalshi"))).alias("locked_in"), *[contracts(*step(v)[:2]).alias(f"z_{v}") for v in ("poly", "kalshi")])
    return running_sums(rows, "slug", "match_seq", ["locked_in", "z_poly", "z_kalshi"]).select("slug", "match_seq", "book_time", "locked_in", "z_poly", "z_kalshi")
