"""Checks of clean tapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .combine import reconcile
from .series import overlap


def structure(tape: DataFrame, sequence: str | None = None) -> DataFrame:
    """slug, venue, check, violations, ok. sequence: column of the stored order, for the check of rising time."""
    no = F.col("outcome") == "NO"
    out = lambda c: F.count_if(~((F.col(c) > 0) & (F.col(c) < 1)))
    checks = {
        "duplicate_ids": F.count(F.lit(1)) - F.count_distinct("trade_id"),
        "price_range": out("price"),
        "yes_price_range": out("yes_price"),
        "no_complement": F.count_if(no & (F.abs((1 - F.col("yes_price")) - F.col("price")) > 1e-6)),
        "quantity_positive": F.count_if(F.col("quantity") <= 0),
    }
    rows = tape.groupBy("slug", "venue").agg(*[v.cast("long").alias(k) for k, v in checks.items()])
    if sequence is not None:
        rows = rows.join(falls(tape, sequence), ["slug", "venue"])
    names = [c for c in rows.columns if c not in ("slug", "venue")]
    return rows.unpivot(["slug", "venue"], names, "check", "violations").withColumn("ok", F.col("violations") == 0)


def falls(tape: DataFrame, sequence: str) -> DataFrame:
    """slug, venue, time_order: how often time falls in the stored order. Ranges of that order count by themselves and then compare their ends."""
    ranges = tape.select("slug", "venue", F.col(sequence).alias("_seq"), "unix_ts").repartitionByRange("slug", "venue", "_seq").withColumn("_range", F.spark_partition_id())
    w = Window.partitionBy("_range", "slug", "venue").orderBy("_seq")
    inside = ranges.withColumn("_fall", F.col("unix_ts") < F.lag("unix_ts").over(w)).groupBy("slug", "venue", "_range")
    ends = inside.agg(F.count_if("_fall").alias("_n"), F.min_by("unix_ts", "_seq").alias("_first"), F.max_by("unix_ts", "_seq").alias("_last"), F.min("_seq").alias("_seq"))
    before = Window.partitionBy("slug", "venue").orderBy("_seq")
    ends = ends.withColumn("_n", F.col("_n") + F.coalesce(F.col("_first") < F.lag("_last").over(before), F.lit(False)).cast("long"))
    return ends.groupBy("slug", "venue").agg(F.sum("_n").alias("time_order"))


def only_buys(tape: DataFrame) -> DataFrame:
    """slug, ok: whether all of the exchange's rows are buys."""
    return tape.where("venue = 'kalshi'").groupBy("slug").agg(F.bool_and(F.col("side") == "BUY").alias("ok"))


def newest(tape: DataFrame, heads: DataFrame) -> DataFrame:
    """slug, venue, newest id, ok: the newest trade against the feed's (slug, venue, trade_id)."""
    last = tape.groupBy("slug", "venue").agg(F.max_by("trade_id", F.struct("unix_ts", "trade_id")).alias("newest_id"))
    return last.join(heads, ["slug", "venue"]).select("slug", "venue", "newest_id", (F.col("newest_id") == F.col("trade_id")).alias("ok"))


def complete(raw: DataFrame, counters: DataFrame) -> DataFrame:
    """Rows per market against independent counters (market, expected)."""
    return reconcile(raw, counters, "market")


def daily_gap(tape: DataFrame) -> DataFrame:
    """slug, day, kalshi, polymarket, gap: daily mean prices within the overlap, on days that both have."""
    clipped = tape.join(overlap(tape), "slug").where(F.col("unix_ts").between(F.col("lo"), F.col("hi")))
    of = lambda v: F.avg(F.when(F.col("venue") == v, F.col("yes_price"))).alias(v)
    day = F.to_date(F.timestamp_seconds("unix_ts")).alias("day")
    return clipped.groupBy("slug", day).agg(of("kalshi"), of("polymarket")).where("kalshi IS NOT NULL AND polymarket IS NOT NULL").withColumn("gap", F.col("kalshi") - F.col("polymarket"))


def overlap_stats(tape: DataFrame) -> DataFrame:
    """slug, days, median, least and greatest gap, days on which the exchange is above."""
    return daily_gap(tape).groupBy("slug").agg(F.count(F.lit(1)).alias("days"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > 0).alias("days_above"))
