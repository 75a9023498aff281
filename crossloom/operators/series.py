"""Dense grids, forward fill and as-of lookup.

Nothing here needs a whole tape in one window: rows are cut into buckets of time, and each bucket takes the
last value of the earlier ones from a summary that has one row a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 86_400


def forward_fill(df: DataFrame, keys: list[str], at: str, tie: str, columns: list[str], bucket: int = BUCKET) -> DataFrame:
    """Replaces nulls of columns by the last value before them in the order of at, then tie, within keys."""
    rows = df.withColumn("_bucket", F.floor(F.col(at) / bucket))
    # rows without values tell only that their bucket is there; they are not sorted for it
    seen = rows.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])).groupBy(*keys, "_bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, tie))).alias(f"_{c}") for c in columns])
    seen = rows.select(*keys, "_bucket").distinct().join(seen.hint("merge"), [*keys, "_bucket"], "left")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select(*keys, "_bucket", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    w = Window.partitionBy(*keys, "_bucket").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    # of a grid, Spark knows only how small the table was that it was made from: left to itself it would broadcast all rows
    out = rows.join(carried.hint("merge"), [*keys, "_bucket"])
    return out.select(*[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def last_per_second(tape: DataFrame) -> DataFrame:
    """slug, venue, ts, yes_price of the last trade (greatest trade_id) of each second."""
    return tape.groupBy("slug", "venue", F.col("unix_ts").alias("ts")).agg(F.max_by("yes_price", "trade_id").alias("yes_price"))


def overlap(tape: DataFrame) -> DataFrame:
    """slug, lo, hi: the times when both venues trade; slugs without such times have no row."""
    first = lambda f, v: f(F.when(F.col("venue") == v, F.col("unix_ts")))
    b = tape.groupBy("slug").agg(*[first(f, v).alias(f"{n}_{v}") for v in ("kalshi", "polymarket") for n, f in (("lo", F.min), ("hi", F.max))])
    both = F.col("lo_kalshi").isNotNull() & F.col("lo_polymarket").isNotNull()
    return b.where(both).select("slug", F.greatest("lo_kalshi", "lo_polymarket").alias("lo"), F.least("hi_kalshi", "hi_polymarket").alias("hi")).where("lo < hi")


def second_grid(tape: DataFrame, bounds: DataFrame, step: int = 1, distinct: bool = False) -> DataFrame:
    """slug, venue, ts, yes_price for every step-th second of bounds (slug, lo, hi) from lo, filled forward; null before the first trade. distinct: each second once, should a slug have several bounds."""
    day = BUCKET - BUCKET % step
    days = bounds.where("lo <= hi").select("slug", "lo", "hi", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / day))).alias("_day"))
    # a few tapes are one small partition; their days are dealt out, as each becomes many seconds
    days = days.repartition(int(tape.sparkSession.conf.get("spark.sql.shuffle.partitions")), "slug", "_day")
    start = F.col("lo") + F.col("_day") * day
    seconds = days.select("slug", F.explode(F.sequence(start, F.least(F.col("hi"), start + day - 1), F.lit(step).cast("long"))).alias("ts"))
    # bounds of one slug may overlap
    seconds = seconds.distinct() if distinct else seconds
    venues = tape.sparkSession.createDataFrame([("kalshi",), ("polymarket",)], "venue string")
    grid = seconds.join(F.broadcast(venues)).withColumn("i", F.lit(0))
    seen = last_per_second(tape).withColumn("_seq", F.lit(""))
    return as_of(seen, grid, ["slug", "venue"], ["yes_price"], "_seq").drop("i")


def point_grid(bounds: DataFrame, points: int = 700) -> DataFrame:
    """slug, i, ts: points times evenly from lo to hi, whole seconds."""
    i = F.col("i")
    at = F.when(i == points - 1, F.col("hi")).otherwise((i * ((F.col("hi") - F.col("lo")) / F.lit(float(points - 1))) + F.col("lo")).cast("long"))
    return bounds.select("slug", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("slug", "i", at.alias("ts"))


def as_of(observed: DataFrame, grid: DataFrame, keys: list[str], values: list[str], tie: str) -> DataFrame:
    """grid (keys, i, ts) with the values of the last observation at or before ts; of equal times, the greatest tie."""
    both = observed.select(*keys, "ts", F.lit(None).cast("long").alias("i"), F.lit(0).alias("_grid"), F.col(tie).alias("_seq"), *values).unionByName(grid.select(*keys, "ts", F.col("i").cast("long").alias("i"), F.lit(1).alias("_grid")), allowMissingColumns=True)
    filled = forward_fill(both.withColumn("_order", F.struct("_grid", "_seq", "i")), keys, "ts", "_order", values)
    return filled.where("_grid = 1").select(*keys, "i", "ts", *values)
