"""How the venues' prices move together: correlation by bin, lead and lag, half-life, drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time_bin
from ..runtime import materialize
from .series import BUCKET, second_grid

EPPS_BINS = [5, 10, 30, 60, 120, 300, 600, 900, 1800]
DRIFT_HORIZONS = [10, 30, 60, 120, 300, 600]
LEAD_LAG_HORIZONS = [300, 900]
LEAST = 50
#: Regimes that are broadcast, at most.
FEW = 100_000


def vwap_bins(tape: DataFrame, bins: list[int]) -> DataFrame:
    """slug, width, bin, kalshi, polymarket: volume-weighted prices of bins in which both venues traded. A bin of no volume has no price (NaN), and is kept."""
    rows = tape.select("slug", "venue", "unix_ts", "yes_price", "quantity", F.explode(F.array(*[F.lit(b) for b in bins])).alias("width"))
    paid, volume = F.sum(F.col("yes_price") * F.col("quantity")), F.sum("quantity")
    # doubles divided by zero, which Spark's / refuses
    price = F.when(volume == 0, paid * F.lit(float("inf"))).otherwise(paid / volume)
    mean = rows.groupBy("slug", "venue", "width", time_bin("unix_ts", F.col("width")).alias("bin")).agg(price.alias("price"))
    of = lambda v: F.max(F.when(F.col("venue") == v, F.col("price"))).alias(v)
    return mean.groupBy("slug", "width", "bin").agg(of("kalshi"), of("polymarket")).where("kalshi IS NOT NULL AND polymarket IS NOT NULL")


def epps_curve(tape: DataFrame, bins: list[int] | None = None) -> DataFrame:
    """slug, width, n, corr: of the changes between adjacent bins; null if there are few or no variation."""
    b = vwap_bins(tape, bins or EPPS_BINS)
    # the bin before is an equi-join away, so that no window spans a tape
    prior = b.select("slug", "width", (F.col("bin") + F.col("width")).alias("bin"), F.col("kalshi").alias("_k"), F.col("polymarket").alias("_p"))
    d = b.join(prior.hint("merge"), ["slug", "width", "bin"]).select("slug", "width", (F.col("kalshi") - F.col("_k")).alias("dk"), (F.col("polymarket") - F.col("_p")).alias("dp"))
    flat = (F.stddev_pop("dk") == 0) | (F.stddev_pop("dp") == 0)
    # corr itself divides by zero where nothing varies, even in a branch that is not taken
    corr = F.try_divide(F.covar_pop("dk", "dp"), F.stddev_pop("dk") * F.stddev_pop("dp"))
    return d.groupBy("slug", "width").agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) < LEAST) | flat, None).otherwise(corr).alias("corr"))


def _wide(grid: DataFrame) -> DataFrame:
    of = lambda v: F.max(F.when(F.col("venue") == v, F.col("yes_price"))).alias(v)
    return grid.groupBy("slug", "ts").agg(of("kalshi"), of("polymarket"))


def changes(grid: DataFrame, horizons: list[int]) -> DataFrame:
    """slug, venue, horizon, ts, change: price at ts less that horizon seconds before. grid has a second once."""
    back, block = max(horizons), lambda c: F.floor(c / BUCKET)
    # a second goes to each day that looks back to it; within a day the earlier price is a frame of one second away, so that no grid meets itself
    rows = grid.select("slug", "venue", "ts", "yes_price", F.explode(F.sequence(block(F.col("ts")), block(F.col("ts") + back))).alias("_block"))
    w = Window.partitionBy("slug", "venue", "_block").orderBy("ts")
    then = {f"_{h}": F.first(F.struct("yes_price")).over(w.rangeBetween(-h, -h)) for h in horizons}
    own = rows.withColumns(then).where(block(F.col("ts")) == F.col("_block"))
    each = own.select("slug", "venue", "ts", "yes_price", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("then")) for h in horizons])).alias("e"))
    return each.where("e.then IS NOT NULL").select("slug", "venue", "e.horizon", "ts", (F.col("yes_price") - F.col("e.then.yes_price")).alias("change"))


def lead_lag(grid: DataFrame, horizons: list[int] | None = None, max_lag: int = 1800, step: int = 60, block: int = 86_400) -> DataFrame:
    """slug, horizon, lag, n, corr of the exchange's change at t + lag with the chain's at t.

    Each block of time sums its products over arrays of its seconds, with no row for each lag; seconds that the grid leaves out count for nothing.
    """
    horizons = horizons or LEAD_LAG_HORIZONS
    back, ahead = max_lag + max(horizons), max_lag
    sums = ["n", "m", "x", "y", "xx", "yy", "xy"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        slug, first = key[0].as_py(), key[1].as_py() * block - back
        at = table.column("ts").to_numpy() - first
        width = back + block + ahead
        there, k, p = np.zeros(width, bool), np.full(width, np.nan), np.full(width, np.nan)
        there[at] = True
        k[at] = table.column("kalshi").to_numpy(zero_copy_only=False)
        p[at] = table.column("polymarket").to_numpy(zero_copy_only=False)
        own, out = slice(back, back + block), []
        for h in horizons:
            both = np.zeros(width, bool)
            both[h:] = there[h:] & there[:-h]
            dk, dp = np.full(width, np.nan), np.full(width, np.nan)
            dk[h:], dp[h:] = k[h:] - k[:-h], p[h:] - p[:-h]
            for lag in range(-max_lag, max_lag + 1, step):
                far = slice(back + lag, back + block + lag)
                n = int((both[own] & both[far]).sum())
                x, y = dk[far], dp[own]
                ok = ~(np.isnan(x) | np.isnan(y))
                x, y = x[ok], y[ok]
                if n:
                    out.append((slug, h, lag, n, len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y))
        names = ["slug", "horizon", "lag", *sums]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 6]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    # a second goes to each block that looks back or ahead to it
    blocks = F.explode(F.sequence(F.floor((F.col("ts") - ahead) / block), F.floor((F.col("ts") + back) / block))).alias("_block")
    parts = _wide(grid).select("slug", "ts", "kalshi", "polymarket", blocks).where((F.col("ts") >= F.col("_block") * block - back) & (F.col("ts") < (F.col("_block") + 1) * block + ahead))
    done = parts.groupBy("slug", "_block").applyInArrow(run, "slug string, horizon int, lag int, n long, " + ", ".join(f"{c} double" for c in sums[1:]))
    s = done.groupBy("slug", "horizon", "lag").agg(*[F.sum(c).alias(c) for c in sums])
    spread = lambda c: F.col(f"{c}{c}") - F.col(c) * F.col(c) / F.col("m")
    # what rounding leaves of no variation is none
    some = (spread("x") > 1e-12 * F.col("xx")) & (spread("y") > 1e-12 * F.col("yy"))
    corr = (F.col("xy") - F.col("x") * F.col("y") / F.col("m")) / F.sqrt(spread("x") * spread("y"))
    return s.select("slug", "horizon", "lag", "n", F.when((F.col("m") > 1) & some, corr).alias("corr"))


def peak_lag(lags: DataFrame) -> DataFrame:
    """slug, horizon, lag, corr, leader: the greatest correlation; of equal ones the first lag."""
    best = lags.where("corr IS NOT NULL").groupBy("slug", "horizon").agg(F.max(F.struct("corr", (-F.col("lag")).alias("m"))).alias("b"))
    lag = -F.col("b.m")
    return best.select("slug", "horizon", lag.alias("lag"), F.col("b.corr").alias("corr"), F.when(lag > 0, "polymarket").when(lag < 0, "kalshi").otherwise("none").alias("leader"))


def half_life(grid: DataFrame, regimes: DataFrame, step: int = 60) -> DataFrame:
    """slug, regime, n, mean, sd, phi, half_life, resync_95 of the spread, sampled every step seconds of a regime.

    regimes: slug, regime, from_ts, to_ts (half-open). Sampling starts anew at the first second of each regime.
    """
    # written down, as it is read three times
    spread = materialize(_wide(grid).select("slug", "ts", (F.col("kalshi") - F.col("polymarket")).alias("b")), "spread")
    first = spread.groupBy("slug").agg(F.min("ts").alias("_first"))
    r = regimes.join(first, "slug").select("slug", "regime", F.greatest("from_ts", "_first").alias("_lo"), F.col("to_ts").alias("_hi"))
    # few regimes are sent to every task; more meet their tapes day by day, so that a long tape is no hot key
    keys = ["slug"]
    if regimes.limit(FEW + 1).count() <= FEW:
        r = F.broadcast(r)
    else:
        keys, day = ["slug", "_day"], lambda c: F.floor(c / 86_400)
        r = r.where("_lo < _hi").withColumn("_day", F.explode(F.sequence(day(F.col("_lo")), day(F.col("_hi") - 1))))
        spread = spread.withColumn("_day", day(F.col("ts")))
    s = spread.join(r, keys).drop("_day").where((F.col("ts") >= F.col("_lo")) & (F.col("ts") < F.col("_hi")) & (F.pmod(F.col("ts") - F.col("_lo"), F.lit(step)) == 0) & F.col("b").isNotNull())
    # the sample before is an equi-join away, so that no window spans a tape
    prior = s.select("slug", "regime", (F.col("ts") + step).alias("ts"), F.col("b").alias("_prev"))
    # samples of a grid look as small as the table that it was made from; they are not broadcast
    pairs = s.join(prior.hint("merge"), ["slug", "regime", "ts"], "left")
    fit = pairs.groupBy("slug", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("mean"), F.stddev_pop("b").alias("sd"), F.regr_slope("b", "_prev").alias("phi"))
    enough = F.col("n") >= LEAST
    life = F.when(enough & (F.col("phi") > 0) & (F.col("phi") < 1), -F.lit(0.6931471805599453) / F.ln("phi"))
    null = lambda c: F.when(enough, F.col(c)).alias(c)
    return fit.select("slug", "regime", "n", null("mean"), null("sd"), null("phi"), life.alias("half_life"), (life * 4.32).alias("resync_95"))


def samples(tape: DataFrame, regimes: DataFrame, step: int = 60) -> DataFrame:
    """slug, venue, ts, yes_price at the seconds that half_life takes of each regime, so that no second between is made."""
    return second_grid(tape, regimes.select("slug", F.col("from_ts").alias("lo"), (F.col("to_ts") - 1).alias("hi")), step, distinct=True)


def verdict(life: DataFrame, window: int, step: int = 60) -> DataFrame:
    """Adds how many half-lives the matching window spans."""
    return life.withColumn("window_half_lives", F.lit(float(window)) / (F.col("half_life") * step))


def regimes(bounds: DataFrame, shock_start: int, shock_seconds: int = 86_400) -> DataFrame:
    """slug, regime, from_ts, to_ts: all of the overlap, before the shock, and the shock."""
    hi = F.col("hi") + 1
    rows = F.array(
        F.struct(F.lit("full").alias("regime"), F.col("lo").alias("from_ts"), hi.alias("to_ts")),
        F.struct(F.lit("pre_shock").alias("regime"), F.col("lo").alias("from_ts"), F.least(hi, F.lit(shock_start)).alias("to_ts")),
        F.struct(F.lit("shock").alias("regime"), F.greatest("lo", F.lit(shock_start)).alias("from_ts"), F.least(hi, F.lit(shock_start + shock_seconds)).alias("to_ts")),
    )
    return bounds.select("slug", F.explode(rows).alias("r")).select("slug", "r.*")


#: Quantiles on either side of a wanted one between which its rank must lie, and the accuracy that makes sure of it. Of fewer rows than LEAST_ROWS all are in the bracket.
BESIDE = 0.002
ACCURACY = 10_000
LEAST_ROWS = 2000


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and a column for each wanted quantile of value, by linear interpolation between ranks; exact.

    A mergeable sketch brackets each quantile; a second pass counts what lies below the bracket, and how often each value in it
    occurs. So a window has the distinct values of a bracket, about 2 * BESIDE of the rows, and nothing holds a group's values.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    # the sketch's ranks are off by 1 / ACCURACY of the rows at most
    sides = [p for q in wanted.values() for p in (max(0.0, q - BESIDE), min(1.0, q + BESIDE))]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", sides, ACCURACY).alias("_at"))
    end = lambda i, c: F.when(F.col("_n") < LEAST_ROWS, F.col(c)).otherwise(F.col("_at")[i])
    brackets = F.array(*[F.struct(F.lit(k).alias("name"), ((F.col("_n") - 1) * F.lit(q)).alias("rank"), end(2 * i, "_lo").alias("lo"), end(2 * i + 1, "_hi").alias("hi")) for i, (k, q) in enumerate(wanted.items())])
    found = materialize(found.select(*keys, brackets.alias("_b")), "brackets")
    few = found.limit(FEW + 1).count() <= FEW
    met = rows.join(F.broadcast(found) if few else found, keys).select(*keys, "_v", F.explode("_b").alias("b")).where(F.col("_v") <= F.col("b.hi"))
    counts = met.groupBy(*keys, "b.name", "b.rank", F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.floor("rank"), F.ceil("rank")
    at = lambda r: F.min(F.when((F.col("_upto") > r) & F.col("_v").isNotNull(), F.col("_v")))
    ends = counts.withColumn("_upto", F.sum("_n").over(w)).groupBy(*keys, "name", "rank").agg(at(low).alias("a"), at(high).alias("b"))
    q = ends.select(*keys, "name", F.when(low == high, F.col("a")).otherwise((high - F.col("rank")) * F.col("a") + (F.col("rank") - low) * F.col("b")).alias("q"))
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in wanted])


def drift(grid: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """slug, venue, horizon, p50, p90, p99 of absolute changes, in cents."""
    c = changes(grid, horizons or DRIFT_HORIZONS).where("change IS NOT NULL")
    c = materialize(c.select("slug", "venue", "horizon", (F.abs("change") * 100).alias("cents")), "changes")
    return percentiles(c, ["slug", "venue", "horizon"], "cents", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
