"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from .functions import fixed3, round3, round6, time_bin
from .operators import clean, combine, match, merge, portfolio, quality, series, sync
from .plans import report

WINDOW = 300
#: Start of the day that the half-life query sets apart.
SHOCK = 1_705_276_800
GRID_POINTS = 700

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = _WITH + sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.tape(_read(spark, sf_dir, "events"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(_tape(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.aligned(_merged(spark, sf_dir))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match(_aligned(spark, sf_dir), F.lit(WINDOW))


def _r(c: str, n: int = 6) -> F.Column:
    return F.round(c, n).alias(c)


_WITH = """
WITH RECURSIVE tape AS (SELECT *, CASE WHEN outcome = 'YES' THEN cents ELSE 100 - cents END / 100.0::DOUBLE AS price, cents / 100.0::DOUBLE AS yes_price FROM (
  SELECT 'm' || (user_id // 2) % 3 AS slug, CASE WHEN user_id % 2 = 0 THEN 'kalshi' ELSE 'polymarket' END AS venue,
    floor(epoch_us(ts) / 1000000)::BIGINT AS unix_ts, lpad(event_id::VARCHAR, 12, '0') AS trade_id,
    CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'YES' ELSE 'NO' END AS outcome, value AS quantity,
    greatest((props::JSON->>'k')::INT, 1) AS cents FROM events)),
merged AS (
  SELECT slug, unix_ts AS timestamp, trade_id AS id, 'kalshi' AS market, lower(outcome) AS side, quantity AS size, yes_price,
    printf('%.6f', 1 - yes_price)::DOUBLE AS no_price FROM tape WHERE venue = 'kalshi'
  UNION ALL SELECT slug, unix_ts, trade_id, 'poly', outcome, trunc(quantity), printf('%.3f', yes_price)::DOUBLE,
    printf('%.3f', 1 - printf('%.3f', yes_price)::DOUBLE)::DOUBLE FROM tape WHERE venue = 'polymarket' AND trunc(quantity) > 0),
starts AS (SELECT slug, greatest(min(timestamp) FILTER (market = 'kalshi'), min(timestamp) FILTER (market = 'poly')) AS start FROM merged GROUP BY slug
  HAVING count(*) FILTER (market = 'kalshi') > 0 AND count(*) FILTER (market = 'poly') > 0),
aligned AS (SELECT m.* FROM merged m JOIN starts USING (slug) WHERE timestamp >= start),
bounds AS (SELECT slug, greatest(min(unix_ts) FILTER (venue = 'kalshi'), min(unix_ts) FILTER (venue = 'polymarket')) AS lo,
  least(max(unix_ts) FILTER (venue = 'kalshi'), max(unix_ts) FILTER (venue = 'polymarket')) AS hi FROM tape GROUP BY slug),
seconds AS (SELECT slug, venue, unix_ts AS ts, arg_max(yes_price, trade_id) AS yes_price FROM tape GROUP BY ALL)
"""


@_register("SELECT slug, venue, unix_ts, trade_id, outcome, 'BUY' AS side, price, quantity, yes_price FROM tape")
def tape_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tape(spark, sf_dir).select("slug", "venue", "unix_ts", "trade_id", "outcome", "side", "price", "quantity", "yes_price")


@_register("SELECT * FROM merged")
def tape_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@_register("SELECT * FROM aligned")
def tape_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).drop("_key", "_index")


@_register("SELECT slug, venue, outcome, count(*) AS n FROM tape GROUP BY ALL")
def count_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tape(spark, sf_dir).groupBy("slug", "venue", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT slug, market, count(*) AS n, round(sum(size), 2) AS size FROM merged GROUP BY ALL")
def venue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).groupBy("slug", "market").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size"), 2).alias("size"))


@_register("SELECT slug, venue, min(yes_price) AS min_yes, max(yes_price) AS max_yes, min(unix_ts) AS first_ts, max(unix_ts) AS last_ts, count(*) AS trades, round(sum(quantity), 2) AS quantity FROM tape GROUP BY ALL")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.summary(_tape(spark, sf_dir)).select("slug", "venue", "min_yes", "max_yes", "first_ts", "last_ts", "trades", _r("quantity", 2))


@_register("""SELECT slug, venue, "check", violations, violations = 0 AS ok FROM (UNPIVOT (SELECT slug, venue,
  count(*) - count(DISTINCT trade_id) AS duplicate_ids, count(*) FILTER (NOT (price > 0 AND price < 1)) AS price_range, count(*) FILTER (NOT (yes_price > 0 AND yes_price < 1)) AS yes_price_range,
  count(*) FILTER (outcome = 'NO' AND abs((1 - yes_price) - price) > 1e-6) AS no_complement, count(*) FILTER (quantity <= 0) AS quantity_positive, count(*) FILTER (fall) AS time_order
  FROM (SELECT *, unix_ts < lag(unix_ts) OVER (PARTITION BY slug, venue ORDER BY trade_id) AS fall FROM tape) GROUP BY slug, venue) ON COLUMNS(* EXCLUDE (slug, venue)) INTO NAME "check" VALUE violations)""")  # fmt: skip
def structure_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.structure(_tape(spark, sf_dir), "trade_id")


@_register("SELECT slug, true AS ok FROM tape WHERE venue = 'kalshi' GROUP BY slug")
def only_buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.only_buys(_tape(spark, sf_dir))


@_register("SELECT slug, venue, arg_max(trade_id, (unix_ts, trade_id)) AS newest_id, true AS ok FROM tape GROUP BY slug, venue")
def newest_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tape(spark, sf_dir)
    heads = t.groupBy("slug", "venue").agg(F.max("trade_id").alias("trade_id"))
    return quality.newest(t, heads)


@_register("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 <> 0")
def dedup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping shards of order lines; orders divisible by three belong to another market."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.pmod("l_orderkey", F.lit(3)).cast("string").alias("market"))
    shards = [rows.where("l_linenumber <= 4"), rows.where("l_linenumber >= 3")]
    return combine.combine(shards, "id", ["1", "2"]).select("l_orderkey", "l_linenumber")


@_register("""SELECT count(*) AS rows, count(*) FILTER (l_orderkey % 3 = 0) AS foreign_rows, count(*) FILTER (l_orderkey % 3 <> 0) - count(DISTINCT CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey || '_' || l_linenumber END) AS duplicates
  FROM (SELECT * FROM lineitem WHERE l_linenumber <= 4 UNION ALL SELECT * FROM lineitem WHERE l_linenumber >= 3)""")  # fmt: skip
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_linenumber", F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.pmod("l_orderkey", F.lit(3)).cast("string").alias("market"))
    return combine.combine_counts(rows.where("l_linenumber <= 4").unionByName(rows.where("l_linenumber >= 3")), ["1", "2"])


@_register("SELECT coalesce(a.market, b.market) AS market, coalesce(got, 0) AS got, expected, coalesce(got, 0) = expected AS complete FROM (SELECT l_returnflag AS market, count(*) AS got FROM lineitem WHERE l_linenumber < 7 GROUP BY 1) a FULL JOIN (SELECT l_returnflag AS market, count(*) AS expected FROM lineitem GROUP BY 1) b ON a.market = b.market")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "market")
    return quality.complete(rows.where("l_linenumber < 7"), rows.groupBy("market").agg(F.count(F.lit(1)).alias("expected")))


@_register("SELECT count(*) FILTER (l_linenumber <= 2) AS missing, count(*) FILTER (l_linenumber > 5) AS extra FROM lineitem")
def tape_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return combine.same_rows(rows.where("l_linenumber <= 5"), rows.where("l_linenumber > 2"))


@_register("SELECT l_orderkey, l_linenumber, side, flipped, notional, quantity FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS flipped, round(l_extendedprice * 1000000)::BIGINT / 1000000 AS notional, round(round(l_extendedprice * 1000000)::BIGINT / 1000000 / (l_discount + 0.5::DOUBLE), 4) AS quantity FROM lineitem)")
def side_flip_and_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL")
    notional = F.round(F.col("l_extendedprice") * 1_000_000).cast("long") / 1_000_000
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", side.alias("side"), clean.flip_side(side).alias("flipped"), notional.alias("notional"), F.round(notional / (F.col("l_discount") + 0.5), 4).alias("quantity"))


@_register("""SELECT 'm' || l_suppkey % 3 AS slug, 'kalshi' AS venue, epoch(date_trunc('day', l_shipdate))::BIGINT + l_linenumber * 3600 + 1815 AS unix_ts, l_orderkey || '_' || l_linenumber AS trade_id, outcome, 'BUY' AS side,
  price, l_quantity + 0.5 AS quantity, printf('%.6f', price * (l_quantity + 0.5))::DOUBLE AS notional_usd, c / 100.0::DOUBLE AS yes_price, l_linenumber = 1 AS is_block_trade
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'YES' ELSE 'NO' END AS outcome, CASE WHEN l_returnflag = 'R' THEN c ELSE 100 - c END / 100.0::DOUBLE AS price FROM (SELECT *, l_partkey % 99 + 1 AS c FROM lineitem))""")  # fmt: skip
def raw_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange records decoded to clean trades."""
    got = clean.clean_exchange(adapters.exchange_records(_read(spark, sf_dir, "lineitem")), F.col("ticker"))
    return got.select("slug", "venue", "unix_ts", "trade_id", "outcome", "side", "price", "quantity", "notional_usd", "yes_price", "is_block_trade")


_OUTCOME = "CASE WHEN l_linestatus = 'O' THEN 'YES' ELSE 'NO' END"
_CHAIN = f"""SELECT 'e' AS slug, 'polymarket' AS venue, epoch(l_shipdate)::BIGINT + l_linenumber AS unix_ts, *, floor(l_quantity) * c / 100.0::DOUBLE AS notional FROM (SELECT *, l_partkey % 99 + 1 AS c, l_orderkey || '_' || l_linenumber AS id, {_OUTCOME} AS own FROM lineitem)"""


@_register(f"""SELECT slug, venue, unix_ts, id AS trade_id, outcome, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, c / 100.0::DOUBLE AS price, printf('%.6f', notional / (c / 100.0::DOUBLE))::DOUBLE AS quantity, printf('%.6f', notional)::DOUBLE AS notional_usd,
  CASE WHEN outcome = 'YES' THEN c / 100.0::DOUBLE ELSE printf('%.6f', 1 - c / 100.0::DOUBLE)::DOUBLE END AS yes_price, printf('0x%X', l_orderkey) AS tx_hash, '0xm' || l_suppkey AS maker, '0xt' AS taker
  FROM (SELECT *, CASE WHEN l_linenumber = 6 THEN '33' ELSE own END AS outcome FROM ({_CHAIN})) WHERE l_linenumber <> 7 AND l_partkey % 50 <> 0""")  # fmt: skip
def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed fills decoded to clean trades."""
    got = clean.clean_fills(adapters.fill_records(_read(spark, sf_dir, "lineitem")), "e", adapters.EXCHANGE, adapters.TOKENS)
    return got.select("slug", "venue", "unix_ts", "trade_id", "outcome", "side", "price", "quantity", "notional_usd", "yes_price", "tx_hash", "maker", "taker")


@_register(f"""SELECT slug, venue, unix_ts, printf('0x%x', l_orderkey) AS trade_id, l_linenumber + 10::BIGINT AS log_index, own AS outcome, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, c / 100.0::DOUBLE AS price, floor(l_quantity) AS quantity, printf('%.6f', notional)::DOUBLE AS notional_usd,
  CASE WHEN own = 'YES' THEN c / 100.0::DOUBLE ELSE printf('%.6f', 1 - c / 100.0::DOUBLE)::DOUBLE END AS yes_price, '0x' || lpad(printf('%x', l_suppkey), 40, '0') AS maker, '0x' || repeat('b', 40) AS taker FROM ({_CHAIN}) WHERE l_linenumber NOT IN (6, 7)""")  # fmt: skip
def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain logs decoded to clean trades."""
    got = clean.clean_logs(adapters.log_records(_read(spark, sf_dir, "lineitem")), "e", adapters.EXCHANGE, adapters.TOKENS)
    return got.select("slug", "venue", "unix_ts", "trade_id", "log_index", "outcome", "side", "price", "quantity", "notional_usd", "yes_price", "maker", "taker")


@_register("""SELECT 'fills' AS feed, CASE WHEN l_linenumber = 7 THEN 'aggregate' WHEN l_partkey % 50 = 0 THEN 'unpriced' ELSE 'trade' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'logs', CASE WHEN l_linenumber = 7 THEN 'aggregate' WHEN l_linenumber = 6 THEN 'anomaly' ELSE 'trade' END, count(*) FROM lineitem GROUP BY ALL""")
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of the chain's feeds are trades, aggregates, unpriced or anomalies."""
    lines = _read(spark, sf_dir, "lineitem")
    fills = adapters.fill_records(lines).select(F.lit("fills").alias("feed"), clean.fill_kind(adapters.EXCHANGE).alias("kind"))
    logs = adapters.log_records(lines).select(F.lit("logs").alias("feed"), clean.log_kind(adapters.EXCHANGE).alias("kind"))
    return fills.unionByName(logs).groupBy("feed", "kind").agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT printf('%x', l_orderkey) || ';' || (l_linenumber + 10) AS id, printf('%x', l_orderkey) AS key, l_linenumber + 10::BIGINT AS place, floor(l_quantity) AS size FROM lineitem WHERE l_linenumber NOT IN (6, 7) AND floor(l_quantity) > 0")
def chain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the chain's merged rows, with the parts that order them."""
    logs = clean.clean_logs(adapters.log_records(_read(spark, sf_dir, "lineitem")), "e", adapters.EXCHANGE, adapters.TOKENS)
    return match.with_order(merge.merge(logs)).select("id", F.col("_key").alias("key"), F.col("_index").alias("place"), "size")


@_register("SELECT slug, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM (SELECT m.*, greatest(min(timestamp) FILTER (market = 'kalshi') OVER w, min(timestamp) FILTER (market = 'poly') OVER w) AS start FROM merged m JOIN (SELECT slug, min(timestamp) + 86400 AS lo, max(timestamp) - 86400 AS hi FROM merged GROUP BY slug) b USING (slug) WHERE timestamp BETWEEN lo AND hi WINDOW w AS (PARTITION BY slug)) WHERE timestamp >= start GROUP BY slug")
def cutoff_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned tape between cutoffs a day inside its ends."""
    m = _merged(spark, sf_dir)
    bounds = m.groupBy("slug").agg((F.min("timestamp") + 86_400).alias("start_ts"), (F.max("timestamp") - 86_400).alias("end_ts"))
    return match.aligned(m, bounds).groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@_register("SELECT l_orderkey, l_linenumber, CASE WHEN x = 0.0005 THEN 0.001 ELSE printf('%.3f', x)::DOUBLE END AS r3, printf('%.6f', x / 7)::DOUBLE AS r6, CASE WHEN x = 0.0005 THEN '0.001' ELSE printf('%.3f', x) END AS f3 FROM (SELECT *, l_extendedprice / 8 AS x FROM lineitem)")
def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") / 8
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", round3(x).alias("r3"), round6(x / 7).alias("r6"), fixed3(x).alias("f3"))


@_register("SELECT slug, day, round(kalshi, 6) AS kalshi, round(polymarket, 6) AS polymarket, round(kalshi - polymarket, 6) AS gap FROM (SELECT slug, make_timestamp(unix_ts * 1000000)::DATE AS day, avg(yes_price) FILTER (venue = 'kalshi') AS kalshi, avg(yes_price) FILTER (venue = 'polymarket') AS polymarket FROM tape JOIN bounds USING (slug) WHERE unix_ts BETWEEN lo AND hi GROUP BY ALL) WHERE kalshi IS NOT NULL AND polymarket IS NOT NULL")
def daily_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.daily_gap(_tape(spark, sf_dir)).select("slug", "day", _r("kalshi"), _r("polymarket"), _r("gap"))


@_register("SELECT slug, count(*) AS days, round(median(k - p), 6) AS median_gap, round(min(k - p), 6) AS min_gap, round(max(k - p), 6) AS max_gap, count(*) FILTER (k > p) AS days_above FROM (SELECT slug, make_timestamp(unix_ts * 1000000)::DATE AS day, avg(yes_price) FILTER (venue = 'kalshi') AS k, avg(yes_price) FILTER (venue = 'polymarket') AS p FROM tape JOIN bounds USING (slug) WHERE unix_ts BETWEEN lo AND hi GROUP BY ALL) WHERE k IS NOT NULL AND p IS NOT NULL GROUP BY slug")
def overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overlap_stats(_tape(spark, sf_dir)).select("slug", "days", _r("median_gap"), _r("min_gap"), _r("max_gap"), "days_above")


@_register("SELECT * FROM bounds WHERE lo < hi")
def overlap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.overlap(_tape(spark, sf_dir))


@_register("SELECT * FROM seconds")
def second_last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_per_second(_tape(spark, sf_dir))


#: Seconds between the points of the grids here.
STEP = 60
_GRID = f""", days AS (SELECT * FROM bounds WHERE lo < hi),
grid AS (SELECT g.slug, g.venue, g.ts, o.yes_price FROM (SELECT slug, venue, unnest(range(lo, hi + 1, {STEP})) AS ts FROM days CROSS JOIN (VALUES ('kalshi'), ('polymarket')) v(venue)) g ASOF LEFT JOIN seconds o ON g.slug = o.slug AND g.venue = o.venue AND g.ts >= o.ts),
pr AS (SELECT slug, ts, max(yes_price) FILTER (venue = 'kalshi') AS k, max(yes_price) FILTER (venue = 'polymarket') AS p FROM grid GROUP BY ALL) """


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tape(spark, sf_dir)
    return series.second_grid(t, series.overlap(t), STEP)


@_register(_GRID + "SELECT slug, venue, ts, yes_price FROM grid")
def grid_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@_register(f"""SELECT g.slug, g.venue, g.i, g.ts, o.yes_price FROM (SELECT slug, venue, i, CASE WHEN i = {GRID_POINTS - 1} THEN hi ELSE trunc(i * ((hi - lo) / {GRID_POINTS - 1}.0::DOUBLE) + lo)::BIGINT END AS ts FROM (SELECT * FROM bounds WHERE lo < hi) CROSS JOIN (SELECT unnest(range(0, {GRID_POINTS})) AS i) CROSS JOIN (VALUES ('kalshi'), ('polymarket')) v(venue)) g
  ASOF LEFT JOIN seconds o ON g.slug = o.slug AND g.venue = o.venue AND g.ts >= o.ts""")  # fmt: skip
def asof_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tape(spark, sf_dir)
    venues = spark.createDataFrame([("kalshi",), ("polymarket",)], "venue string")
    grid = series.point_grid(series.overlap(t), GRID_POINTS).join(F.broadcast(venues))
    return series.as_of(t.select("slug", "venue", F.col("unix_ts").alias("ts"), "trade_id", "yes_price"), grid, ["slug", "venue"], ["yes_price"], "trade_id")


_VWAP = """, wide AS (SELECT slug, width, bin, max(p) FILTER (venue = 'kalshi') AS k, max(p) FILTER (venue = 'polymarket') AS p FROM (SELECT slug, venue, width, unix_ts - unix_ts % width AS bin, sum(yes_price * quantity) / sum(quantity) AS p FROM tape CROSS JOIN (VALUES {bins}) b(width) GROUP BY ALL) GROUP BY slug, width, bin HAVING k IS NOT NULL AND p IS NOT NULL) """
_WIDE_BINS = [300, 1800, 3600, 14_400]


def _vwap_sql(bins: list[int]) -> str:
    return _VWAP.replace("{bins}", ", ".join(f"({b})" for b in bins))


_VWAP_BINS = "SELECT slug, width, bin, round(k, 6) AS kalshi, round(p, 6) AS polymarket FROM wide"
_EPPS = """SELECT slug, width, count(*) AS n, CASE WHEN count(*) < 50 OR stddev_pop(dk) = 0 OR stddev_pop(dp) = 0 THEN NULL ELSE round(corr(dk, dp), 5) END AS corr FROM (SELECT a.slug, a.width, a.k - b.k AS dk, a.p - b.p AS dp FROM wide a JOIN wide b ON a.slug = b.slug AND a.width = b.width AND a.bin = b.bin + b.width) GROUP BY slug, width"""


@_register(_vwap_sql(_WIDE_BINS) + _VWAP_BINS)
def vwap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.vwap_bins(_tape(spark, sf_dir), _WIDE_BINS).select("slug", "width", "bin", _r("kalshi"), _r("polymarket"))


@_register(_vwap_sql(_WIDE_BINS) + _EPPS)
def epps_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.epps_curve(_tape(spark, sf_dir), _WIDE_BINS).select("slug", "width", "n", _r("corr", 5))


_LAGS = _GRID + """, ch AS (SELECT a.slug, h AS horizon, a.ts, a.k - b.k AS k, a.p - b.p AS p FROM pr a CROSS JOIN (VALUES (300), (900)) v(h) JOIN pr b ON a.slug = b.slug AND a.ts = b.ts + h),
far AS (SELECT slug, horizon, ts, ts + lag AS at, lag, p FROM ch CROSS JOIN (SELECT unnest(range(-1800, 1801, 60)) AS lag)),
lags AS (SELECT f.slug, f.horizon, lag, count(*) AS n, corr(k.k, f.p) AS corr FROM far f JOIN ch k ON k.slug = f.slug AND k.horizon = f.horizon AND k.ts = f.at GROUP BY ALL) """


@_register(_LAGS + "SELECT slug, horizon, lag::INT AS lag, n, round(corr, 5) AS corr FROM lags")
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.lead_lag(_grid(spark, sf_dir)).select("slug", "horizon", "lag", "n", _r("corr", 5))


@_register(_LAGS + "SELECT slug, horizon, lag::INT AS lag, CASE WHEN lag > 0 THEN 'polymarket' WHEN lag < 0 THEN 'kalshi' ELSE 'none' END AS leader FROM (SELECT slug, horizon, arg_max(lag, (corr, -lag)) AS lag FROM lags WHERE corr IS NOT NULL GROUP BY ALL)")
def peak_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.peak_lag(sync.lead_lag(_grid(spark, sf_dir))).select("slug", "horizon", "lag", "leader")


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tape(spark, sf_dir)
    regimes = sync.regimes(series.overlap(t), SHOCK)
    return sync.half_life(sync.samples(t, regimes), regimes)


_LIFE = f""", days AS (SELECT * FROM bounds WHERE lo < hi),
reg AS (SELECT slug, 'full' AS regime, lo AS f, hi + 1 AS t FROM days UNION ALL SELECT slug, 'pre_shock', lo, least(hi + 1, {SHOCK}) FROM days UNION ALL SELECT slug, 'shock', greatest(lo, {SHOCK}), least(hi + 1, {SHOCK + 86400}) FROM days),
points AS (SELECT DISTINCT slug, unnest(range(f, t, 60)) AS ts FROM reg),
grid AS (SELECT g.slug, g.venue, g.ts, o.yes_price FROM (SELECT * FROM points CROSS JOIN (VALUES ('kalshi'), ('polymarket')) v(venue)) g ASOF LEFT JOIN seconds o ON g.slug = o.slug AND g.venue = o.venue AND g.ts >= o.ts),
b AS (SELECT slug, ts, max(yes_price) FILTER (venue = 'kalshi') - max(yes_price) FILTER (venue = 'polymarket') AS b FROM grid GROUP BY ALL),
s AS (SELECT slug, regime, b, lag(b) OVER (PARTITION BY slug, regime ORDER BY ts) AS q FROM b JOIN reg USING (slug) WHERE ts >= f AND ts < t AND (ts - f) % 60 = 0 AND b IS NOT NULL),
fit AS (SELECT slug, regime, count(*) AS n, avg(b) AS mean, stddev_pop(b) AS sd, regr_slope(b, q) AS phi FROM s GROUP BY ALL)"""


_LIFE_FIT = "\nSELECT slug, regime, n, CASE WHEN n >= 50 THEN round(mean, 5) END AS mean, CASE WHEN n >= 50 THEN round(sd, 5) END AS sd, CASE WHEN n >= 50 THEN round(phi, 5) END AS phi, CASE WHEN n >= 50 AND phi > 0 AND phi < 1 THEN round(-ln(2) / ln(phi), 3) END AS half_life FROM fit"


@_register(_LIFE + _LIFE_FIT)
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled every minute from the begin of each regime, as the measure is defined."""
    return sync.verdict(_life(spark, sf_dir), WINDOW).select("slug", "regime", "n", _r("mean", 5), _r("sd", 5), _r("phi", 5), _r("half_life", 3))


@_register(_LIFE + f"SELECT slug, regime, round({WINDOW} / (-ln(2) / ln(phi) * 60), 3) AS window_half_lives, round(-ln(2) / ln(phi) * 4.32, 3) AS resync_95 FROM fit WHERE n >= 50 AND phi > 0 AND phi < 1")
def window_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many half-lives of the spread the matching window spans."""
    life = sync.verdict(_life(spark, sf_dir), WINDOW)
    return life.where("half_life IS NOT NULL").select("slug", "regime", _r("window_half_lives", 3), _r("resync_95", 3))


def _drift_sql(horizons: list[int]) -> str:
    return _GRID + f"""SELECT slug, venue, horizon, round(quantile_cont(c, 0.5), 5) AS p50, round(quantile_cont(c, 0.9), 5) AS p90, round(quantile_cont(c, 0.99), 5) AS p99 FROM (SELECT a.slug, a.venue, h AS horizon, abs(a.yes_price - b.yes_price) * 100 AS c FROM (SELECT *, ts - h AS back FROM grid CROSS JOIN (VALUES {', '.join(f'({h})' for h in horizons)}) v(h)) a JOIN grid b ON a.slug = b.slug AND a.venue = b.venue AND a.back = b.ts) WHERE c IS NOT NULL GROUP BY slug, venue, horizon"""


@_register(_drift_sql([60, 300, 600]))
def drift_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.drift(_grid(spark, sf_dir), [60, 300, 600]).select("slug", "venue", "horizon", _r("p50", 5), _r("p90", 5), _r("p99", 5))


# The same on every second of the overlap, with all bins and horizons. The queries above sample every STEP-th second
# from its begin, as their SQL does. The filled grid, lags and drift of every second of whole tables are too slow in SQL, so tests check these by brute force.
def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tape(spark, sf_dir)
    return series.second_grid(t, series.overlap(t))


@_register()
def second_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(spark, sf_dir)


@_register()
def second_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.lead_lag(_seconds(spark, sf_dir)).select("slug", "horizon", "lag", "n", _r("corr", 5))


@_register()
def second_peak_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.peak_lag(sync.lead_lag(_seconds(spark, sf_dir))).select("slug", "horizon", "lag", "leader")


@_register(_LIFE + _LIFE_FIT)
def second_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = sync.half_life(_seconds(spark, sf_dir), sync.regimes(series.overlap(_tape(spark, sf_dir)), SHOCK))
    return sync.verdict(life, WINDOW).select("slug", "regime", "n", _r("mean", 5), _r("sd", 5), _r("phi", 5), _r("half_life", 3))


@_register()
def second_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.drift(_seconds(spark, sf_dir)).select("slug", "venue", "horizon", _r("p50", 5), _r("p90", 5), _r("p99", 5))


@_register(_vwap_sql(sync.EPPS_BINS) + _VWAP_BINS)
def vwap_all_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.vwap_bins(_tape(spark, sf_dir), sync.EPPS_BINS).select("slug", "width", "bin", _r("kalshi"), _r("polymarket"))


@_register(_vwap_sql(sync.EPPS_BINS) + _EPPS)
def epps_all_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.epps_curve(_tape(spark, sf_dir)).select("slug", "width", "n", _r("corr", 5))


@_register(f"SELECT slug, k.timestamp AS kalshi_time, k.id AS kalshi_id, k.yes_price AS kalshi_yes, p.timestamp AS poly_time, p.id AS poly_id, p.yes_price AS poly_yes FROM aligned k JOIN aligned p USING (slug) WHERE k.market = 'kalshi' AND p.market = 'poly' AND abs(k.timestamp - p.timestamp) <= {WINDOW} AND abs(k.yes_price - p.yes_price) >= 1e-4")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.candidate_pairs(_aligned(spark, sf_dir), WINDOW)


_COMPONENTS = f""", comp AS (SELECT *, sum(cut) OVER (PARTITION BY slug ORDER BY timestamp, market, id ROWS UNBOUNDED PRECEDING)::BIGINT AS component FROM (
  SELECT *, (coalesce(next_p - last_k > {WINDOW}, true) AND coalesce(next_k - last_p > {WINDOW}, true))::INT AS cut FROM (SELECT *,
    max(timestamp) FILTER (market = 'kalshi') OVER b AS last_k, max(timestamp) FILTER (market = 'poly') OVER b AS last_p, min(timestamp) FILTER (market = 'kalshi') OVER a AS next_k, min(timestamp) FILTER (market = 'poly') OVER a AS next_p
    FROM aligned WHERE size > 0 WINDOW b AS (PARTITION BY slug ORDER BY timestamp, market, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY slug ORDER BY timestamp, market, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))) """


@_register(_COMPONENTS + "SELECT slug, id, market, component FROM comp")
def match_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.components(_aligned(spark, sf_dir), F.lit(WINDOW)).select("slug", "id", "market", "component")


_SWEEP = [10, 30, 60, 300]


def _matcher_sql(windows: list[int]) -> str:
    """The matcher as a recursion: a step takes the earlier head of a component and its first partner, or drops it."""
    row = "{t: timestamp, yes: yes_price, no: no_price, size: size, id: id}"
    one = "STRUCT(t BIGINT, yes DOUBLE, no DOUBLE, size DOUBLE, id VARCHAR)"
    less = lambda x: f"{{t: {x}.t, yes: {x}.yes, no: {x}.no, size: {x}.size - s, id: {x}.id}}"
    return _COMPONENTS + f""", parts AS (SELECT slug, component, list({row} ORDER BY timestamp, id) FILTER (market = 'kalshi') AS k, list({row} ORDER BY timestamp, id) FILTER (market = 'poly') AS p
  FROM comp GROUP BY ALL HAVING count(*) FILTER (market = 'kalshi') > 0 AND count(*) FILTER (market = 'poly') > 0),
steps AS (SELECT slug, component, w, 0::BIGINT AS n, k, p, NULL::{one} AS mk, NULL::{one} AS mp, NULL::DOUBLE AS s FROM parts CROSS JOIN (VALUES {', '.join(f'({w})' for w in windows)}) v(w)
  UNION ALL SELECT slug, component, w, n + (j > 0)::BIGINT, CASE WHEN a THEN mine ELSE theirs END, CASE WHEN a THEN theirs ELSE mine END, CASE WHEN j > 0 THEN CASE WHEN a THEN me ELSE it END END, CASE WHEN j > 0 THEN CASE WHEN a THEN it ELSE me END END, s
  FROM (SELECT slug, component, w, n, a, me, it, j, s, CASE WHEN j > 0 AND me.size - s > 0 THEN list_concat([{less('me')}], own[2:]) ELSE own[2:] END AS mine,
      CASE WHEN j = 0 THEN other WHEN it.size - s > 0 THEN list_concat(other[1:j - 1], [{less('it')}], other[j + 1:]) ELSE list_concat(other[1:j - 1], other[j + 1:]) END AS theirs
    FROM (SELECT *, other[j] AS it, least(me.size, other[j].size) AS s
      FROM (SELECT *, coalesce(list_position(list_transform(other, lambda x: x.t <= me.t + w AND abs(x.yes - me.yes) >= 1e-4), true), 0) AS j
        FROM (SELECT *, own[1] AS me FROM (SELECT slug, component, w, n, k[1].t <= p[1].t AS a, CASE WHEN k[1].t <= p[1].t THEN k ELSE p END AS own, CASE WHEN k[1].t <= p[1].t THEN p ELSE k END AS other FROM steps WHERE len(k) > 0 AND len(p) > 0)))))),
matches AS (SELECT slug, w, component * 4294967296 + n - 1 AS match_seq, mp.t AS poly_time, mk.t AS kalshi_time, mp.yes AS poly_yes, mp.no AS poly_no, mk.yes AS kalshi_yes, mk.no AS kalshi_no, trunc(s)::BIGINT AS arb_size, s AS depleted,
  CASE WHEN mp.yes > mk.yes THEN 'NO' ELSE 'YES' END AS poly_side, CASE WHEN mp.yes > mk.yes THEN 'YES' ELSE 'NO' END AS kalshi_side, mp.id AS poly_id, mk.id AS kalshi_id FROM steps WHERE mk IS NOT NULL) """  # fmt: skip


_MATCHES = _matcher_sql([WINDOW])
_LEGS = _MATCHES + """, legs AS (SELECT slug, match_seq, 'poly' AS venue, poly_side AS side, arb_size AS size, poly_yes AS yes, poly_no AS no FROM matches UNION ALL SELECT slug, match_seq, 'kalshi', kalshi_side, arb_size, kalshi_yes, kalshi_no FROM matches),
pos AS (SELECT slug, venue, sum(CASE WHEN side = 'YES' THEN -size * yes ELSE size * (1 - no) END) AS y, sum(CASE WHEN side = 'YES' THEN size ELSE -size END)::BIGINT AS z, sum(size * CASE WHEN side = 'YES' THEN yes ELSE no END) AS expense, sum(CASE WHEN side = 'YES' THEN size ELSE 0 END)::BIGINT AS payback, sum(CASE WHEN side = 'NO' THEN size ELSE 0 END)::BIGINT AS payback_no FROM legs GROUP BY ALL) """
_PATH = """, path AS (SELECT slug, match_seq, greatest(poly_time, kalshi_time) AS book_time, sum(CASE WHEN poly_side = 'YES' THEN -arb_size * poly_yes ELSE arb_size * (1 - poly_no) END + CASE WHEN kalshi_side = 'YES' THEN -arb_size * kalshi_yes ELSE arb_size * (1 - kalshi_no) END) OVER w AS locked_in,
  (sum(CASE WHEN poly_side = 'YES' THEN arb_size ELSE -arb_size END) OVER w)::BIGINT AS z_poly, (sum(CASE WHEN kalshi_side = 'YES' THEN arb_size ELSE -arb_size END) OVER w)::BIGINT AS z_kalshi FROM matches WINDOW w AS (PARTITION BY slug ORDER BY match_seq ROWS UNBOUNDED PRECEDING)) """  # fmt: skip


@_register(_MATCHES + "SELECT * EXCLUDE (w) FROM matches")
def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


@_register(_MATCHES + "SELECT slug, timestamp, market, id AS trade_id, side, printf('%.3f', size) AS size, printf('%.3f', yes_price) AS yes_price, printf('%.3f', no_price) AS no_price FROM aligned SEMI JOIN (SELECT slug, 'poly' AS market, poly_id AS id FROM matches UNION SELECT slug, 'kalshi', kalshi_id FROM matches) USING (slug, market, id)")
def matched_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _aligned(spark, sf_dir)
    return match.matched_trades(rows, match.match(rows, F.lit(WINDOW)))


def _settled(spark: SparkSession, sf_dir: str, resolution: str) -> DataFrame:
    return portfolio.settlement(_matches(spark, sf_dir), F.lit(resolution)).select("slug", "venue", "tokens", _r("expense", 3), "payback", _r("earnings", 3), _r("net", 3))


@_register(_LEGS + "SELECT slug, venue, z AS tokens, round(expense, 3) AS expense, payback, round(payback - expense, 3) AS earnings, round(y + z, 3) AS net FROM pos")
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir, "YES")


@_register(_LEGS + "SELECT slug, venue, z AS tokens, round(expense, 3) AS expense, payback_no AS payback, round(payback_no - expense, 3) AS earnings, round(y, 3) AS net FROM pos")
def pair_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settlement, should the outcome be NO."""
    return _settled(spark, sf_dir, "NO")


@_register(_matcher_sql(_SWEEP) + "SELECT slug, w::INT AS window_seconds, count(*) AS matches, sum(arb_size)::BIGINT AS contracts, round(sum(arb_size * abs(poly_yes - kalshi_yes)), 3) AS locked_in FROM matches GROUP BY ALL")
def window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.sweep(_aligned(spark, sf_dir), _SWEEP).select("slug", "window_seconds", "matches", "contracts", _r("locked_in", 3))


@_register(_LEGS + "SELECT slug, round(sum(y), 3) AS locked_in, abs(sum(z) FILTER (venue = 'poly'))::BIGINT - abs(sum(z) FILTER (venue = 'kalshi'))::BIGINT AS hedge_delta, abs(abs(sum(z) FILTER (venue = 'poly')) - abs(sum(z) FILTER (venue = 'kalshi'))) <= 1e-9 AS is_hedged FROM pos GROUP BY slug")
def locked_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.portfolio(_matches(spark, sf_dir)).select("slug", _r("locked_in", 3), F.col("hedge_delta").cast("long").alias("hedge_delta"), "is_hedged")


@_register(_MATCHES + _PATH + "SELECT slug, match_seq, book_time, round(locked_in, 3) AS locked_in, z_poly, z_kalshi FROM path")
def portfolio_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.path(_matches(spark, sf_dir)).select("slug", "match_seq", "book_time", _r("locked_in", 3), "z_poly", "z_kalshi")


@_register(_MATCHES + "SELECT slug, venue, unix_ts, lpad(match_seq::VARCHAR, 20, '0') AS trade_id, yes_price FROM (SELECT slug, 'kalshi' AS venue, kalshi_time AS unix_ts, match_seq, kalshi_yes AS yes_price FROM matches UNION ALL SELECT slug, 'polymarket', poly_time, match_seq, poly_yes FROM matches)")
def match_price_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape of the matched prices alone."""
    return report.price_path_of_matches(_matches(spark, sf_dir))


@_register(_MATCHES + _PATH + f""", ends AS (SELECT slug, min(book_time) AS lo, max(book_time) AS hi FROM path GROUP BY slug),
points AS (SELECT slug, i::BIGINT AS i, CASE WHEN i = {GRID_POINTS - 1} THEN hi ELSE trunc(i * ((hi - lo) / {GRID_POINTS - 1}.0::DOUBLE) + lo)::BIGINT END AS ts FROM ends CROSS JOIN (SELECT unnest(range(0, {GRID_POINTS})) AS i)),
booked AS (SELECT slug, book_time, arg_max(z_poly, match_seq) AS z_poly, arg_max(z_kalshi, match_seq) AS z_kalshi, arg_max(locked_in, match_seq) AS locked_in FROM path GROUP BY ALL)
SELECT p.slug, p.i, p.ts, k.yes_price AS kalshi, c.yes_price AS polymarket, b.z_poly, b.z_kalshi, round(b.locked_in, 3) AS locked_in FROM points p ASOF LEFT JOIN booked b ON p.slug = b.slug AND p.ts >= b.book_time
  ASOF LEFT JOIN (SELECT * FROM seconds WHERE venue = 'kalshi') k ON p.slug = k.slug AND p.ts >= k.ts ASOF LEFT JOIN (SELECT * FROM seconds WHERE venue = 'polymarket') c ON p.slug = c.slug AND p.ts >= c.ts""")  # fmt: skip
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, positions and locked-in cash at the points of a chart."""
    got = report.chart_points(_tape(spark, sf_dir), _matches(spark, sf_dir), GRID_POINTS)
    return got.select("slug", "i", "ts", "kalshi", "polymarket", "z_poly", "z_kalshi", _r("locked_in", 3))


@_register("SELECT slug, venue, unix_ts - unix_ts % 3600 AS bin, count(*) AS trades, round(sum(quantity), 2) AS quantity FROM tape GROUP BY ALL")
def hourly_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tape(spark, sf_dir).groupBy("slug", "venue", time_bin("unix_ts", 3600).alias("bin")).agg(F.count(F.lit(1)).alias("trades"), F.round(F.sum("quantity"), 2).alias("quantity"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
