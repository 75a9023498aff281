"""The queries on every second, against brute force over a tape whose shock starts between two sampled seconds."""

import datetime
import math
import random

import duckdb
import numpy as np
import pytest

from crossloom import queries
from crossloom.operators import series, sync

START, END = queries.SHOCK - 4013, queries.SHOCK + 4790


@pytest.fixture(scope="module")
def tape(spark, tmp_path_factory):
    rng, rows = random.Random(3), []
    times = [START, START, END, END, *[rng.randrange(START, END) for _ in range(1500)]]
    for i, t in enumerate(times):
        user = i % 2 if i < 4 else rng.randrange(2)
        ts = datetime.datetime.fromtimestamp(t, datetime.UTC)
        rows.append((i, ts, user, "click", float(rng.randrange(1, 9)), '{"k": %d}' % rng.randrange(40, 60)))
    path = str(tmp_path_factory.mktemp("tape"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    prices = {}
    for venue in (0, 1):
        last, at = None, {}
        for i, t, k in sorted((r[0], int(r[1].timestamp()), int(r[5][6:-1])) for r in rows if r[2] == venue):
            at[t] = k / 100
        prices[venue] = np.array([last := at.get(t, last) for t in range(START, END + 1)])
    return path, rows, prices[0], prices[1]


def get(spark, tape, name):
    return queries.queries()[name](spark, tape[0]).collect()


def test_every_second_has_a_price(spark, tape):
    got = {(r.venue, r.ts): r.yes_price for r in get(spark, tape, "second_ffill")}
    assert got == {(v, START + i): x for v, p in (("kalshi", tape[2]), ("polymarket", tape[3])) for i, x in enumerate(p)}


def test_half_life_has_the_shock(spark, tape):
    assert (queries.SHOCK - START) % 60
    got = {r.regime: (r.n, r["mean"], r.phi) for r in get(spark, tape, "second_half_life")}
    b, cut = tape[2] - tape[3], queries.SHOCK - START
    want = {n: x[::60] for n, x in (("full", b), ("pre_shock", b[:cut]), ("shock", b[cut:]))}
    assert set(got) == set(want)
    for name, x in want.items():
        n, mean, phi = got[name]
        assert n == len(x) and abs(mean - x.mean()) < 1e-5 and abs(phi - np.polyfit(x[:-1], x[1:], 1)[0]) < 1e-5


def test_lags_and_drift(spark, tape):
    k, p = tape[2], tape[3]
    got = {(r.horizon, r.lag): (r.n, r["corr"]) for r in get(spark, tape, "second_lead_lag")}
    want = {}
    for h in (300, 900):
        a, b = k[h:] - k[:-h], p[h:] - p[:-h]
        for lag in range(-1800, 1801, 60):
            x, y = (a[lag:], b[: len(b) - lag]) if lag >= 0 else (a[:lag], b[-lag:])
            want[h, lag] = (len(x), np.corrcoef(x, y)[0, 1])
    assert set(got) == set(want) and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-5 for x in want)
    peak = {r.horizon: r.lag for r in get(spark, tape, "second_peak_lag")}
    assert peak == {h: max((lag for g, lag in want if g == h), key=lambda lag: want[h, lag][1]) for h in (300, 900)}
    drift = {(r.venue, r.horizon): (r.p50, r.p90, r.p99) for r in get(spark, tape, "second_drift")}
    assert {h for _, h in drift} >= {10, 30, 60, 300, 600}
    for (venue, h), q in drift.items():
        s = k if venue == "kalshi" else p
        assert np.allclose(q, np.percentile(np.abs(s[h:] - s[:-h]) * 100, [50, 90, 99]), atol=1e-4)


def test_all_bins(spark, tape):
    want = {}
    for w in (5, 10, 30, 60, 120, 300, 600, 900, 1800):
        sums = {}
        for r in tape[1]:
            t = int(r[1].timestamp())
            x = sums.setdefault(t - t % w, [[0, 0], [0, 0]])[r[2]]
            x[0] += int(r[5][6:-1]) / 100 * r[4]
            x[1] += r[4]
        both = {b: [a / q for a, q in v] for b, v in sums.items() if v[0][1] and v[1][1]}
        want |= {(w, b): v for b, v in both.items()}
    got = {(r.width, r.bin): (r.kalshi, r.polymarket) for r in get(spark, tape, "vwap_all_bins")}
    assert set(got) == set(want) and all(np.allclose(got[x], want[x], atol=1e-5) for x in want)
    for r in get(spark, tape, "epps_all_bins"):
        steps = [(np.array(v) - want[r.width, b - r.width]) for (w, b), v in want.items() if w == r.width and (w, b - w) in want]
        assert r.n == len(steps)
        if r.n >= sync.LEAST:
            assert abs(r["corr"] - np.corrcoef(np.array(steps).T)[0, 1]) < 1e-4
        else:
            assert r["corr"] is None


def thin_tape(spark, tmp_path, trades):
    """Path of a table of events from (second, venue, cents, quantity)."""
    rows = [(i, datetime.datetime.fromtimestamp(t, datetime.UTC), v, "click", float(q), '{"k": %d}' % k) for i, (t, v, k, q) in enumerate(trades)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def from_sql(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return con.execute(queries.oracle_sql()[name]).fetchall()


def test_bins_without_volume_are_kept(spark, tmp_path):
    path = thin_tape(spark, tmp_path, [(START, 0, 40, 0), (START, 1, 50, 3), (START + 5, 0, 41, 2), (START + 5, 1, 52, 4), (START + 5, 1, 30, 0)])
    for name in ("vwap_all_bins", "vwap_bins"):
        rows = queries.queries()[name](spark, path).collect()
        text = lambda found: sorted(map(str, map(tuple, found)))
        assert text(rows) == text(from_sql(path, name)) and rows
        assert any(r.width == 5 and math.isnan(r.kalshi) and r.polymarket == 0.5 for r in rows) or name == "vwap_bins"


def test_correlation_of_flat_prices_is_null(spark, tmp_path):
    begin = START - START % 1800
    path = thin_tape(spark, tmp_path, [(begin + 10 * i + v, v, 40 if v else 30 + i % 7, 1) for i in range(200) for v in (0, 1)])
    for name in ("epps_all_bins", "epps_curve"):
        rows = queries.queries()[name](spark, path).collect()
        assert sorted(map(tuple, rows)) == sorted(from_sql(path, name))
    assert {r.width: (r.n, r["corr"]) for r in queries.queries()["epps_all_bins"](spark, path).collect()}[10] == (199, None)


def test_correlation_takes_bins_without_volume(spark, tmp_path):
    begin = START - START % 1800
    path = thin_tape(spark, tmp_path, [(begin + 10 * i + v, v, 30 + (i * (v + 3)) % 7, i != 9) for i in range(200) for v in (0, 1)])
    got = {r.width: (r.n, r["corr"]) for r in queries.queries()["epps_all_bins"](spark, path).collect()}
    want = {width: (n, corr) for _, width, n, corr in from_sql(path, "epps_all_bins")}
    assert str(sorted(got.items())) == str(sorted(want.items())) and got[10][0] == 199 and math.isnan(got[10][1])


def joins(df):
    """Joins of the plan that ran."""
    df.collect()
    return [line.strip(" :+-*()0123456789") for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_no_grid_is_broadcast(spark, tape):
    """Grids look as small as the table that they are made from."""
    t = queries._tape(spark, tape[0])
    bounds = series.overlap(t)
    grid = series.second_grid(t, bounds)
    plans = {"grid": joins(grid), "changes": joins(sync.changes(grid, [10, 600])), "half-life": joins(sync.half_life(grid, sync.regimes(bounds, queries.SHOCK)))}
    # but for the two venues, and the regimes
    assert not [x for name in ("grid", "changes") for x in plans[name] if x.startswith("BroadcastHashJoin")]
    assert {x.split()[0] for x in plans["half-life"] if "LeftOuter" in x} == {"SortMergeJoin"}


def test_days_of_a_grid_are_dealt_out(spark, tape):
    t = queries._tape(spark, tape[0])
    bounds = spark.createDataFrame([("m0", START, START + 40 * 86_400)], "slug string, lo long, hi long")
    plan = series.second_grid(t, bounds)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_changes_look_back_over_days(spark):
    rng = random.Random(5)
    prices = {t: rng.randrange(100) / 100 for t in range(-40, 3 * 86_400, 7) if rng.random() < 0.5}
    grid = spark.createDataFrame([("a", "kalshi", t, p if t % 5 else None) for t, p in prices.items()], "slug string, venue string, ts long, yes_price double")
    horizons = [7, 700, 86_401, 200_200]
    got = {(r.horizon, r.ts): r.change for r in sync.changes(grid, horizons).collect()}
    want = {(h, t): p - prices[t - h] if t % 5 and (t - h) % 5 else None for h in horizons for t, p in prices.items() if t - h in prices}
    assert got == want
