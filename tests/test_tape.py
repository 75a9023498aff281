"""Clean-up, combination, series, reports, feeds, streams."""

import json

import pytest
from pyspark.sql import functions as F

from crossloom import config
from crossloom.functions import round3, round6
from crossloom.operators import clean, combine, match, merge, quality, series, sync
from crossloom.plans import report
from crossloom.schemas import CLEAN, RAW_FILLS, RAW_LOGS
from crossloom.sources import feeds, files
from crossloom.streaming import tape as stream

TOKENS = ("11", "22")
EXCHANGE = "0x" + "e" * 40


def clean_rows(spark, rows):
    """rows: (venue, unix_ts, trade_id, yes_price, quantity)."""
    df = spark.createDataFrame(rows, "venue string, unix_ts long, trade_id string, yes_price double, quantity double")
    full = df.withColumns({"slug": F.lit("e"), "timestamp": F.timestamp_seconds("unix_ts"), "outcome": F.lit("YES"), "side": F.lit("BUY"), "price": F.col("yes_price")})
    return clean._conform(full)


def test_rounding_is_that_of_the_exact_value(spark):
    values = [0.0005, 0.0025, 0.0045, 0.7145, 0.90899999842, 0.1235, 2.5, -0.0005]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(round3("x").alias("a"), round6("x").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(round(v, 3), round(v, 6)) for v in values]


def test_fills(spark):
    row = lambda i, price, size, side, taker="0xt", market="11": (i, "0xh", "1700000000", price, size, side, ("0xm",), (taker,), market)
    raw = spark.createDataFrame([row("a", "0.29", "870000000", "BUY"), row("b", "0.71", "355000000", "SELL", market="22"), row("c", "0.5", "1", "BUY", EXCHANGE), row("d", "0.0000001", "1", "BUY")], RAW_FILLS)
    got = {r.trade_id: r for r in clean.clean_fills(raw, "e", EXCHANGE, TOKENS).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].quantity, got["a"].notional_usd, got["a"].side, got["a"].outcome) == (3000.0, 870.0, "SELL", "YES")
    assert (got["b"].quantity, got["b"].notional_usd, got["b"].side, got["b"].yes_price) == (500.0, 355.0, "BUY", 0.29)


def test_logs(spark):
    word = lambda n: format(n, "064x")
    topic = lambda a: "0x" + "0" * 24 + a[2:]
    row = lambda data, taker="0x" + "b" * 40, at="0x5": (["s", "o", topic("0x" + "a" * 40), topic(taker)], "0x" + "".join(map(word, data)), "0xhash", at, "0x64000000")
    raw = spark.createDataFrame([row([0, 11, 5_000_000, 10_000_000]), row([22, 0, 4_000_000, 1_000_000], at="0x10"), row([11, 22, 1, 1]), row([0, 11, 1, 1], EXCHANGE), row([0, 11, 3, 0], at="0x7")], RAW_LOGS)
    got = {r.log_index: r for r in clean.clean_logs(raw, "e", EXCHANGE, TOKENS).collect()}
    assert set(got) == {5, 16, 7}
    assert (got[5].side, got[5].price, got[5].quantity, got[5].outcome, got[5].taker) == ("SELL", 0.5, 10.0, "YES", "0x" + "b" * 40)
    assert (got[16].side, got[16].price, got[16].yes_price, got[16].outcome) == ("BUY", 0.25, 0.75, "NO")
    assert got[7].price is None and got[7].yes_price is None
    assert sorted(r[0] for r in raw.select(clean.log_kind(EXCHANGE)).collect()) == ["aggregate", "anomaly", "trade", "trade", "trade"]


def test_merge_drops_fractions_of_contracts(spark):
    t = clean_rows(spark, [("kalshi", 5, "k", 0.93, 0.5), ("polymarket", 5, "0xp", 0.90899999842, 0.99), ("polymarket", 6, "0xq", 0.90899999842, 3.7)])
    got = {r.id: r for r in merge.merge(t).collect()}
    assert set(got) == {"k", "q"}
    assert (got["k"].size, got["k"].no_price, got["k"].side) == (0.5, 0.07, "yes")
    assert (got["q"].size, got["q"].yes_price, got["q"].no_price, got["q"].side) == (3.0, 0.909, 0.091, "YES")


def test_combine(spark, tmp_path):
    a = spark.createDataFrame([("1", "11"), ("2", "11"), ("3", "99")], "id string, market string")
    b = spark.createDataFrame([("2", "11"), ("4", "22")], "id string, market string")
    assert sorted(r.id for r in combine.combine([a, b], "id", list(TOKENS)).collect()) == ["1", "2", "4"]
    c = combine.combine_counts(a.unionByName(b), list(TOKENS)).collect()[0]
    assert (c.rows, c.foreign_rows, c.duplicates) == (5, 1, 1)
    lines = spark.createDataFrame([(json.dumps({"id": i, "market": m}),) for i, m in (("1", "11"), ("1", "11"), ("2", "99"))], "value string")
    out = combine.combine_lines(lines, list(TOKENS))
    files.write_lines(out, str(tmp_path / "x"), gzip=True)
    assert files.read_lines(spark, str(tmp_path / "x")).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_lines(out, str(tmp_path / "x"))
    keys = spark.createDataFrame([("0xab", "m", "t")], "h string, m string, t string").select(merge.party_key(F.col("h"), F.col("m"), F.col("t")))
    assert keys.collect()[0][0] == "ab-m-t"
    r = combine.reconcile(a, spark.createDataFrame([("11", 2), ("22", 1)], "market string, expected long")).collect()
    assert {x.market: x.complete for x in r} == {"11": True, "22": False, "99": None}


def test_raw_reader_fails_on_incomplete_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"id": "1", "timestamp": "5"}) + "\n")
    with pytest.raises(Exception, match="without"):
        files.read_raw(spark, "fills", str(tmp_path / "r.jsonl")).collect()


def test_structure_and_gap(spark):
    t = clean_rows(spark, [("kalshi", 10, "a", 0.5, 1.0), ("kalshi", 10, "a", 1.0, 0.0), ("kalshi", 86_500, "b", 0.4, 1.0), ("polymarket", 5, "c", 0.6, 1.0), ("polymarket", 86_600, "d", 0.6, 1.0), ("polymarket", 90, "e", 0.8, 1.0)])
    bad = {r.check: r.violations for r in quality.structure(t).where("venue = 'kalshi'").collect()}
    assert bad == {"duplicate_ids": 1, "price_range": 1, "yes_price_range": 1, "no_complement": 0, "quantity_positive": 1}
    assert [(r.kalshi, r.polymarket) for r in quality.daily_gap(t).collect()] == [(0.75, 0.8)]
    assert quality.daily_gap(t.where("unix_ts < 10 OR venue = 'kalshi'")).collect() == []


def test_grid_and_as_of(spark):
    series_bucket, series.BUCKET = series.BUCKET, 7
    try:
        t = clean_rows(spark, [("kalshi", 3, "a", 0.1, 1.0), ("kalshi", 3, "b", 0.2, 1.0), ("kalshi", 20, "c", 0.3, 1.0), ("polymarket", 10, "d", 0.9, 1.0)])
        bounds = spark.createDataFrame([("e", 2, 25)], "slug string, lo long, hi long")
        got = {(r.venue, r.ts): r.yes_price for r in series.second_grid(t, bounds).collect()}
    finally:
        series.BUCKET = series_bucket
    assert len(got) == 48 and got["kalshi", 2] is None and got["kalshi", 3] == 0.2 and got["kalshi", 19] == 0.2 and got["kalshi", 25] == 0.3 and got["polymarket", 9] is None and got["polymarket", 24] == 0.9
    assert {(r.venue, r.ts): r.yes_price for r in series.second_grid(t, bounds, 5).collect()} == {k: v for k, v in got.items() if (k[1] - 2) % 5 == 0}
    points = [r.ts for r in series.point_grid(bounds, 4).orderBy("i").collect()]
    assert points == [2, 9, 17, 25]


def test_sync_needs_enough_samples(spark):
    t = clean_rows(spark, [(v, 60 * i, f"{v}{i}", 0.5 + (i % 7) / 100, 1.0) for i in range(80) for v in ("kalshi", "polymarket")])
    got = {r.width: r.corr for r in sync.epps_curve(t, [60, 600]).collect()}
    assert abs(got[60] - 1) < 1e-9 and got[600] is None
    bounds = series.overlap(t)
    grid = series.second_grid(t, bounds, 60)
    peak = sync.peak_lag(sync.lead_lag(grid, [60], 300, 60)).collect()[0]
    assert peak.lag == 0 and abs(peak.corr - 1) < 1e-9
    assert {r.regime: r.n for r in sync.half_life(grid, sync.regimes(bounds, 60 * 40)).collect()} == {"full": 80, "pre_shock": 40, "shock": 40}
    # more regimes than are broadcast
    few, sync.FEW = sync.FEW, 0
    try:
        assert {r.regime: r.n for r in sync.half_life(grid, sync.regimes(bounds, 60 * 40)).collect()} == {"full": 80, "pre_shock": 40, "shock": 40}
    finally:
        sync.FEW = few


def test_events(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/event.json").write_text(json.dumps({"slug": "a", "kalshi_ticker": "T", "polymarket_condition_id": "0x1", "notes": "n"}))
    e = config.load_event(str(tmp_path))
    assert (e.name, e.window_seconds, e.chart_title, e.other) == ("a", 300, "a", {"notes": "n"})
    assert config.event_from_argv(str(tmp_path), ["a"]) == e and len(config.load_all(str(tmp_path))) == 1
    with pytest.raises(FileNotFoundError):
        config.load_event(str(tmp_path), "b")
    assert config.events_frame(spark, [e]).collect()[0].resolution == "YES"


def test_report(spark):
    t = clean_rows(spark, [("kalshi", 5, "k", 0.4, 10.0), ("polymarket", 6, "p", 0.6, 10.0), ("kalshi", 50, "l", 0.4, 10.0), ("polymarket", 60, "q", 0.6, 4.0)])
    m = match.match(match.aligned(merge.merge(t)), F.lit(300))
    points = report.chart_points(t, m, 5)
    assert points.count() == 5
    page = report.chart_page(points.toPandas(), "e", "title", 2)
    assert "<svg" in page and '"locked_in"' in page
    from crossloom.operators import portfolio

    text = report.results_text(portfolio.settlement(m, F.lit(None).cast("string")), "e")
    assert text.startswith("Poly tokens: -") and "Net: " in text


def fake_trades(url, payload):
    trade = lambda i: {"trade_id": i, "ticker": "T", "created_time": "2024-01-01T00:00:00Z", "yes_price_dollars": "0.5", "no_price_dollars": "0.5", "count_fp": "1", "taker_outcome_side": "yes", "is_block_trade": False}
    if "cursor=2" in url:
        return {"trades": [trade("b"), trade("c")], "cursor": ""}
    return {"trades": [trade("a"), trade("b")], "cursor": "2"}


FILLS = [{"id": f"{i:03d}", "transactionHash": "0x", "timestamp": str(t), "price": "0.5", "size": "1", "side": "BUY", "maker": {"id": "m"}, "taker": {"id": "t"}, "market": {"id": "11"}} for i, t in enumerate([1, 2, 2, 2, 2, 2, 2, 3, 4, 9])]


def fake_fills(url, payload):
    v = payload["variables"]
    if v["first"] > 100:
        raise feeds.FeedError("slow", slow=True)
    rows = [f for f in FILLS if int(v["from"]) <= int(f["timestamp"]) < int(v["to"]) and f["id"] > v["after"]]
    rows.sort(key=lambda f: f["id"] if "orderBy: id" in payload["query"] else (int(f["timestamp"]), f["id"]))
    return {"data": {"fills": rows[: min(3, v["first"])]}}


def test_feeds(monkeypatch):
    r = feeds._TradesReader({"transport": "tests.test_tape:fake_trades", "url": "u", "ticker": "T"})
    assert [x[0] for x in r.read(None)] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="foreign"):
        list(feeds._TradesReader({"transport": "tests.test_tape:fake_trades", "url": "u", "ticker": "U"}).read(None))
    monkeypatch.setattr(feeds, "LEAST_PAGE", 3)
    options = {"transport": "tests.test_tape:fake_fills", "url": "u", "tokens": "11", "start": 0, "end": 10, "shards": 3, "limit": 3}
    reader = feeds._FillsReader(options)
    got = [x[0] for p in reader.partitions() for x in reader.read(p)]
    assert sorted(got) == [f["id"] for f in FILLS] and len(set(got)) == len(got)


def fake_logs(url, payload):
    (q,) = payload["params"]
    lo, hi = int(q["fromBlock"], 16), int(q["toBlock"], 16)
    asked.append((lo, hi))
    if hi - lo > 3:
        hint = f" this range should work: [{hex(lo)}, {hex(lo + 2)}]" if lo % 2 else ""
        return {"error": {"message": "response too large" + hint}}
    return {"result": [{"topics": [], "data": "0x" + format(11, "064x"), "transactionHash": f"0x{b:x}", "logIndex": "0x0", "blockTimestamp": "0x1"} for b in range(lo, hi + 1)]}


asked = []


def test_log_ranges():
    asked.clear()
    options = {"transport": "tests.test_tape:fake_logs", "url": "u", "address": "a", "topic": "t", "tokens": "11", "startBlock": 1, "endBlock": 30, "span": 8}
    got = [r[2] for r in feeds._LogsReader(options).read(feeds.Blocks(1, 30))]
    assert got == [f"0x{b:x}" for b in range(1, 31)] and asked[:2] == [(1, 8), (1, 3)]
    assert feeds._LogsReader.suggested("x [0x1, 0x5]", 1, 9) == 5 and feeds._LogsReader.suggested("x [0x1, 0x9]", 1, 9) is None and feeds._LogsReader.suggested("x", 1, 9) is None


def fake_book(url, payload):
    return {"data": {"orderbook": {"id": payload["variables"]["token"], "tradesQuantity": "3", "buysQuantity": "2", "sellsQuantity": "1", "scaledCollateralVolume": "9"}}}


def test_lookups(spark, monkeypatch):
    r = feeds.book_counters(spark, {"transport": "tests.test_tape:fake_book", "url": "u"}, ["11"]).collect()[0]
    assert (r.market, r.expected, r.buys, r.sells) == ("11", 3, 2, 1)
    assert feeds.newest_trade(spark, {"transport": "tests.test_tape:fake_trades", "url": "u", "ticker": "T"}).collect()[0].trade_id == "a"
    late = [dict(f, timestamp=str(int(f["timestamp"]) + 1_000_000)) for f in FILLS]
    monkeypatch.setitem(globals(), "FILLS", late)
    seen = []
    monkeypatch.setattr(feeds, "_transport", lambda o: lambda url, payload: seen.append(int(payload["variables"]["from"])) or fake_fills(url, payload))
    got = list(feeds.FillPages({"url": "u", "limit": 3}).read(feeds.Shard("11", 0, 2_000_000)))
    assert len(got) == len(FILLS) and seen[:2] == [0, 1_000_001]
    monkeypatch.setenv("CROSSLOOM_FILLS_URL", "other")
    assert feeds._url({"url": "u"}, "fills") == "other" and feeds._url({"url": "u"}, "logs") == "u"


def test_stages(spark, tmp_path, capsys):
    from crossloom.plans import stages

    folder = tmp_path / "a"
    (folder / "raw").mkdir(parents=True)
    (folder / "event.json").write_text(json.dumps({"slug": "a", "kalshi_ticker": "T", "polymarket_condition_id": "0x1", "polymarket_token_ids": ["11", "22"], "polymarket_exchange": EXCHANGE}))
    trade = lambda i: {"trade_id": f"k{i:03d}", "ticker": "T", "created_time": f"2024-01-{1 + i // 24:02d}T{i % 24:02d}:00:05Z", "yes_price_dollars": f"0.{40 + i % 7}00", "no_price_dollars": f"0.{60 - i % 7}00", "count_fp": "5.00", "taker_outcome_side": "yes", "is_block_trade": False}
    fill = lambda i: {"id": f"p{i:03d}", "transactionHash": "0xh", "timestamp": str(1704067200 + 3600 * i), "price": f"0.{50 + i % 5}", "size": "5000000", "side": "BUY", "maker": {"id": "m"}, "taker": {"id": "t"}, "market": "11"}
    (folder / "raw/exchange.jsonl").write_text("".join(json.dumps(trade(i)) + "\n" for i in range(60)))
    (folder / "raw/fills.jsonl").write_text("".join(json.dumps(fill(i)) + "\n" for i in range(60)))
    other = tmp_path / "b"
    (other / "raw").mkdir(parents=True)
    (other / "event.json").write_text(json.dumps({"slug": "b", "kalshi_ticker": "U", "polymarket_condition_id": "0x2", "polymarket_token_ids": ["33", "44"], "polymarket_exchange": EXCHANGE, "window_seconds": 10, "resolution": "NO"}))
    (other / "raw/exchange.jsonl").write_text("".join(json.dumps(trade(i) | {"ticker": "U"}) + "\n" for i in range(30)))
    # 55 is a token that the event does not name: it stays its own outcome
    (other / "raw/fills.jsonl").write_text("".join(json.dumps(fill(i) | {"market": "33" if i else "55", "taker": {"id": EXCHANGE if i == 5 else "t"}}) + "\n" for i in range(30)))
    assert stages.main([str(tmp_path), "--all"]) == 0
    said = capsys.readouterr().out
    assert (folder / "results/results.txt").read_text() in said and (other / "results/results.txt").read_text() in said
    assert "fills read: rows 90, aggregate 1, unpriced 0" in said and "clean written: rows 179, exchange 90, chain 89" in said
    tables = stages.Places.of_all(str(tmp_path))
    tape = tables.read(spark, tables.clean)
    assert {r.outcome for r in tape.where("slug = 'b' AND venue = 'polymarket'").collect()} == {"YES", "55"}
    assert {r.slug: r["count"] for r in tape.groupBy("slug").count().collect()} == {"a": 120, "b": 59}
    event = config.load_event(str(tmp_path), "a")
    alone = stages.run(spark, event, force=True, csv=True)
    assert (folder / "results/results.txt").read_text() in alone
    with pytest.raises(Exception, match="(?i)exist"):
        stages.run(spark, event)
    assert [r.unix_ts for r in spark.read.parquet(event.path("clean_exchange")).collect()] == sorted(r.unix_ts for r in spark.read.parquet(event.path("clean_exchange")).collect())
    # tables of one event and of all agree
    for kind, place in (("matches", tables.matches), ("merged", tables.merged)):
        mine, all_of = spark.read.parquet(event.path(kind)), tables.read(spark, place).where("slug = 'a'")
        assert sorted(mine.collect(), key=repr) == sorted(all_of.select(mine.columns).collect(), key=repr)
    lines = (folder / "csv/exchange.csv").read_bytes().split(b"\r\n")
    assert lines[0] == b"venue,timestamp,unix_ts,trade_id,outcome,side,price,quantity,notional_usd,yes_price,tx_hash,maker,taker,is_block_trade" and len(lines) == 62
    assert lines[1] == b"kalshi,2024-01-01T00:00:05+00:00,1704067205,k000,YES,BUY,0.4,5,2.0,0.4,,,,False"
    matched = (folder / "csv/matched_trades.csv").read_text().splitlines()
    assert matched[0] == "timestamp,market,trade_id,side,size,yes_price,no_price" and len(matched) > 50
    order = [(int(t), market, trade) for t, market, trade, *_ in (x.split(",") for x in matched[1:])]
    assert order == sorted(order)
    assert len((folder / "csv/merged.csv").read_text().splitlines()) == 121 and (folder / "csv/matches.csv").read_text().startswith("poly_time,kalshi_time,poly_yes,poly_no,kalshi_yes,kalshi_no,arb_size,poly_side,kalshi_side\n")
    heads = spark.createDataFrame([("a", "kalshi", "k059"), ("a", "polymarket", "p000")], "slug string, venue string, trade_id string")
    counters = spark.createDataFrame([("11", 61)], "market string, expected long")
    ok, text = stages.validate(spark, event, heads, counters, allow_partial=True)
    assert not ok and "newest trade k059: ok" in text and "newest trade p059: not" in text and "incomplete 11: 60 of 61" in text
    with pytest.raises(combine.Incomplete):
        stages.validate(spark, event, counters=counters)
    assert stages.main([str(tmp_path), "a", "--stage", "validate"]) == 0
    # the command asks the feeds, and fails on a tape that is short or whose stored time falls
    asked = ["--transport", "tests.test_tape:fake_index", "--fills-url", "u", "--trades-url", "u"]
    assert stages.main([str(tmp_path), "a", "--stage", "validate", *asked]) == 1
    assert stages.main([str(tmp_path), "a", "--stage", "validate", *asked, "--allow-partial"]) == 0
    assert "incomplete 22: 0 of 3" in capsys.readouterr().out
    falling = spark.read.parquet(event.path("clean_exchange")).orderBy(F.desc("unix_ts")).collect()
    files.write(spark.createDataFrame(falling, CLEAN).coalesce(1), event.path("clean_exchange"), force=True)
    assert stages.main([str(tmp_path), "a", "--stage", "validate"]) == 1 and "kalshi time_order: 59 violations" in capsys.readouterr().out
    assert stages.main([str(tmp_path), "a", "--stage", "sync", "--shock", "1704150000"]) == 0
    assert "horizon 300" in capsys.readouterr().out
    # shards meet in the raw file once each; a short one fails unless that is meant
    lines = (folder / "raw/fills.jsonl").read_text().splitlines(keepends=True)
    (folder / "raw/fills.part1.jsonl").write_text("".join(lines[:40]))
    (folder / "raw/fills.part2.jsonl").write_text("".join(lines[30:]) + json.dumps(fill(1) | {"id": "x", "market": "77"}) + "\n")
    (folder / "raw/fills.jsonl").unlink()
    assert stages.main([str(tmp_path), "a", "--stage", "combine"]) == 0 and "rows 71, foreign_rows 1, duplicates 10" in capsys.readouterr().out
    assert stages.main([str(tmp_path), "a", "--stage", "combine", "--force", *asked]) == 1
    assert stages.main([str(tmp_path), "a", "--stage", "combine", "--force", "--allow-partial", *asked]) == 0
    assert sorted(r.value for r in files.read_lines(spark, str(folder / "raw/fills.jsonl")).collect()) == sorted(x.strip() for x in lines)
    # without raw trades, matched prices are charted only if that is allowed
    (folder / "raw/exchange.jsonl").unlink()
    page = (folder / "results/charts.html").read_text()
    assert "need --allow-subset" in stages.run(spark, event, force=True) and (folder / "results/charts.html").read_text() == page
    assert stages.main([str(tmp_path), "a", "--allow-subset", "--force"]) == 0 and "(matched prices)" in (folder / "results/charts.html").read_text()


def fake_index(url, payload):
    """60 fills of token 11 and 3 of token 22; k059 is the newest trade."""
    if payload is None:
        return {"trades": [{"trade_id": "k059"}]}
    token = payload["variables"]["token"]
    return {"data": {"orderbook": {"tradesQuantity": {"11": "60"}.get(token, "3"), "buysQuantity": "0", "sellsQuantity": "0"}}}


def test_matched_trades_that_the_tape_lacks(spark):
    t = clean_rows(spark, [("kalshi", 6, "k", 0.4, 10.0), ("polymarket", 6, "p", 0.6, 10.0)])
    rows = match.aligned(merge.merge(t))
    m = match.match(rows, F.lit(300))
    assert report.uncovered(rows, m).collect() == []
    assert [(r.market, r.id) for r in report.uncovered(rows.where("market = 'kalshi'"), m).collect()] == [("poly", "p")]


def test_ordered_csv_is_one_file_byte_by_byte(spark, tmp_path):
    from crossloom.sources import export

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i / 2, f'say "{i}", ok' if i == 4 else f"t{i}", i % 2 == 0) for i in range(200)], "i long, x double, t string, b boolean").repartition(5)
    path = str(tmp_path / "out.csv")
    export.ordered_csv(rows.orderBy("i"), path, "crlf", ["x"])
    cell = lambda i: "" if i % 3 == 0 else str(i // 2) if i % 2 == 0 else repr(i / 2)
    text = lambda i: '"say ""4"", ok"' if i == 4 else f"t{i}"
    want = "i,x,t,b\r\n" + "".join(f"{i},{cell(i)},{text(i)},{i % 2 == 0}\r\n" for i in range(200))
    assert (tmp_path / "out.csv").read_bytes() == want.encode() and [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    with pytest.raises(Exception, match="exists already"):
        export.ordered_csv(rows, path)
    bad = rows.withColumn("t", F.when(F.col("i") == 150, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        export.ordered_csv(bad, path, force=True)
    assert (tmp_path / "out.csv").read_bytes() == want.encode() and [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    times = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS a, timestamp'2024-01-02 03:04:05.25' AS b").select(export.iso(F.col("a")), export.iso(F.col("b"))).first()
    assert tuple(times) == ("2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.250000+00:00")


def test_percentiles_equal_linear_interpolation(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"few": rng.normal(size=7), "two": np.array([1.0, 4.0]), "one": np.array([2.5]), "many": rng.lognormal(size=30_000), "ties": np.round(rng.exponential(size=20_000), 1)}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("few", None)], "g string, v double").repartition(6)
    got = {r.g: (r.p1, r.p50, r.p90, r.p99) for r in sync.percentiles(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}).collect()}
    assert got.keys() == values.keys()
    for k, x in values.items():
        assert np.allclose(got[k], np.quantile(x, [0.01, 0.5, 0.9, 0.99]), rtol=1e-12)


def test_running_sums_by_stretches(spark, monkeypatch):
    from crossloom.operators import portfolio

    monkeypatch.setattr(portfolio, "BITS", 3)
    orders = [0, 1, 7, 8, 9, 63, 64, 500, 511, 512, 4095, 4096, 100_000]
    df = spark.createDataFrame([(s, o, float(o % 7 + 1)) for s in ("a", "b") for o in orders], "slug string, at long, x double").repartition(3)
    got = {(r.slug, r.at): r.x for r in portfolio.running_sums(df, "slug", "at", ["x"]).collect()}
    total = 0.0
    for o in orders:
        total += o % 7 + 1
        assert got["a", o] == got["b", o] == total


def test_streams(spark, tmp_path):
    t = clean_rows(spark, [("kalshi", 5, "a", 0.4, 10.0), ("kalshi", 5, "a", 0.4, 10.0), ("kalshi", 7, "b", 0.6, 10.0)])
    t.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.land(stream.once_each(stream.read_clean(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.schema(CLEAN).parquet(str(tmp_path / "out")).count() == 2
    q = stream.vwap_bins(stream.read_clean(spark, str(tmp_path / "in")), "10 seconds").writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").collect()[0].trades == 3
