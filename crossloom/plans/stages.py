"""Events' way from raw files to results: python -m crossloom.plans.stages EVENTS_DIR [SLUG] [--stage run|validate|sync|combine] [--all] [--force] ...

Each stage is one set of jobs for all events it is given: records meet their event's tokens, exchange, cutoffs, window and
resolution in a join with one row for each event. With --all, tables lie under EVENTS_DIR/tables, by slug.
"""

from __future__ import annotations

import argparse
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Event, events_frame, load_all, load_event
from ..operators import clean, combine, match, merge, portfolio, quality, series, sync
from ..runtime import materialize
from ..schemas import CLEAN, MATCH, MERGED
from ..sources import export, feeds, files
from . import report


@dataclass(frozen=True)
class Places:
    """Where the tables of a run lie, and whether they are parted by slug."""

    clean: str
    merged: str
    matches: str
    matched_trades: str
    by: list[str] | None = None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """One of the first three. Slugs are text, whatever they look like in the names of folders."""
        return spark.read.schema({self.clean: CLEAN, self.merged: MERGED, self.matches: MATCH}[path]).parquet(path)

    @classmethod
    def of(cls, event: Event) -> Places:
        return cls(*[event.path(k) for k in ("clean_exchange", "merged", "matches", "matched_trades")])

    @classmethod
    def of_all(cls, events_dir: str) -> Places:
        return cls(*[f"{events_dir}/tables/{k}" for k in ("clean", "merged", "matches", "matched_trades")], ["slug"])


def _with_event(spark: SparkSession, rows: DataFrame, events: list[Event], on: str, columns: list[str]) -> DataFrame:
    """rows and their event's columns. One row an event: broadcast up to sync.FEW of them."""
    dim = events_frame(spark, events).select(on, *columns)
    return rows.join(F.broadcast(dim) if len(events) <= sync.FEW else dim, on, "left")


class Counters:
    """Counts of rows by kind, taken while a stage's own job reads them."""

    def __init__(self) -> None:
        self.watched: list[tuple[str, Observation, list[str]]] = []

    def watch(self, name: str, rows: DataFrame, **kinds) -> DataFrame:
        seen = Observation(f"{name} {len(self.watched)}")
        self.watched.append((name, seen, ["rows", *kinds]))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in kinds.items()])

    def lines(self) -> list[str]:
        """After the job: a line for each place, such as `fills read: rows 60, aggregate 0, unpriced 0`."""
        out = [f"{name}: " + ", ".join(f"{k} {seen.get.get(k, 0)}" for k in kinds) for name, seen, kinds in self.watched]
        self.watched.clear()
        return out


def clean_tape(spark: SparkSession, events: list[Event], counters: Counters) -> DataFrame:
    """The exchange's clean tapes and the chain's: of each event from logs if they are there, else from the index's fills.

    A token that an event does not name stays its own outcome; a foreign ticker is an error.
    """
    event = ["slug", "kalshi_ticker", "yes_token", "no_token", "yes_hex", "no_hex", "exchange"]

    def read(kind: str, paths: list[str], key: list[str] | None, **kinds) -> DataFrame:
        rows = _with_event(spark, files.read_raw(spark, kind, paths, folder=True), events, "folder", event)
        rows = counters.watch(f"{kind} read", rows, **kinds)
        return rows.dropDuplicates(key) if key else rows

    own = F.col("exchange")
    raw = read("exchange", [e.path("raw_exchange") for e in events], ["slug", "trade_id"])
    parts = [clean.clean_exchange(files.same_ticker(raw, F.col("kalshi_ticker")), F.col("slug"))]
    logged = [e for e in events if files.exists(spark, e.path("raw_logs"))]
    filled = [e for e in events if e not in logged]
    if logged:
        kind = clean.log_kind(own)
        logs = read("logs", [e.path("raw_logs") for e in logged], None, aggregate=kind == "aggregate", anomaly=kind == "anomaly")
        parts.append(clean.clean_logs(logs, F.col("slug"), own, (F.col("yes_hex"), F.col("no_hex"))))
    if filled:
        kind = clean.fill_kind(own)
        fills = read("fills", [e.path("raw_fills") for e in filled], ["slug", "id"], aggregate=kind == "aggregate", unpriced=kind == "unpriced")
        parts.append(clean.clean_fills(fills, F.col("slug"), own, (F.col("yes_token"), F.col("no_token"))))
    tape = parts[0]
    for p in parts[1:]:
        tape = tape.unionByName(p)
    return counters.watch("clean written", tape, exchange=F.col("venue") == "kalshi", chain=F.col("venue") == "polymarket")


def run(spark: SparkSession, event: Event, force: bool = False, **options) -> str:
    """run_all of one event, with tables in its own folder."""
    return run_all(spark, [event], Places.of(event), force, **options)


def run_all(spark: SparkSession, events: list[Event], at: Places, force: bool = False, csv: bool = False, allow_subset: bool = False, allow_partial: bool = False) -> str:
    """Writes clean, merged, matches, matched trades, results and charts of all events; returns counts and the results' text.

    csv: also one ordered CSV file of each table for each event. allow_subset: events without raw trades, but with matches, get charts of the
    matched prices. allow_partial: matches may name trades that the tape does not have.
    """
    counters, out = Counters(), []
    # the order of chain trades in one second is that of the transaction, then the log
    order = ["slug", "unix_ts", F.coalesce("tx_hash", "trade_id"), F.coalesce("log_index", F.lit(0)), "trade_id"]
    raw = [e for e in events if files.exists(spark, e.path("raw_exchange"))]
    absent = [e for e in events if e not in raw]
    if absent:
        return "\n".join([*(run_all(spark, raw, at, force, csv, allow_subset, allow_partial).splitlines() if raw else []), *[_charts_of_matches(spark, e, allow_subset, force) for e in absent]])
    # counted and written once; ordering reads what it orders twice
    found = materialize(clean_tape(spark, events, counters), "clean")
    out += counters.lines()
    files.write(found.orderBy(*order), at.clean, force, by=at.by)
    tape = at.read(spark, at.clean)
    files.write(counters.watch("merged written", merge.ordered(merge.merge(tape))), at.merged, force, by=at.by)
    out += counters.lines()
    rows = match.aligned(at.read(spark, at.merged), events_frame(spark, events).select("slug", "start_ts", "end_ts"))
    timed = _with_event(spark, rows, events, "slug", ["window_seconds"])
    files.write(counters.watch("matches written", match.match(timed, F.col("window_seconds"))), at.matches, force, by=at.by)
    out += counters.lines()
    matches = at.read(spark, at.matches)
    files.write(counters.watch("matched trades written", match.in_order(rows, matches)), at.matched_trades, force, by=at.by)
    out += counters.lines()
    settled = portfolio.settlement(_with_event(spark, matches, events, "slug", ["resolution"]), F.col("resolution"))
    # two rows an event, and a few hundred points
    settled = spark.createDataFrame(settled.collect(), settled.schema)
    lost = {r["slug"]: r["n"] for r in report.uncovered(rows, matches).groupBy("slug").agg(F.count(F.lit(1)).alias("n")).collect()}
    points = report.chart_points(tape, matches).toPandas()
    n = {r["slug"]: r["count"] for r in matches.groupBy("slug").count().collect()}
    texts = []
    for e in events:
        text = report.results_text(settled, e.slug)
        files.write_text(spark, text, e.path("results"), force)
        if e.slug in lost and not allow_partial:
            texts.append(f"{e.slug}: no charts, as the tape lacks {lost[e.slug]} matched trades")
        else:
            files.write_text(spark, report.chart_page(points, e.slug, e.chart_title, n.get(e.slug, 0)), e.path("charts"), force)
        if csv:
            _export(spark, e, at, rows, tape, matches, force)
        texts.append(text)
    return "\n".join([*out, _lines(clean.summary(tape).orderBy("slug", "venue")), *texts])


def _charts_of_matches(spark: SparkSession, event: Event, allow_subset: bool, force: bool) -> str:
    """Charts of an event of which only matches are left: their prices are not the market's, so only if that is allowed."""
    if not files.exists(spark, event.path("matches")):
        raise FileNotFoundError(f"{event.slug}: neither raw trades nor matches")
    if not allow_subset:
        return f"{event.slug}: no raw trades; charts of matched prices alone need --allow-subset"
    matches = spark.read.parquet(event.path("matches"))
    points = report.chart_points(report.price_path_of_matches(matches), matches).toPandas()
    files.write_text(spark, report.chart_page(points, event.slug, f"{event.chart_title} (matched prices)", matches.count()), event.path("charts"), force)
    return f"{event.slug}: charts of matched prices alone"


def _export(spark: SparkSession, e: Event, at: Places, rows: DataFrame, tape: DataFrame, matches: DataFrame, force: bool) -> None:
    own = lambda df: df.where(F.col("slug") == e.slug)
    folder = f"{e.base}/csv"
    for venue, name in (("kalshi", "exchange"), ("polymarket", "chain")):
        export.clean_csv(own(tape), venue, f"{folder}/{name}.csv", force)
    export.tables_csv(own(at.read(spark, at.merged)), own(matches), match.in_order(own(rows), own(matches)), folder, force)


def _lines(rows: DataFrame) -> str:
    """A line for each row of a small report."""
    return "\n".join(", ".join(f"{k} {v}" for k, v in r.asDict().items()) for r in rows.collect())


def validate(spark: SparkSession, event: Event, heads: DataFrame | None = None, counters: DataFrame | None = None, allow_partial: bool = False) -> tuple[bool, str]:
    """validate_all of one event; counts that fall short are an error unless allowed."""
    ok, text = validate_all(spark, [event], Places.of(event), heads, counters, allow_partial)[event.slug]
    short = [x for x in text.splitlines() if x.startswith("incomplete")]
    if short and not allow_partial:
        raise combine.Incomplete("; ".join(short))
    return ok, text


def validate_all(spark: SparkSession, events: list[Event], at: Places, heads: DataFrame | None = None, counters: DataFrame | None = None, allow_partial: bool = False) -> dict[str, tuple[bool, str]]:
    """Of each event: structure and stored order of both venues' clean tapes, the exchange's buys, their newest trade and their counts against the feeds' own, and the overlap.

    heads: slug, venue, trade_id of the feeds' newest trades; counters: market, expected rows of raw fills.
    """
    tape = at.read(spark, at.clean)
    stored = tape.withColumn("_stored", F.struct("_metadata.file_name", "_metadata.row_index"))
    ok, out = dict.fromkeys([e.slug for e in events], True), defaultdict(list)

    def note(slug: str, fine: bool, text: str) -> None:
        ok[slug] = ok.get(slug, True) and bool(fine)
        out[slug].append(text)

    for r in quality.structure(stored, "_stored").orderBy("venue", "check").collect():
        note(r["slug"], r["ok"], f"{r['venue']} {r['check']}: {'ok' if r['ok'] else str(r['violations']) + ' violations'}")
    for r in quality.only_buys(tape).collect():
        note(r["slug"], r["ok"], f"kalshi only buys: {'ok' if r['ok'] else 'no'}")
    for r in quality.newest(tape, heads).collect() if heads is not None else []:
        note(r["slug"], r["ok"], f"{r['venue']} newest trade {r['newest_id']}: {'ok' if r['ok'] else 'not the feed head'}")
    if counters is not None:
        filled = [e for e in events if files.exists(spark, e.path("raw_fills"))]
        counts = quality.complete(files.read_raw(spark, "fills", [e.path("raw_fills") for e in filled]), counters)
        of = {t: e.slug for e in events for t in e.polymarket_token_ids}
        for x in combine.gate(counts, allow_partial=True):
            note(of.get(x.split(":")[0], events[0].slug), allow_partial, f"incomplete {x}")
    for r in quality.overlap_stats(tape).collect():
        note(r["slug"], True, ", ".join(f"{k} {v}" for k, v in r.asDict().items()))
    return {s: (ok[s], "\n".join(out[s])) for s in ok}


def combined(spark: SparkSession, event: Event, counters: DataFrame | None = None, allow_partial: bool = False, force: bool = False) -> str:
    """Joins an event's shards of raw fills, verbatim and once each, to its raw file; counts that fall short of counters are an error unless allowed."""
    shards = files.read_lines(spark, event.path("raw_fill_shards"))
    tokens = list(event.polymarket_token_ids)
    files.write_lines(combine.combine_lines(shards, tokens), event.path("raw_fills"), force, event.poly_raw_gzip)
    read = shards.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.market").alias("market"))
    text = _lines(combine.combine_counts(read, tokens))
    if counters is None:
        return text
    bad = combine.gate(quality.complete(files.read_raw(spark, "fills", event.path("raw_fills")), counters), allow_partial)
    return "\n".join([text, *[f"incomplete {x}" for x in bad]])


def synchronised(spark: SparkSession, tape: DataFrame, window: int, shock_start: int | None = None) -> str:
    """How the venues move together: correlation by bin, lead and lag, half-life with the window's verdict, drift."""
    bounds = series.overlap(tape)
    grid = series.second_grid(tape, bounds)
    peaks = sync.peak_lag(sync.lead_lag(grid))
    regimes = sync.regimes(bounds, shock_start) if shock_start is not None else bounds.select("slug", F.lit("full").alias("regime"), F.col("lo").alias("from_ts"), (F.col("hi") + 1).alias("to_ts"))
    life = sync.verdict(sync.half_life(sync.samples(tape, regimes), regimes), window)
    parts = [sync.epps_curve(tape).orderBy("slug", "width"), peaks.orderBy("slug", "horizon"), life.orderBy("slug", "regime"), sync.drift(grid).orderBy("slug", "venue", "horizon")]
    return "\n\n".join(map(_lines, parts))


def _asked(spark: SparkSession, events: list[Event], transport: str | None, fills_url: str | None, trades_url: str | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(newest trades, counters) from the feeds whose addresses are given: a few small answers for each event."""
    options = {"pause": 1.5} | ({"transport": transport} if transport else {})
    heads = counters = None
    if trades_url:
        rows = [(e.slug, r["venue"], r["trade_id"]) for e in events for r in feeds.newest_trade(spark, options | {"url": trades_url, "ticker": e.kalshi_ticker}).collect()]
        heads = spark.createDataFrame(rows, "slug string, venue string, trade_id string")
    if fills_url:
        counters = feeds.book_counters(spark, options | {"url": fills_url}, [t for e in events for t in e.polymarket_token_ids])
    return heads, counters


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("events_dir")
    p.add_argument("slug", nargs="?")
    p.add_argument("--stage", choices=["run", "validate", "sync", "combine"], default="run")
    p.add_argument("--all", action="store_true", help="all events under the folder, each stage once")
    p.add_argument("--shock", type=int, help="start of the day that the half-life sets apart")
    p.add_argument("--force", action="store_true", help="replace what is there")
    p.add_argument("--csv", action="store_true", help="also write ordered CSV files")
    p.add_argument("--allow-subset", action="store_true", help="chart matched prices where there are no raw trades")
    p.add_argument("--allow-partial", action="store_true", help="go on if counts fall short or matched trades are not in the tape")
    p.add_argument("--fills-url", help="index of fills, to compare counts with")
    p.add_argument("--trades-url", help="exchange, to compare the newest trade with")
    p.add_argument("--transport", help="module:function that asks the feeds")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    events = load_all(a.events_dir) if a.all else [load_event(a.events_dir, a.slug)]
    at = Places.of_all(a.events_dir) if a.all else Places.of(events[0])
    if a.stage == "run":
        print(run_all(spark, events, at, a.force, a.csv, a.allow_subset, a.allow_partial))
        return 0
    if a.stage == "sync":
        tape = at.read(spark, at.clean)
        for window in sorted({e.window_seconds for e in events}):
            print(synchronised(spark, tape.where(F.col("slug").isin([e.slug for e in events if e.window_seconds == window])), window, a.shock))
        return 0
    heads, counters = _asked(spark, events, a.transport, a.fills_url, a.trades_url)
    if a.stage == "combine":
        try:
            for e in events:
                mine = counters.where(F.col("market").isin(list(e.polymarket_token_ids))) if counters is not None else None
                print(combined(spark, e, mine, a.allow_partial, a.force))
        except combine.Incomplete as e:
            print(f"incomplete {e}")
            return 1
        return 0
    checked = validate_all(spark, events, at, heads, counters, a.allow_partial)
    for slug, (_, text) in checked.items():
        print(slug, text, sep="\n")
    return 0 if all(fine for fine, _ in checked.values()) else 1


if __name__ == "__main__":
    raise SystemExit(main())
