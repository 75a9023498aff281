"""Reports of an event: results as text, and a page of charts from at most a few hundred sampled points."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import portfolio, series

POINTS = 700


def results_text(settled: DataFrame, slug: str) -> str:
    """Tokens, expense, payback, earnings and net of both venues (two rows), and the sum of nets."""
    rows = {r["venue"]: r for r in settled.where(F.col("slug") == slug).collect()}
    lines, total = [], 0.0
    for label, venue in (("Poly", "poly"), ("Kalshi", "kalshi")):
        r = rows.get(venue)
        values = {k: float(r[k]) if r else 0.0 for k in ("tokens", "expense", "payback", "earnings", "net")}
        lines += [f"{label} {k}: {v}" for k, v in values.items()] + [""]
        total += values["net"]
    return "\n".join([*lines, f"Net: {total}"]) + "\n"


def chart_points(tape: DataFrame, matches: DataFrame, points: int = POINTS) -> DataFrame:
    """slug, i, ts, kalshi, polymarket, z_poly, z_kalshi, locked_in at points even times between the first and last booking."""
    path = portfolio.path(matches)
    bounds = path.groupBy("slug").agg(F.min("book_time").alias("lo"), F.max("book_time").alias("hi"))
    grid = series.point_grid(bounds, points)
    booked = series.as_of(path.select("slug", F.col("book_time").alias("ts"), "match_seq", "z_poly", "z_kalshi", "locked_in"), grid, ["slug"], ["z_poly", "z_kalshi", "locked_in"], "match_seq")
    of = lambda v: F.when(F.col("venue") == v, F.col("yes_price")).alias(v)
    prices = series.as_of(tape.select("slug", F.col("unix_ts").alias("ts"), "trade_id", of("kalshi"), of("polymarket")), grid, ["slug"], ["kalshi", "polymarket"], "trade_id")
    return booked.join(prices, ["slug", "i", "ts"])


def price_path_of_matches(matches: DataFrame) -> DataFrame:
    """A tape of the matched prices alone, for events without clean tapes."""
    one = lambda m, v: matches.select("slug", F.lit(v).alias("venue"), F.col(f"{m}_time").alias("unix_ts"), F.lpad(F.col("match_seq").cast("string"), 20, "0").alias("trade_id"), F.col(f"{m}_yes").alias("yes_price"))
    return one("kalshi", "kalshi").unionByName(one("poly", "polymarket"))


def _line(points: list[tuple[float, float]], color: str, box: tuple[float, float, float, float]) -> str:
    lo, hi, low, high = box
    x = lambda t: 40 + 740 * (t - lo) / max(1, hi - lo)
    y = lambda v: 190 - 170 * (v - low) / ((high - low) or 1)
    return f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{x(t):.1f},{y(v):.1f}" for t, v in points)}"/>'


def uncovered(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """slug, market, id of matched trades that the tape does not have: then its prices are not those that were matched."""
    both = F.array(*[F.struct(F.lit(v).alias("market"), F.col(f"{v}_id").alias("id")) for v in ("poly", "kalshi")])
    used = matches.select("slug", F.explode(both).alias("u")).select("slug", "u.market", "u.id").distinct()
    return used.join(rows.select("slug", "market", "id"), ["slug", "market", "id"], "left_anti")


def chart_page(sampled: pd.DataFrame, slug: str, title: str, matches: int) -> str:
    """An HTML page with prices, positions and locked-in cash as SVG, and the points as JSON. sampled: chart_points, a few hundred rows for each event."""
    rows = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in sampled[sampled["slug"] == slug].sort_values("i").to_dict("records")]
    parts = []
    for name, lines in (("Implied probability", ("kalshi", "polymarket")), ("Net YES contracts", ("z_kalshi", "z_poly")), ("Locked-in cash", ("locked_in",))):
        data = {c: [(r["ts"], float(r[c])) for r in rows if r[c] is not None] for c in lines}
        values = [v for d in data.values() for _, v in d] or [0.0]
        times = [r["ts"] for r in rows] or [0]
        box = (min(times), max(times), min(values), max(values))
        drawn = "".join(_line(d, color, box) for d, color in zip(data.values(), ("#1f6fb2", "#c2571a"), strict=False))
        parts.append(f'<h2>{name}</h2><p>{", ".join(lines)}: {box[2]:g} to {box[3]:g}</p><svg viewBox="0 0 800 200">{drawn}</svg>')
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><p>{matches} matches</p>{''.join(parts)}<script type='application/json' id='points'>{json.dumps(rows)}</script>"
