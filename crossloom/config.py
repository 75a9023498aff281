"""Events: one market on two venues each, from JSON files."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from .functions.chain import token_hex


@dataclass(frozen=True)
class Event:
    """Identifiers, window, cutoffs (inclusive) and resolution of an event, and where its tables lie."""

    slug: str
    kalshi_ticker: str
    polymarket_condition_id: str
    name: str = ""
    polymarket_exchange: str | None = None
    polymarket_event_slug: str | None = None
    polymarket_token_ids: tuple[str, ...] = ()
    poly_raw_gzip: bool = False
    window_seconds: int = 300
    resolution: str | None = None
    start_ts: int | None = None
    end_ts: int | None = None
    poly_start_block: int | None = None
    poly_end_block: int | None = None
    chart_title: str = ""
    base: str = ""
    other: dict = field(default_factory=dict, compare=False, hash=False)

    @classmethod
    def of(cls, cfg: dict, base: str = "") -> Event:
        missing = [k for k in ("slug", "kalshi_ticker", "polymarket_condition_id") if not cfg.get(k)]
        if missing:
            raise KeyError(f"event without {', '.join(missing)}")
        names = set(cls.__dataclass_fields__) - {"base", "other"}
        own = {k: v for k, v in cfg.items() if k in names and v is not None}
        own["polymarket_token_ids"] = tuple(cfg.get("polymarket_token_ids") or ())
        own["name"] = cfg.get("name") or cfg["slug"]
        own["chart_title"] = cfg.get("chart_title") or cfg["slug"]
        return cls(**own, base=base, other={k: v for k, v in cfg.items() if k not in names})

    def path(self, kind: str) -> str:
        """Place of one of the event's tables: raw_exchange, raw_fills, raw_logs, raw_fill_shards, clean_exchange, clean_fills, clean_logs, merged, matches, matched_trades, results, charts."""
        places = {
            "raw_exchange": "raw/exchange.jsonl", "raw_fills": "raw/fills.jsonl" + ".gz" * self.poly_raw_gzip, "raw_logs": "raw/logs.jsonl", "raw_fill_shards": "raw/fills.part*.jsonl*",
            "clean_exchange": "clean/exchange", "clean_fills": "clean/fills", "clean_logs": "clean/logs",
            "merged": "results/merged", "matches": "results/matches", "matched_trades": "results/matched_trades", "results": "results/results.txt", "charts": "results/charts.html",
        }
        return f"{self.base}/{places[kind]}"


def load_event(events_dir: str, slug_or_path: str | None = None) -> Event:
    """By slug, by path of a JSON file, or the only event under events_dir."""
    if slug_or_path is None:
        found = sorted(Path(events_dir).glob("*/event.json"))
        if len(found) != 1:
            raise ValueError(f"name an event; {len(found)} lie under {events_dir}")
        path = found[0]
    else:
        path = Path(slug_or_path) if slug_or_path.endswith(".json") else Path(events_dir, slug_or_path, "event.json")
    if not path.exists():
        raise FileNotFoundError(path)
    return Event.of(json.loads(path.read_text(encoding="utf-8")), str(path.parent))


def load_all(events_dir: str) -> list[Event]:
    return [Event.of(json.loads(p.read_text(encoding="utf-8")), str(p.parent)) for p in sorted(Path(events_dir).glob("*/event.json"))]


def event_from_argv(events_dir: str, argv: list[str] | None = None) -> Event:
    argv = sys.argv[1:] if argv is None else argv
    return load_event(events_dir, argv[0] if argv else None)


def events_frame(spark: SparkSession, events: list[Event]) -> DataFrame:
    """One row per event, to join records and tapes with: by folder (its name, as in paths of files), ticker or slug."""
    token = lambda e, i: e.polymarket_token_ids[i] if len(e.polymarket_token_ids) > i else None
    rows = []
    for e in events:
        ids = [token(e, 0), token(e, 1)]
        hexes = [token_hex(i) if i and i.isdigit() else None for i in ids]
        rows.append((quote(Path(e.base).name), e.slug, e.kalshi_ticker, list(e.polymarket_token_ids), *ids, *hexes, e.polymarket_exchange or "", e.window_seconds, (e.resolution or "YES").upper(), e.start_ts, e.end_ts))
    return spark.createDataFrame(rows, "folder string, slug string, kalshi_ticker string, token_ids array<string>, yes_token string, no_token string, yes_hex string, no_hex string, exchange string, window_seconds int, resolution string, start_ts long, end_ts long")
