"""Python data sources over paged HTTP feeds: exchange trades, indexed chain fills, chain logs.

Fills and logs can be read at once or as a stream. Either way the driver only plans: it asks how far the feed has come,
probes how dense stretches of it are, and cuts them into shards of about equal work, which tasks read. A stream's offset
has the next second of each token, or the next block, so its checkpoint says what has been read, token by token.

The transport is the option `transport`, "module:function": a function (url, payload or None) that returns the
parsed answer or raises FeedError. Tests give their own; ``http_json`` is the one for live use.
"""

from __future__ import annotations

import importlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.chain import token_hex
from ..schemas import RAW_EXCHANGE, RAW_FILLS, RAW_LOGS
from .balance import balanced

Transport = Callable[[str, dict | None], dict]


class FeedError(Exception):
    """A call that may be repeated; slow: the server timed out over the size of what was asked."""

    def __init__(self, what: str, slow: bool = False):
        super().__init__(what)
        self.slow = slow


def http_json(url: str, payload: dict | None = None) -> dict:
    request = urllib.request.Request(url, None if payload is None else json.dumps(payload).encode(), {"Content-Type": "application/json", "User-Agent": "crossloom"})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise FeedError(f"HTTP {e.code}", slow=e.code == 504) from e
        raise
    except (OSError, ValueError) as e:
        raise FeedError(str(e), slow=isinstance(e, TimeoutError)) from e


def _transport(options: Mapping) -> Transport:
    module, _, name = options.get("transport", "crossloom.sources.feeds:http_json").partition(":")
    return getattr(importlib.import_module(module), name)


def call(transport: Transport, url: str, payload: dict | None = None, tries: int = 5, pause: float = 1.5) -> dict:
    """The answer; failures that may pass are repeated with rising pauses. Slow answers are left to the caller."""
    for n in range(1, tries + 1):
        try:
            return transport(url, payload)
        except FeedError as e:
            if e.slow or n == tries:
                raise
            time.sleep(pause * n)
    raise AssertionError("unreachable")


def _url(options: Mapping, feed: str) -> str:
    """The option url; CROSSLOOM_TRADES_URL, CROSSLOOM_FILLS_URL or CROSSLOOM_LOGS_URL in the environment goes before it."""
    return os.environ.get(f"CROSSLOOM_{feed.upper()}_URL") or options["url"]


def _pause(options: Mapping) -> float:
    return float(options.get("pause", 1.5))


class _TradesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = CaseInsensitiveDict(options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, transport = self.options, _transport(self.options)
        cursor, seen, pages = "", set(), int(o.get("maxPages", 0))
        while True:
            query = {"ticker": o["ticker"], "limit": o.get("limit", 1000)} | ({"cursor": cursor} if cursor else {})
            page = call(transport, f"{o['url']}?{urllib.parse.urlencode(query)}", pause=_pause(o))
            trades = page.get("trades") or []
            for t in trades:
                if t["ticker"] != o["ticker"]:
                    raise ValueError(f"foreign ticker {t['ticker']} in the feed of {o['ticker']}")
                if t["trade_id"] not in seen:
                    seen.add(t["trade_id"])
                    yield tuple(t.get(c) for c in _fields(RAW_EXCHANGE))
            cursor, pages = page.get("cursor") or "", pages - 1
            if not cursor or not trades or pages == 0:
                return


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class ExchangeTrades(DataSource):
    """Cursor-paged trades of a ticker, newest first, in one partition. Options: url, ticker, limit, maxPages."""

    @classmethod
    def name(cls) -> str:
        return "exchange_trades"

    def schema(self) -> str:
        return RAW_EXCHANGE

    def reader(self, schema) -> DataSourceReader:
        return _TradesReader(self.options)


_FILL_QUERY = "query($market: String!, $from: BigInt!, $to: BigInt!, $after: String!, $first: Int!) { fills: enrichedOrderFilleds(first: $first, orderBy: %s, orderDirection: asc, where: {market: $market, timestamp_gte: $from, timestamp_lt: $to, id_gt: $after}) { id transactionHash timestamp maker { id } taker { id } market { id } side size price } }"
LEAST_PAGE = 25
GOOD_PAGES = 20
SMALLEST_SPAN = 300


@dataclass
class Shard(InputPartition):
    """Fills of a token in a half-open range of time."""

    token: str
    start: int
    end: int


class FillPages:
    """Pages of fills by rising time. A page that is cut off inside a second is resumed there by id."""

    def __init__(self, options: dict):
        self.o, self.transport = options, _transport(options)
        self.most = int(options.get("limit", 750))
        self.size, self.good = self.most, 0

    def _ask(self, shard: Shard, start: int, end: int, after: str, order: str) -> tuple[list[dict], int]:
        """(fills, size that was asked for at last): halves the page while the server is too slow."""
        while True:
            asked = self.size
            payload = {"query": _FILL_QUERY % order, "variables": {"market": shard.token, "from": str(start), "to": str(end), "after": after, "first": asked}}
            try:
                answer = call(self.transport, _url(self.o, "fills"), payload, tries=8, pause=_pause(self.o))
            except FeedError as e:
                if not e.slow or asked <= LEAST_PAGE:
                    raise
                self.size, self.good = max(LEAST_PAGE, asked // 2), 0
                continue
            self.good += 1
            if self.good >= GOOD_PAGES and self.size < self.most:
                self.size, self.good = min(self.most, self.size * 2), 0
            return answer["data"]["fills"], asked

    def _first(self, shard: Shard) -> int | None:
        """Time of the token's first fill; None if it has none."""
        variables = {"market": shard.token, "from": "0", "to": str(shard.end), "after": "", "first": 1}
        found = call(self.transport, _url(self.o, "fills"), {"query": _FILL_QUERY % "timestamp", "variables": variables}, tries=3, pause=_pause(self.o))["data"]["fills"]
        return int(found[0]["timestamp"]) if found else None

    def read(self, shard: Shard) -> Iterator[dict]:
        at, span, seen = shard.start, None, set()
        if at <= 0:
            # the first fill of all is one cheap answer; windows of years before it are not
            try:
                first = self._first(shard)
            except FeedError:
                first = at
            if first is None:
                return
            at = max(at, first)
        while at < shard.end:
            end = shard.end if span is None else min(shard.end, at + span)
            try:
                page, asked = self._ask(shard, at, end, "", "timestamp")
            except FeedError as e:
                # even the smallest page is too slow: ask for less time
                if not e.slow or end - at <= SMALLEST_SPAN:
                    raise
                span = max(SMALLEST_SPAN, (end - at) // 4)
                continue
            fresh = [f for f in page if f["id"] not in seen]
            yield from fresh
            if len(page) < asked:
                at, seen = end, set()
                span = None if span is None else span * 2
                continue
            last = int(page[-1]["timestamp"])
            if last == at:
                # one second fills a page: all of it by id, then on
                after = ""
                seen |= {f["id"] for f in page}
                while True:
                    rest, asked = self._ask(shard, at, at + 1, after, "id")
                    yield from (f for f in rest if f["id"] not in seen)
                    seen |= {f["id"] for f in rest}
                    if len(rest) < asked:
                        break
                    after = rest[-1]["id"]
                at, seen = at + 1, set()
            else:
                seen = {f["id"] for f in page if int(f["timestamp"]) == last}
                at = last


def fill_row(f: dict, token: str) -> tuple:
    market = f.get("market")
    market = market.get("id") if isinstance(market, dict) else market
    node = lambda x: {"id": x["id"] if isinstance(x, dict) else x}
    return (f["id"], f["transactionHash"], str(f["timestamp"]), str(f["price"]), str(f["size"]), f["side"], node(f["maker"]), node(f["taker"]), market or token)


#: Fills that a probe asks for.
PROBE = 100
# Fixed by the index: how far it has come.
_HEAD_QUERY = "{ _meta { block { timestamp } } }"


def _names(options: Mapping) -> list[str]:
    return [t.strip() for t in options["tokens"].split(",")]


class _FillShards:
    """Plans shards of fills and reads them."""

    def __init__(self, options: dict):
        self.options = CaseInsensitiveDict(options)

    def shards(self, token: str, start: int, end: int) -> list[InputPartition]:
        """Shards of a token's seconds [start, end) that hold about equal numbers of fills; of equal times if the option balance is false."""
        o = self.options
        n = max(1, int(o.get("shards", 1)))
        if str(o.get("balance", "true")).lower() == "false" or n == 1:
            cuts = [start + (end - start) * i // n for i in range(n + 1)]
        else:
            cuts = balanced(start, end, n, lambda a, b: self._about(token, a, b))
        return [Shard(token, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def _about(self, token: str, start: int, end: int) -> float:
        """Number of fills: exact if a probe holds them all, else as if they went on as the probe's do."""
        variables = {"market": token, "from": str(start), "to": str(end), "after": "", "first": PROBE}
        page = call(_transport(self.options), _url(self.options, "fills"), {"query": _FILL_QUERY % "timestamp", "variables": variables}, tries=3, pause=_pause(self.options))["data"]["fills"]
        if len(page) < PROBE:
            return float(len(page))
        return len(page) * (end - start) / (int(page[-1]["timestamp"]) - start + 1)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Shard)
        return (fill_row(f, partition.token) for f in FillPages(self.options).read(partition))


class _FillsReader(_FillShards, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [p for t in _names(self.options) for p in self.shards(t, int(self.options["start"]), int(self.options["end"]))]


class _FillsStream(_FillShards, DataSourceStreamReader):
    """Fills from the checkpoint's offset on; the offset is the next second to read of each token. A token that is new to the checkpoint begins at the option start."""

    def initialOffset(self) -> dict:
        return {t: int(self.options["start"]) for t in _names(self.options)}

    def latestOffset(self) -> dict:
        """The second that the index is in may still grow: it is read once the index is past it."""
        head = call(_transport(self.options), _url(self.options, "fills"), {"query": _HEAD_QUERY}, pause=_pause(self.options))["data"]["_meta"]["block"]["timestamp"]
        to = max(int(self.options["start"]), min(int(head), int(self.options.get("end", head))))
        return {t: to for t in _names(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for t, to in end.items() if (at := start.get(t, int(self.options["start"]))) < to for p in self.shards(t, at, to)]


class ChainFills(DataSource):
    """Indexed fills of tokens (comma-separated) in [start, end), dealt to shards. Options: url, tokens, start, end, shards (of each token), balance, limit. A stream may have no end; it resumes from its checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "chain_fills"

    def schema(self) -> str:
        return RAW_FILLS

    def reader(self, schema) -> DataSourceReader:
        return _FillsReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FillsStream(self.options)


# Fixed by the services: how a block range is written in an error, and the fields of a token's order book.
RANGE_FORMAT = r"\[0x[0-9a-fA-F]+,\s*0x([0-9a-fA-F]+)\]"
_BOOK_QUERY = "query($token: ID!) { orderbook(id: $token) { id tradesQuantity buysQuantity sellsQuantity scaledCollateralVolume } }"


@dataclass
class Blocks(InputPartition):
    lo: int
    hi: int


class _LogShards:
    """Plans shards of blocks and reads them."""

    FEW, WIDEST = 2000, 100_000
    #: Blocks that a probe looks at.
    PROBE = 25

    def __init__(self, options: dict):
        self.options = CaseInsensitiveDict(options)

    def shards(self, lo: int, hi: int) -> list[InputPartition]:
        """Shards of the blocks [lo, hi) that hold about equal numbers of logs; of equal numbers of blocks if the option balance is false."""
        o = self.options
        n = max(1, int(o.get("shards", 10)))
        if str(o.get("balance", "true")).lower() == "false" or n == 1:
            cuts = [lo + (hi - lo) * i // n for i in range(n + 1)]
        else:
            cuts = balanced(lo, hi, n, self._about, 6, 12)
        return [Blocks(a, b - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def _about(self, lo: int, hi: int) -> float:
        """Number of logs, as if all blocks were like the few at both ends and in the middle; a range that the service finds too large to answer counts as full."""
        few = min(self.PROBE, hi - lo)
        places, found = {lo, lo + (hi - lo - few) // 2, hi - few}, 0
        for at in places:
            answer = self._ask(at, at + few - 1, 3)
            found += self.FEW if "error" in answer else len(answer["result"])
        # a block without logs is still a block to scan
        return (found / (few * len(places)) + 1 / self.WIDEST) * (hi - lo)

    def _ask(self, lo: int, hi: int, tries: int) -> dict:
        o = self.options
        params = [{"address": o["address"], "topics": [o["topic"]], "fromBlock": hex(lo), "toBlock": hex(hi)}]
        return call(_transport(o), _url(o, "logs"), {"jsonrpc": "2.0", "id": 1, "method": "eth_getLogs", "params": params}, tries=tries, pause=_pause(o))

    @staticmethod
    def suggested(error: str, at: int, to: int) -> int | None:
        """Last block of the range that an answer names as one that works, if it is a part of what was asked."""
        found = re.search(RANGE_FORMAT, error)
        last = int(found.group(1), 16) if found else -1
        return last if at <= last < to else None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Blocks)
        o = self.options
        wanted = [token_hex(t) for t in _names(o)]
        at, span = partition.lo, int(o.get("span", 10_000))
        while at <= partition.hi:
            to = min(partition.hi, at + span - 1)
            answer = self._ask(at, to, 8)
            if "error" in answer:
                if to == at:
                    raise FeedError(str(answer["error"]))
                span = (self.suggested(str(answer["error"]), at, to) or at + (to - at + 1) // 2 - 1) - at + 1
                continue
            for log in answer["result"]:
                if any(w in log["data"] for w in wanted):
                    yield tuple(log.get(c) for c in _fields(RAW_LOGS))
            at = to + 1
            if len(answer["result"]) < self.FEW:
                span = min(self.WIDEST, span * 2)


class _LogsReader(_LogShards, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.shards(int(self.options["startBlock"]), int(self.options["endBlock"]) + 1)


class _LogsStream(_LogShards, DataSourceStreamReader):
    """Logs from the checkpoint's block on, up to the chain's newest block less `confirmations`, which may still be replaced."""

    def initialOffset(self) -> dict:
        return {"block": int(self.options["startBlock"])}

    def latestOffset(self) -> dict:
        o = self.options
        newest = int(call(_transport(o), _url(o, "logs"), {"jsonrpc": "2.0", "id": 1, "method": "eth_blockNumber", "params": []}, pause=_pause(o))["result"], 16)
        last = min(newest - int(o.get("confirmations", 64)), int(o.get("endBlock", newest)))
        return {"block": max(int(o["startBlock"]), last + 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.shards(start["block"], end["block"]) if start["block"] < end["block"] else []


class ChainLogs(DataSource):
    """Logs of a contract in a range of blocks that name one of the tokens. Options: url, address, topic, tokens, startBlock, endBlock, shards, balance, span. A stream may have no endBlock, stays `confirmations` blocks behind the chain, and resumes from its checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "chain_logs"

    def schema(self) -> str:
        return RAW_LOGS

    def reader(self, schema) -> DataSourceReader:
        return _LogsReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogsStream(self.options)


def book_counters(spark: SparkSession, options: dict, tokens: list[str]) -> DataFrame:
    """market, expected, buys, sells: the index's own counts of a few tokens' fills, to compare a tape with."""
    rows = []
    for token in tokens:
        book = call(_transport(options), _url(options, "fills"), {"query": _BOOK_QUERY, "variables": {"token": token}}, pause=_pause(options))["data"]["orderbook"]
        rows.append((token, *[int(book[c]) for c in ("tradesQuantity", "buysQuantity", "sellsQuantity")]))
    return spark.createDataFrame(rows, "market string, expected long, buys long, sells long")


def newest_trade(spark: SparkSession, options: dict) -> DataFrame:
    """venue, trade_id of the newest trade that the exchange lists; trades come newest first."""
    query = urllib.parse.urlencode({"ticker": options["ticker"], "limit": 1})
    found = call(_transport(options), f"{_url(options, 'trades')}?{query}", pause=_pause(options))["trades"]
    return spark.createDataFrame([("kalshi", t["trade_id"]) for t in found[:1]], "venue string, trade_id string")


def register(spark) -> None:
    for source in (ExchangeTrades, ChainFills, ChainLogs):
        spark.dataSource.register(source)
