"""Shards of equal work, and streams that resume, against feeds recorded in a file that tasks read too."""

import json

import pytest

from crossloom.sources import feeds
from crossloom.sources.balance import balanced


def recorded(url, payload):
    """The transport: url names a JSON file with head, block, fills (time, token), logs (block) and, for planning tests, a list of calls."""
    with open(url) as f:
        feed = json.load(f)
    if "method" in payload:
        if payload["method"] == "eth_blockNumber":
            return {"result": hex(feed["block"])}
        (q,) = payload["params"]
        lo, hi = int(q["fromBlock"], 16), int(q["toBlock"], 16)
        assert hi <= feed["block"], "a block that does not exist yet"
        return {"result": [{"topics": [], "data": "0x" + format(11, "064x"), "transactionHash": f"0x{b:x}-{i}", "logIndex": hex(i), "blockTimestamp": hex(b)} for i, b in enumerate(feed["logs"]) if lo <= b <= hi]}
    if "_meta" in payload["query"]:
        return {"data": {"_meta": {"block": {"timestamp": feed["head"]}}}}
    v = payload["variables"]
    rows = [(t, f"{i:06d}") for i, (t, token) in enumerate(feed["fills"]) if token == v["market"] and int(v["from"]) <= t < int(v["to"]) and t <= feed["head"]]
    rows = [r for r in sorted(rows, key=lambda r: r[1] if "orderBy: id" in payload["query"] else r) if r[1] > v["after"]][: v["first"]]
    return {"data": {"fills": [{"id": i, "transactionHash": "0x", "timestamp": str(t), "price": "0.5", "size": "1", "side": "BUY", "maker": {"id": "m"}, "taker": {"id": "t"}, "market": {"id": v["market"]}} for t, i in rows]}}


TRANSPORT = "tests.test_feeds:recorded"
#: A year, nine tenths of whose fills lie in two hours.
SKEWED = sorted([(31_536_000 * i // 300, "11") for i in range(300)] + [(20_000_000 + 7_200 * i // 2700, "11") for i in range(2700)])


def save(path, **feed):
    path.write_text(json.dumps({"head": 10**9, "block": 10**6, "fills": [], "logs": []} | feed))


def test_balanced_cuts():
    mass = [1] * 1000 + [500] * 10 + [0] * 2000
    cuts = balanced(0, len(mass), 6, lambda a, b: float(sum(mass[a:b])))
    held = [sum(mass[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert (cuts[0], cuts[-1], sum(held)) == (0, len(mass), sum(mass)) and cuts == sorted(set(cuts)) and max(held) < 1.6 * sum(mass) / 6
    assert balanced(5, 5, 3, lambda a, b: 0.0) == [5]
    assert balanced(5, 6, 3, lambda a, b: 9.0) == [5, 6]
    assert balanced(0, 100, 4, lambda a, b: 0.0)[-1] == 100


def test_fill_shards_of_a_skewed_feed_are_even(tmp_path):
    save(tmp_path / "feed", fills=SKEWED)
    options = {"transport": TRANSPORT, "url": str(tmp_path / "feed"), "tokens": "11", "start": 0, "end": 31_536_000, "shards": 8, "pause": 0}
    reader = feeds._FillsReader(options)
    parts = reader.partitions()
    assert [p.start for p in parts[1:]] == [p.end for p in parts[:-1]] and (parts[0].start, parts[-1].end) == (0, 31_536_000)
    held = [len(list(reader.read(p))) for p in parts]
    assert sum(held) == len(SKEWED) and max(held) < 1.5 * len(SKEWED) / 8
    even = feeds._FillsReader(options | {"balance": "false"})
    assert max(len(list(even.read(p))) for p in even.partitions()) > 0.9 * len(SKEWED)


def test_log_shards_of_a_skewed_chain_are_even(tmp_path):
    logs = list(range(0, 100_000, 100)) + [b for b in range(40_000, 42_000) for _ in range(4)]
    save(tmp_path / "feed", logs=logs)
    reader = feeds._LogsReader({"transport": TRANSPORT, "url": str(tmp_path / "feed"), "address": "a", "topic": "t", "tokens": "11", "startBlock": 0, "endBlock": 99_999, "shards": 6, "pause": 0})
    parts = reader.partitions()
    assert [p.lo for p in parts[1:]] == [p.hi + 1 for p in parts[:-1]] and (parts[0].lo, parts[-1].hi) == (0, 99_999)
    held = [len(list(reader.read(p))) for p in parts]
    assert sum(held) == len(logs) and max(held) < 1.6 * len(logs) / 6


def land(spark, source, options, folder):
    """All that the feed has now goes to a folder, by a query that stops then; the next call is a restart."""
    rows = spark.readStream.format(source).options(**options).load()
    q = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@pytest.fixture
def sources(spark):
    feeds.register(spark)
    return spark


def test_fills_stream_resumes_without_loss_or_repeats(sources, tmp_path):
    fills = [(t, token) for t in [1, 2, 2, 2, 3, 4, 4, 9, 9, 12, 15] for token in ("11", "22")]
    options = {"transport": TRANSPORT, "url": str(tmp_path / "feed"), "tokens": "11, 22", "start": 0, "shards": 3, "limit": 3, "pause": 0}
    keys = lambda df: sorted(int(r["id"]) for r in df.select("id").collect())
    for head, end in ((4, 4), (4, 4), (9, 9), (20, 20)):
        save(tmp_path / "feed", fills=fills, head=head)
        got = land(sources, "chain_fills", options, tmp_path)
        # the second that the index is in is not yet read
        assert keys(got) == [i for i, (t, _) in enumerate(fills) if t < end]
    offsets = json.loads(sorted((tmp_path / "check/offsets").glob("[0-9]*"), key=lambda p: int(p.name))[-1].read_text().splitlines()[-1])
    assert offsets == {"11": 20, "22": 20}
    # a token that the checkpoint does not know is read from the start, the others go on
    fills += [(t, "33") for t in (1, 5, 19)] + [(21, "11")]
    save(tmp_path / "feed", fills=fills, head=30)
    got = land(sources, "chain_fills", options | {"tokens": "11,22,33"}, tmp_path)
    assert keys(got) == list(range(len(fills)))


def test_stream_reads_in_tasks(sources, tmp_path):
    options = {"transport": TRANSPORT, "url": str(tmp_path / "feed"), "tokens": "11", "start": 0, "end": 31_536_000, "shards": 8, "pause": 0}
    save(tmp_path / "feed", fills=SKEWED)
    s = feeds._FillsStream(options)
    parts = s.partitions(s.initialOffset(), s.latestOffset())
    assert len(parts) == 8 and sorted(r[0] for p in parts for r in s.read(p)) == [f"{i:06d}" for i in range(len(SKEWED))]
    assert s.latestOffset() == {"11": 31_536_000} and s.partitions(s.latestOffset(), s.latestOffset()) == []


def test_logs_stream_resumes_behind_the_chain(sources, tmp_path):
    logs = [5, 5, 6, 20, 21, 40, 41, 42]
    options = {"transport": TRANSPORT, "url": str(tmp_path / "feed"), "address": "a", "topic": "t", "tokens": "11", "startBlock": 5, "shards": 2, "confirmations": 2, "pause": 0}
    for newest in (4, 22, 22, 43, 44):
        save(tmp_path / "feed", logs=logs, block=newest)
        got = sorted(r["transactionHash"] for r in land(sources, "chain_logs", options, tmp_path).collect())
        assert got == sorted(f"0x{b:x}-{i}" for i, b in enumerate(logs) if b <= newest - 2)
