"""Cuts of a range of times or blocks into shards of about equal work, from a few probes of how dense it is."""

from __future__ import annotations

import heapq
from collections.abc import Callable

#: About how much lies in [lo, hi).
Probe = Callable[[int, int], float]


def balanced(lo: int, hi: int, shards: int, probe: Probe, first: int = 2, then: int = 16) -> list[int]:
    """Rising cuts from lo to hi, at most shards + 1. first, then: probes for each shard, of even parts and of halves.

    The heaviest part is halved and its halves are probed until no part holds more than a quarter of a shard or the probes
    are spent; within a part what it holds counts as evenly spread.
    """
    if hi <= lo:
        return [lo]
    left, first = then * shards, max(1, min(first * shards, hi - lo))
    edges = [lo + (hi - lo) * i // first for i in range(first + 1)]
    parts = [(-probe(a, b), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    heapq.heapify(parts)
    done = []
    while parts and left > 0:
        weight, a, b = parts[0]
        if b - a < 2 or -weight <= -sum(p[0] for p in [*parts, *done]) / (4 * shards):
            done.append(heapq.heappop(parts))
            continue
        heapq.heappop(parts)
        middle = (a + b) // 2
        for x, y in ((a, middle), (middle, b)):
            heapq.heappush(parts, (-probe(x, y), x, y))
        left -= 2
    parts = sorted((a, b, -w) for w, a, b in [*parts, *done])
    total, cuts, before = sum(w for _, _, w in parts), [lo], 0.0
    for a, b, w in parts:
        for k in range(len(cuts), shards):
            want = total * k / shards
            if not before <= want < before + w:
                break
            cuts.append(max(cuts[-1], a + round((b - a) * (want - before) / w)))
        before += w
    return sorted({*cuts, hi})
