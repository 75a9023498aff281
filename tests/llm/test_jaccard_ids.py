"""Null ids and ids with several texts in the Jaccard join, against brute force."""

import random

import pytest

from crossloom.llm import jaccard_join
from crossloom.llm.runtime import materialize


def brute(rows, k, percent):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(-1 if i is None else i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {x: low if c == high else c for x, c in comp.items()}
    return sorted((i, len(s), comp[i]) for i, s in sets)


def test_null_ids_and_ids_with_two_texts(spark):
    rng = random.Random(9)
    base = [[f"{c}{rng.randrange(500)}" for _ in range(60)] for c in "abcdef"]
    text = lambda c, end="": " ".join([*base[c], *end.split()])
    # 0: a null id and an ordinary one with one text, 11 near; 1 and 2: both texts of id 20; 3: a second text of id 30, whose node is 30 too
    rows = [(None, text(0)), (10, text(0)), (11, text(0, "x y")), (20, text(1)), (20, text(2)), (21, text(1, "x")), (22, text(2, "x y")), (15, text(2, "z")), (30, text(3)), (30, text(4)), (31, text(3, "q")), (32, text(4, "q")), (40, text(5)), (40, ""), (39, text(5, "r")), (50, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (docs.coalesce(1), docs.repartition(4)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(part, 5, 80).collect())
        assert got == brute(rows, 5, 80)


def test_keep_one_takes_every_row_as_a_document(spark):
    """Null ids, -1, ids of several texts and repeated rows: one row of each component stays, and no other text is lost."""
    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(50))
    own = [text() for _ in range(8)]
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (-1, own[3]), (7, own[4]), (7, own[5]), (8, own[6]), (8, own[6]), (None, own[0] + " more"), (3, own[1] + " more"), (9, own[7]), (None, None), (None, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, place string, n_shingles long").repartition(3)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    first = [r for r in got if r[0] is None and r[1] and r[1].startswith(own[0])]
    # of two rows without an id that are near each other, either may stay
    assert len(first) == 1
    assert sorted([r for r in got if r not in first], key=repr) == sorted([(None, own[2]), (-1, own[3]), (7, own[4]), (7, own[5]), (8, own[6]), (3, own[1] + " more"), (9, own[7]), (None, None), (None, ""), (5, None)], key=repr)


@pytest.mark.parametrize("centres", [10_000, 20, 2])
def test_components(spark, monkeypatch, centres):
    """Stars with low and high centres, chains and a loop against a union of sets; with few centres, most nodes meet by a shuffle."""
    monkeypatch.setattr(jaccard_join, "CENTRES", centres)
    rng = random.Random(centres)
    edges = [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(1000, 1300)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7), (6000, 6000), (1100, 250)]
    edges += [(3000 + i % 30, 3000 + (i + 1) % 30) for i in range(30)] + [(rng.randrange(4000, 4300), rng.randrange(4000, 4300)) for _ in range(120)]
    edges += rng.sample(edges, 50)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    got = jaccard_join.components(spark.createDataFrame([rng.choice([e, e[::-1]]) for e in edges], "a long, b long").repartition(5)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == {x: find(x) for x in root if x not in alone}


def test_a_step_of_the_components_has_few_stages(spark):
    edges = materialize(spark.createDataFrame([(i, i - 1) for i in range(1, 9)], "a long, b long"), "chain")
    context = spark.sparkContext
    context.setJobGroup("stars", "components of a chain")
    try:
        got = {r.node: r.component for r in jaccard_join.components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(9), 0)
    # each adaptive step posts its plan anew, so plans that repeat a subtree weigh on the driver
    tracker = context.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("stars")]
    assert sum(stages) < 110, (sum(stages), len(stages))
