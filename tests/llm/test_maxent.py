"""The language model against plain recomputations: probabilities, updates, gain over counts on unseen texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.llm import maxent_lm as m
from crossloom.llm.words import U


def _flat(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _prose(n, words=25, seed=3):
    """Two languages without a common word; a word's ending tells its language."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        tongue = "ab"[i % 2]
        out.append(" ".join(f"{'xyzuvw'[int(k) % 6]}{int(k)}{tongue}" for k in rng.zipf(1.3, words) % 40))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    texts = [*_prose(400), "", None, "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, counts = m.train(docs)
    return texts, docs, model, counts


def _plain_log10(model, counts, text, extra=None):
    """Each token's log10 probability by loops over all outputs; extra: a hash whose probability at each place is asked for instead."""
    tok, cuts = m.tokens(*_flat([text]))
    out = []
    for i in range(len(tok)):
        t = tok[i] if extra is None else extra
        tail = int(t) % 4096
        ctx = [x[i : i + 1] for x in m.contexts(tok, cuts)]
        c = int(model.vocabulary.of_tail[tail])
        z = [float(model.bias[k]) + sum(float(model.weights[int(r[0]), k]) for r in m.rows_of(ctx)) for k in range(m.CLASSES)]
        p = math.exp(z[c]) / sum(map(math.exp, z))
        if c != m.CLASSES - 1:
            rows = m.rows_of(ctx, np.array([c]))
            z = [float(model.word_bias[c, k]) + sum(float(model.word_weights[int(r[0]), k]) for r in rows) for k in range(m.SLOTS)]
            own = dict(zip(model.vocabulary.listed.tolist(), model.vocabulary.slots.tolist(), strict=True)).get(int(t), m.SLOTS - 1)
            p *= math.exp(z[own]) / sum(map(math.exp, z))
            if own == m.SLOTS - 1:
                p *= (counts.get(int(t), 0) + 1) / 10 ** model.log_rest[c]
        out.append(math.log10(p))
    return out


def test_scores_equal_plain_softmaxes(spark, fitted):
    texts, docs, model, counts = fitted
    known = {r["h"] % 2**64: r["n"] for r in counts.collect()}
    total, kinds = sum(known.values()), len(known)
    got = {r["doc_id"]: r for r in m.score(docs, model, counts).collect()}
    for i in (0, 1, 2, 17, 400, 401, 402):
        tok, _ = m.tokens(*_flat([texts[i]]))
        want = sum(_plain_log10(model, known, texts[i] or ""))
        base = sum(math.log10((known.get(int(t), 0) + 1) / (total + kinds + 1)) for t in tok)
        assert abs(got[i]["score"] - want) < 1e-3 * len(tok)
        assert abs(got[i]["base_score"] - base) < 1e-9 * len(tok)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tok), len(tok), total)


def test_probabilities_sum_to_one(fitted):
    texts, _, model, counts = fitted
    rows = counts.collect()
    known = {r["h"] % 2**64: r["n"] for r in rows}
    sums = np.zeros(len(texts[1].split()) + 1)
    for h in {int(h) for t in texts for h in m.tokens(*_flat([t]))[0]}:
        sums += 10 ** np.array(_plain_log10(model, known, texts[1], U(h)))
    # one unknown word of each class takes the rest
    for c in range(m.CLASSES - 1):
        tail = np.flatnonzero(model.vocabulary.of_tail == c)
        if len(tail):
            sums += 10 ** np.array(_plain_log10(model, known, texts[1], U(4096 + int(tail[0]))))
    empty = [c for c in range(m.CLASSES - 1) if not (model.vocabulary.of_tail == c).any()]
    assert (sums <= 1 + 1e-6).all()
    assert (sums > 1 - 1e-6 - len(empty) * 0.02).all()


def test_unseen_texts_gain_from_context(spark, fitted):
    _, _, model, counts = fitted
    fresh = _prose(60, seed=77)
    rows = m.score(spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string"), model, counts).collect()
    n = sum(r["n_tokens"] for r in rows)
    gain = (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / n
    assert gain > 0.15


def test_one_batch_steps_every_template(monkeypatch):
    """One batch against loops: AdaGrad over the gradient of both softmaxes."""
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 0.1, (int(m._BASE[-1]), m.CLASSES)).astype(np.float32)
    bias = rng.normal(0, 1, m.CLASSES).astype(np.float32)
    tok, cuts = m.tokens(*_flat(_prose(4, 10)))
    rows, y = m.rows_of(m.contexts(tok, cuts)), rng.integers(0, m.CLASSES, len(tok))
    s = m.Steps(weights)
    s.step(rows, bias, y)
    z = np.array([bias.astype(float) + sum(weights[r[i]].astype(float) for r in rows) for i in range(len(tok))])
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    gradient, seen = np.zeros(weights.shape), np.zeros(len(weights))
    for r in rows:
        for i in range(len(tok)):
            gradient[r[i]] -= p[i]
            gradient[r[i], y[i]] += 1
            seen[r[i]] += 1
    want = weights + m.RATE * gradient / np.sqrt(1 + gradient**2)
    assert np.abs(s.weights - want).max() < 1e-4
    assert (s.seen == seen).all()
    for k in range(3):
        at = slice(m._BASE[k], m._BASE[k + 1])
        assert np.abs(s.weights[at] - weights[at]).max() > 1e-3


def test_rounds_cover_every_text_once(spark, fitted):
    _, docs, model, _ = fitted
    share = F.pmod(F.xxhash64(F.coalesce("doc_id", F.length("text").cast("long"))), F.lit(m.ROUNDS))
    parts = [docs.where(share == k).count() for k in range(m.ROUNDS)]
    assert sum(parts) == docs.count() and min(parts) > 0
    assert np.abs(model.weights).max() > 0.05 and np.abs(model.word_weights).max() > 0.05


def test_odd_rows(spark):
    rows = [(None, "a b", "x"), (1, "a c", "y"), (1, "a c", "y"), (1, "d", None), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    model, counts = m.train(docs)
    got = m.score(docs, model, counts).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(False, 1, 2), (False, 1, 3), (False, 1, 3), (False, 2, 1), (True, 0, 3)]
    assert all(r["n_known"] == r["n_tokens"] for r in got)
    none, no_counts = m.train(docs.limit(0))
    blank = m.score(docs, none, no_counts).collect()
    assert len(blank) == 5 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) and r["base_score"] == 0 for r in blank)
    assert m.score(docs.limit(0), model, counts).count() == 0




def test_reach_goes_from_the_sum_to_the_mean_of_moves():
    tasks = np.array([1, 4, 4, 4, 16])
    got = m.reach(np.array([50, 4, 100, 4000, 16]), tasks, 100.0)
    # one task: as it moved; few tokens each: as the root of the tasks; many each: the mean
    assert np.allclose(got, [1, 2, 2, 1, 4])


def test_many_tasks_learn_nearly_as_much_as_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = {}
    for parts in (1, 4, 8):
        model, counts = m.train(docs.where(~held).repartition(parts, "doc_id"))
        r = m.score(docs.where(held), model, counts).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        found[parts], plain = r[0] / r[2], r[1] / r[2]
    assert max(found.values()) - min(found.values()) < 0.04 and min(found.values()) > plain + 0.15
