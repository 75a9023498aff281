"""The pipeline against a plain version, stage by stage, on a table with nulls, repeats, empty texts and extra columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from crossloom.llm import packing, quality_classifier, quality_rules, runtime

from .test_exact import best_fit, linked, words

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, piece string"


def _texts():
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("tor", "mel", "san", "the", "ri", "lo") for b in ("na", "st", "ing", "er", "o", "um", "da")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out = []
    for i in range(90):
        t = [rng.choice(vocabulary) for _ in range(rng.choice([40, 60, 150, 400]))]
        out.append(" ".join(t) + (" " + passage if i % 9 == 0 else ""))
        if i % 10 == 0:
            out.append(" ".join(["other", *t[1:]]))
    junk = [" ".join(rng.choice(vocabulary) + rng.choice(["", "#"]) + rng.choice(["", "|"]) for _ in range(60)) for _ in range(25)]
    return [*out, *junk, None, "", "too short", "line one here\n" * 30, out[4], "x" * 6000, out[7] + " " + "y" * 3000]


def _stats(t):
    w, lines = words(t, lower=False), [x for x in (t or "").split("\n") if words(x)]
    seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    covered = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
    chars = max(1, sum(map(len, w)))
    ratios = {"symbol_ratio": len(re.findall(r"[#*$%&|<>]", t or "")) / chars, "upper_ratio": sum(map(str.isupper, t or "")) / chars, "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)), "repeat_ratio": len(covered) / max(1, len(w))}
    sizes = {"word_chars": sum(map(len, w)), "n_lines": len(lines), "n_words": len(w)}
    return len(w) < 20 or 100 * len(covered) > 30 * len(w), ratios | sizes


def _by_rules(rows):
    """Rows that the adaptive rules keep: exact quantiles by language and source, else by language, else of all."""
    stats = [_stats(r[1]) for r in rows]
    groups = defaultdict(list)
    for r, (failed, ratios) in zip(rows, stats, strict=True):
        if not failed:
            for level, key in enumerate(((r[2], r[3]), r[2], None)):
                groups[level, key].append(ratios)

    def at(values, q):
        v = sorted(values)
        return v[max(0, int(np.ceil(q * len(v))) - 1)]

    def fence(levels, m):
        own = [x[m] for x in next((g for g in levels[:2] if len(g) >= quality_rules.MIN_GROUP), levels[2])]
        size = at([x[quality_rules.STEPS[m][0]] for x in next((g for g in levels[:2] if len(g) >= quality_rules.MIN_GROUP), levels[2])], 0.5)
        high = max(at(own, 0.5) + quality_rules.SPREAD * (at(own, 0.75) - at(own, 0.5)), at(own, quality_rules.WIDE))
        if m in quality_rules.SELDOM:
            seen = [[x[m] for x in g if x[m] > 0] for g in levels]
            some = next((v for v, least in zip(seen, (quality_rules.MIN_GROUP, quality_rules.MIN_GROUP, 1), strict=True) if len(v) >= least), [0])
            high = max(high, at(some, 0.75) + quality_rules.SELDOM_SPREAD * (at(some, 0.75) - at(some, 0.5)))
        return high + quality_rules.STEPS[m][1] / max(1, size)

    kept = []
    for r, (failed, ratios) in zip(rows, stats, strict=True):
        levels = [groups[0, (r[2], r[3])], groups[1, r[2]], groups[2, None]]
        # a group without one good document has no row of its own and so no fence
        if not failed and all(ratios[m] <= fence(levels, m) for m in quality_rules.STEPS):
            kept.append(r)
    return kept


def _without_repeats(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[0]):
        x = r[1].encode()
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if x[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(x[p : p + length])
        out.append((r[0], bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def test_stages_equal_a_plain_version(spark, tmp_path):
    texts = _texts()
    rows = [(i, t, None if i % 13 == 0 else "en", None if i % 17 == 0 else f"s{i % 2}", len(t or ""), 0.5, "p") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("#" not in (t or "") and len(t or "") > 100)) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = _by_rules(rows)
    assert 0 < len(kept) < len(rows)
    learned = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, quality int")
    model = quality_classifier.train(docs, learned)
    x = {r.doc_id: [r[f] for f in quality_classifier.FEATURES] for r in quality_classifier.features(docs, ["doc_id"]).collect()}

    def score(i):
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[i][f] <= t) == low for f, low, t in rule))
        return 1 / (1 + np.exp(-z))

    kept = [r for r in kept if score(r[0]) >= quality_classifier.THRESHOLD]
    assert len(kept) > 60
    groups = linked([r[1] for r in kept], 5, 80)
    one = [r for k, r in enumerate(kept) if groups[k][1] == k]
    assert len(one) < len(kept)
    clean = _without_repeats(one)
    assert sum(len(t) for _, t in clean) < sum(len(r[1]) for r in one)

    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = []
    for i, t in clean:
        ids = [*coder.encode(t, add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == best_fit([n for *_, n, _ in want], packing.CAPACITY)


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, t, "en", "s", 1, 0.5, "p") for i, t in enumerate(_texts())]
    # ids that are null or repeat, once with the same text and once with another
    rows += [(None, rows[3][1], "en", "s", 1, 0.5, "p"), rows[5], (5, rows[8][1], None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_before_the_join_hold_one_copy_of_the_texts(spark, tmp_path, monkeypatch):
    rows = [(i, t, "en", f"s{i % 3}", None, 0.5, "p") for i, t in enumerate(_texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"file://{tmp_path}")
    good = quality_rules.keep_good(docs)
    # the fences meet the documents by a broadcast of known size, so no text is shuffled
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    n = good.count()
    before = set(tmp_path.iterdir())
    model = quality_classifier.fit(np.array([[float(i % 7 + j) for j in range(len(quality_classifier.FEATURES))] for i in range(200)]), np.array([float(i % 7 > 3) for i in range(200)]))
    best = quality_classifier.keep_good(docs, model)
    got = sorted(map(tuple, best.collect()), key=lambda r: r[0])
    assert n and set(tmp_path.iterdir()) == before
    ids = {r.doc_id for r in quality_classifier.score(docs, model).where(f"score >= {quality_classifier.THRESHOLD}").collect()}
    assert best.columns == docs.columns and got == [r for r in rows if r[0] in ids] and 0 < len(ids) < len(rows)
