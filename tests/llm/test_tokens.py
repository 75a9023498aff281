"""Token counts through the cache, and the alignment of two tokenizers, against plain versions by the public libraries."""

import hashlib
import os
from collections import Counter

import pytest

from crossloom.llm import alignment, token_counts
from crossloom.llm.parts import parts

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n_tokens long, digest string, batch long, encoded string"
TEXTS = [
    None,
    "",
    " ",
    "  ",
    "\n",
    "one",
    "one",
    " one two",
    "one  two\n three\t\tfour ",
    "Über naïve 漢字 🙂🙃 \u0000 ​ x\u0085 y z",
    "a▁b and ▁",
    "<|endoftext|> is <s> plain </s> <unk> <0x0A> text<|endoftext|>",
    "don't we'll I'm 's ' s 'S",
    "12345 678 x9y8 1,000.00 #$%&*",
    "x" * 5000,
    "漢" * 700,
    " " * 300 + "end" + " " * 40,
    "a b c d e f g h " * 300,
    "\r\n\r\n  indented\n    code(x)\n",
    "é ẞ ß ﬁ ‮abc",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", 2, "y") for i, t in enumerate(TEXTS)] + [(None, "one", 1, "x", 2, "y"), (None, "null id", 1, "x", 2, "y"), (5, "one", 1, "x", 2, "y"), (5, "other text", 1, "x", 2, "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    as_default = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, b, as_default


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def byte_values():
    """Byte of each character of byte-level entries."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    out, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(extra)] = b
            extra += 1
    return out


def aligned_plainly(texts, plain):
    a, b, _ = plain
    of, own = byte_values(), []
    for t in texts:
        if not t:
            own.append(([], [], [], []))
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            own.append(([], [], [], []))
            continue
        span = lambda tokens: [(e - len(x), e) for x, e in zip(tokens, [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))], strict=True)] if len(tokens) < 400 else fast(tokens)

        def fast(tokens):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            return out

        sa, sb = span(ba), span(bb)
        links, j = [], 0
        for i, (lo, hi) in enumerate(sa):
            while sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                links.append((ia[i], ib[k]))
                k += 1
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, p, q = [], 0, 0
        for e in both:
            x, y = [], []
            while p < len(sa) and sa[p][1] <= e:
                x.append(ia[p])
                p += 1
            while q < len(sb) and sb[q][1] <= e:
                y.append(ib[q])
                q += 1
            groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
        own.append((ia, ib, groups, links))
    counts = Counter(x for o in own for x in o[3])
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for ia, ib, groups, links in own:
        n = [counts[x] for x in links]
        text = hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""
        out.append((len(ia), len(ib), len(groups), len(links), sum(c == top[x[1]] for c, x in zip(n, links, strict=True)), sum(n), text))
    return out, counts, top


def test_parts_join_to_the_text():
    for t in TEXTS:
        assert "".join(parts(t or "")) == (t or "")


def test_alignment_equals_plain(docs, plain):
    rows = rows_of(docs)
    want, counts, top = aligned_plainly([t for _, t in rows], plain)
    got = alignment.align(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert table(got) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=repr)
    pairs = {(r["id_a"], r["id_b"]): (r["n"], r["best"]) for r in alignment.pair_counts(docs, A, B).collect()}
    assert pairs == {x: (n, n == top[x[1]]) for x, n in counts.items()}
    assert {hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "" for r in alignment.groups(docs, A, B).collect()} == {w[-1] for w in want}


def test_alignment_by_many_tasks_batches_and_salts(spark, plain, monkeypatch):
    """Small batches and salts, one text in a third of all rows: the driver's knobs are values, so results stay the same."""
    texts = [t for t in TEXTS if t and len(t) < 300] * 3 + ["the same words again, and again"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    monkeypatch.setattr(alignment, "SALT_BYTES", 200)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    want, _, _ = aligned_plainly(texts, plain)
    assert table(alignment.align(docs, A, B)) == sorted(((i, *w) for i, w in enumerate(want)), key=repr)


def test_alignment_of_given_tables(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = rows_of(docs)
    want, _, _ = aligned_plainly([t for _, t in rows], plain)
    assert table(alignment.align(docs, A, B)) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=repr)


def test_alignment_forgets_and_flushes(plain, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBER", 50)
    monkeypatch.setattr(alignment, "FLUSH", 500)
    known = alignment.Aligned(alignment.Sides(A, B))
    texts = [t for t in TEXTS if t] * 2
    want, counts, _ = aligned_plainly(texts, plain)
    total = Counter()
    found = []
    for lo in range(0, len(texts), 3):
        got = alignment.Batch(known, texts[lo : lo + 3])
        assert got.counts.tolist() == [list(w[:3]) for w in want[lo : lo + 3]]
        found += [(s, c, k.astype("int64")) for s, _, c, k in got.links()]
    for s, cells, n in alignment._summed(iter(found)):
        for c, k in zip(cells.tolist(), n.tolist(), strict=True):
            total[c % known.sides.size_a, c // known.sides.size_a * known.stripes + s] += k
    assert total == counts


def test_empty_tables(docs):
    none = docs.where("doc_id < -5")
    assert alignment.align(none, A, B).collect() == []
    assert alignment.pair_counts(none, A, B).collect() == []
    assert token_counts.over_limit(none, A).collect() == []


@pytest.mark.parametrize("path", [A, B, str(public_tokenizers.path("word_bpe_49k.json"))])
def test_counts_equal_the_library(docs, path, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    if path == B:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = sorted(((i, len(t.encode()), count(t), count(t) > 512) for i, t in rows_of(docs)), key=repr)
    folder = f"file://{tmp_path}/cache"
    assert table(token_counts.over_limit(docs, path, folder=folder)) == want
    assert table(token_counts.over_limit(docs, path, folder=folder)) == want


def test_cache_encodes_distinct_misses_only(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/cache"
    distinct = len({t for _, t in rows_of(docs)})
    token_counts.count_tokens(docs, A, folder)
    cache = token_counts.Cache(spark, folder, A)
    rows = lambda: spark.read.option("recursiveFileLookup", True).parquet(cache.folder)
    assert rows().count() == distinct
    again = token_counts.count_tokens(docs, A, folder)
    assert again.where("encoded").count() == 0 and rows().count() == distinct
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(90, "new"), (91, "new"), (92, "newer")], "doc_id long, text string"))
    for few in (100_000, 0):
        monkeypatch.setattr(token_counts, "FEW", few)
        more = more.union(spark.createDataFrame([(93, f"for {few}")], "doc_id long, text string"))
        before = rows().count()
        got = token_counts.count_tokens(more, A, folder)
        assert sorted(r["doc_id"] for r in got.where("encoded").collect()) == ([90, 91, 92, 93] if few else [93])
        assert rows().count() == before + (3 if few else 1)
    # another tokenizer has counts of its own
    token_counts.count_tokens(docs, B, folder)
    assert len(os.listdir(f"{tmp_path}/cache")) == 2


def test_rows_that_the_cache_repeats_count_once(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/cache"
    want = table(token_counts.count_tokens(docs, A, folder).drop("encoded"))
    cache = token_counts.Cache(spark, folder, A)
    cache.append(cache.read(), 10)
    assert table(token_counts.count_tokens(docs, A, folder).drop("encoded")) == want


def test_counts_of_given_tables(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(((i, len(t.encode()), len(plain[2].encode(t, add_special_tokens=False).ids)) for i, t in rows_of(docs)), key=repr)
    assert table(token_counts.count_tokens(docs, A).drop("encoded")) == want
