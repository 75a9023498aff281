"""Quality rules with adaptive thresholds: DataFrame functions only.

Statistics of each text feed mergeable KLL quantile sketches per (language, source). Sketches of a
language and of the corpus are merges of those, and serve groups with few documents. A document is
rejected when a statistic lies beyond its group's upper fence: the greater of median + SPREAD * (upper quartile -
median) and the WIDE quantile, plus what a few characters, a line or a window weigh in a text of the group's median size
(STEPS). Repeated lines and words occur in few documents, good ones among them (SELDOM); their fence is also no less
than that of the documents in which they occur, upper quartile + SELDOM_SPREAD * (upper quartile - median) of these.
All these follow from the group, so fences differ from group to group.
Sketches are exact up to SKETCH_K documents; beyond that their merges are randomised, and a fence may differ a
little from run to run. Within a run there is one table of fences.

Defined cases: null text counts as empty; empty texts and texts under MIN_WORDS words fail the base
rule; a null language or source is a group of its own; repeated rows stay repeated rows; an empty
table gives an empty result; other columns of the input are passed through by ``flag`` unless their
names clash with the columns it adds, which then replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Items a sketch keeps exactly; beyond that its rank error is about 2.3 / SKETCH_K ** 0.9.
SKETCH_K = 4096
MIN_GROUP = 30
SPREAD = 6.0
WIDE = 0.875
#: Statistic -> of what it is a share, and how many of these a text of the group's median size may have beyond the quantiles.
STEPS = {"symbol_ratio": ("word_chars", 24), "upper_ratio": ("word_chars", 64), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", WINDOW)}
#: Statistics that most documents have none of.
SELDOM = ["dup_line_ratio", "repeat_ratio"]
SELDOM_SPREAD = 3.0
_SIZES = sorted({of for of, _ in STEPS.values()})
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _nth_hashes(words: str) -> Column:
    """Hash of the WINDOW words from each place on; shorter texts have none."""
    w = F.col(words)
    all_of = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(w) > WINDOW, F.slice(all_of, F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the ratios of STEPS."""
    keep = [c for c in docs.columns if c not in {"text", *BASE, *STEPS}]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"))
    a = a.withColumn("_words", F.filter(F.split("_text", SPACES), lambda x: x != ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumns({"_hash": F.transform("_words", lambda x: F.xxhash64(x)), "_lines": lines})
    a = a.withColumn("_win", _nth_hashes("_hash"))
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    a = a.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(none))
    s = F.col("_sorted")
    same = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    a = a.withColumn("_at", F.when(F.size(s) > 0, F.sort_array(F.transform(same, lambda x: x["p"]))).otherwise(F.array().cast("array<int>")))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda p, q: p + q)
    chars = F.length("_text")
    a = a.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (chars - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_at") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        (chars - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    over = lambda x, y: F.col(x).cast("double") / F.greatest(F.col(y), F.lit(1)).cast("double")
    return a.withColumns({"symbol_ratio": over("n_symbols", "word_chars"), "upper_ratio": over("n_upper", "word_chars"), "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words")})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def thresholds(stats: DataFrame) -> DataFrame:
    """One row per (lang, source): the fence of each statistic, from sketches over its documents that pass the base rule."""
    names = list(STEPS)
    sketch = lambda c, name: F.kll_sketch_agg_double(c.cast("double"), SKETCH_K).alias(name)
    some = {m: F.when(F.col(m) > 0, F.col(m)) for m in SELDOM}
    sketches = [*names, *_SIZES, *[f"some_{m}" for m in SELDOM]]
    sums = ["n", *[f"n_{m}" for m in SELDOM]]
    fine = stats.where(~base_failed()).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{m}") for m, c in some.items()], *[sketch(F.col(c), c) for c in (*names, *_SIZES)], *[sketch(c, f"some_{m}") for m, c in some.items()]
    )

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.kll_merge_agg_double(c).alias(c) for c in sketches])

    def fences(df: DataFrame, *keys: str, level: str) -> DataFrame:
        """keys; level: fences and steps of all statistics; level_m: the fence among the documents in which m occurs."""
        q = lambda c, r: F.kll_sketch_get_quantile_double(c, F.lit(r))
        least = MIN_GROUP if level != "all" else 1
        fence = lambda m: F.greatest(q(m, 0.5) + F.lit(SPREAD) * (q(m, 0.75) - q(m, 0.5)), q(m, WIDE))
        step = lambda m: F.lit(float(STEPS[m][1])) / F.greatest(q(STEPS[m][0], 0.5), F.lit(1.0))
        own = F.struct(*[fence(m).alias(m) for m in names], *[step(m).alias(f"step_{m}") for m in names])
        seldom = lambda m: q(f"some_{m}", 0.75) + F.lit(SELDOM_SPREAD) * (q(f"some_{m}", 0.75) - q(f"some_{m}", 0.5))
        return df.where("n > 0").select(*keys, F.when(F.col("n") >= least, own).alias(level), *[F.when(F.col(f"n_{m}") >= least, seldom(m)).alias(f"{level}_{m}") for m in SELDOM])

    by_lang = merged(fine, "lang")
    a, b, c = fences(fine, "lang", "source", level="own"), fences(by_lang, "lang", level="language"), fences(merged(by_lang), level="all")
    a = a.join(b.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang").join(F.broadcast(c), how="left")
    best = F.coalesce("own", "language", "all")
    seldom = {m: F.coalesce(f"own_{m}", f"language_{m}", f"all_{m}", F.lit(0.0)) for m in SELDOM}
    return a.select("lang", "source", *[(F.greatest(best[m], seldom.get(m, best[m])) + best[f"step_{m}"]).alias(f"max_{m}") for m in names])


def _within() -> Column:
    within = F.lit(True)
    for m in STEPS:
        within &= F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    return within


def flag(docs: DataFrame) -> DataFrame:
    """Adds the statistics, base_failed and kept to every row; text is dropped."""
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    drop = [f"max_{m}" for m in STEPS] + ["base_failed", "kept", "n_lines", "n_upper"]
    stats = materialize(statistics(docs.drop(*drop)), "quality-statistics")
    t = thresholds(stats).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = stats.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & _within())


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that the rules keep."""
    blank = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *blank)
    # written once, so that the filter does not repeat the statistics
    stats = materialize(statistics(rows), "quality-documents")
    # the fences too: as a small table of known size they meet the documents where these are, without a shuffle of all texts
    t = materialize(thresholds(stats), "quality-fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    judged = stats.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return judged.where(~base_failed() & _within()).select("_doc.*")


def oracle() -> str:
    """The same in DuckDB SQL, exact quantiles in place of sketches (which are exact up to SKETCH_K items)."""
    at = lambda x, r: f"{x}[greatest(1, ceil({r} * len({x})))::BIGINT]"
    fence = lambda m: f"greatest({at(f'v_{m}', 0.5)} + {SPREAD} * ({at(f'v_{m}', 0.75)} - {at(f'v_{m}', 0.5)}), {at(f'v_{m}', WIDE)})"
    step = lambda m: f"{STEPS[m][1]}::DOUBLE / greatest({at(f's_{STEPS[m][0]}', 0.5)}, 1)::DOUBLE"
    some = lambda m: f"{at(f'o_{m}', 0.75)} + {SELDOM_SPREAD} * ({at(f'o_{m}', 0.75)} - {at(f'o_{m}', 0.5)})"
    levels = []
    for level, keys in (("own", "lang, source"), ("language", "lang"), ("all_", "")):
        least = MIN_GROUP if keys else 1
        lists = [f"list_sort(list({m})) AS v_{m}" for m in STEPS] + [f"list_sort(list({c})) AS s_{c}" for c in _SIZES] + [f"list_sort(coalesce(list({m}) FILTER ({m} > 0), [])) AS o_{m}" for m in SELDOM]
        sel = f"{keys}, " if keys else ""
        cols = [f"CASE WHEN n >= {least} THEN {fence(m)} END AS f_{m}, CASE WHEN n >= {least} THEN {step(m)} END AS g_{m}" for m in STEPS] + [f"CASE WHEN len(o_{m}) >= {least} THEN {some(m)} END AS o_{m}" for m in SELDOM]
        levels.append(f"l_{level} AS (SELECT {sel}n, {', '.join(cols)} FROM (SELECT {sel}count(*) AS n, {', '.join(lists)} FROM good{' GROUP BY ' + keys if keys else ''}) WHERE n > 0)")
    # a group without one good document has no row of its own and so no fence
    best = lambda c: f"CASE WHEN o.n IS NOT NULL THEN coalesce(o.{c}, g.{c}, a.{c}) END"
    pick = lambda m: f"greatest({best(f'f_{m}')}, coalesce({f'o.o_{m}, g.o_{m}, a.o_{m}, 0' if m in SELDOM else f'{best(f"f_{m}")}'})) + {best(f'g_{m}')}"
    inside = " AND ".join(f"coalesce(s.{m} <= {pick(m)}, true)" for m in STEPS)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
dup AS (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM dup GROUP BY doc_id),
s0 AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_symbols::DOUBLE / greatest(word_chars, 1)::DOUBLE AS symbol_ratio, n_upper::DOUBLE / greatest(word_chars, 1)::DOUBLE AS upper_ratio,
  n_dup_lines::DOUBLE / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, n_repeat_words::DOUBLE / greatest(n_words, 1)::DOUBLE AS repeat_ratio,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM s0),
good AS (SELECT * FROM s WHERE NOT base_failed),
{', '.join(levels)}
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
  (NOT s.base_failed AND {inside}) AS kept
FROM s LEFT JOIN l_own o ON s.lang IS NOT DISTINCT FROM o.lang AND s.source IS NOT DISTINCT FROM o.source
LEFT JOIN l_language g ON s.lang IS NOT DISTINCT FROM g.lang LEFT JOIN l_all_ a ON true
"""
