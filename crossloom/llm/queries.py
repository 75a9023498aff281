"""The operators' queries over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, jaccard_join, language_id, maxent_lm, packing, pieces, quality_classifier, quality_rules, repeats, token_counts, url_filter, whitening


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (action, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Pages whose host has one of these words label the URLs that the trees learn from.
BLOCK_SEEDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def _held(n: int, k: int) -> Column:
    """Whether the id's remainder is k; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == k, F.lit(False))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.train(url_filter.seed_labels(pages, BLOCK_SEEDS)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(~_held(5, 0)))
    return quality_classifier.score(docs, model).select("doc_id", _held(5, 0).alias("held_out"), "score", "predicted")


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, counts = maxent_lm.train(docs.where(~_held(7, 2)))
    return maxent_lm.score(docs, model, counts).select("doc_id", _held(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~_held(4, 2)))
    return language_id.predict(docs, model).select("doc_id", _held(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op6_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.flag(_table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_url_filter, op2_fingerprints, op3_quality_classifier, op4_best_fit_packing, op5_jaccard_join, op6_long_repeats, op7_sentencepiece, op8_quality_rules, op9_maxent_lm, op10_language_id, op11_token_counts, op12_embedding_whitening, op13_tokenizer_alignment]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": jaccard_join.oracle(4, 85), "op6_long_repeats": repeats.oracle(), "op8_quality_rules": quality_rules.oracle()}
