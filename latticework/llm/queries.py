"""Queries of the ten operators over their whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, classifier, fertility, linededup, packing, secretscan, simhash, simple8b, urlfilter
from .common import documents


def op1_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.pack_documents(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two increments: half of the documents under the rules that haven't changed since, then all under all rules."""
    earlier = tuple(r for r in secretscan.RULES if r.version == 1)
    return secretscan.scan_documents(documents(spark, sf_dir), increments=(earlier,))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, held against all rows."""
    return ann.nearest(documents(spark, sf_dir, "embeddings"), queries=F.col("id") % 20 == 0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(documents(spark, sf_dir, "pages"))


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_groups(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classifier.classify(docs, classifier.train(docs, documents(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_tokenizer_fertility, op2_simhash_near_dedup, op3_bpe_encode, op4_simple8b_tokens, op5_secret_scan, op6_nearest_neighbours, op7_url_filter, op8_fuzzy_line_dedup, op9_quality_classifier, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op5_secret_scan": secretscan.oracle_sql(), "op7_url_filter": urlfilter.oracle_sql()}
