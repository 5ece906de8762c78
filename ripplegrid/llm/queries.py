"""Queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, kneser, lbl, minhash, mixing, parsing, tokenfiles, toxicity, warc
from .common import bounded_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.document_token_counts(table(spark, sf_dir, "documents"))


def op2_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_vamana_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to source weights n ** 0.5, as many rows as before expected."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), alpha=0.5, seed="mix-1")


def op7_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_documents(table(spark, sf_dir, "documents"))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found = (op1_separator_scan, op2_bpe_backtracking, op3_toxicity_cnn, op4_consistent_parsing, op5_vamana_search, op6_poisson_mixing, op7_log_bilinear_scores, op8_minmax_near_dedup, op9_kneser_ney_quality, op10_warc_zstd)
    return {f.__name__: _batched(f) for f in found}


def _batched(f: Query) -> Query:
    """A query sets its session's batches, which it owns."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, sf_dir)

    return run
