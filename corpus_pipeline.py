"""Stages that turn raw documents into token ids: quality, toxicity, near-duplicates, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents, whatever other columns there are and however they are named. Models are trained on the labelled
rows of the documents table at sf_dir. Null texts count as empty; rows that repeat each other share their fate in the
first two stages, and one of them stays in the third; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import gc

from pyspark.sql import DataFrame, SparkSession

from ripplegrid.llm import bpe, kneser, minhash, mixing, toxicity
from ripplegrid.llm.common import bounded_batches, driver_trimmed, erased, executors_trimmed, table, written


def batched(stage):
    """A stage sets its session's batches, which the pipeline owns, and begins with what memory the last one left given back."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        executors_trimmed(spark)
        driver_trimmed(spark)
        out = stage(spark, docs, sf_dir)
        gc.collect()  # plans and broadcasts that this stage is done with
        driver_trimmed(spark)
        return out

    return run_stage


@batched
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Kneser-Ney perplexity is within their language's quantile of trusted text."""
    return kneser.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@batched
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@batched
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates on five-word shingles, that of the least id. Texts without words are linked to nothing; rows without an id stay."""
    return minhash.drop_near_duplicates(docs)


@batched
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources meet their target weights, in random order."""
    return mixing.poisson_mix(docs, alpha=0.5, seed="mix-1", copy_col="__copy", order_col="__order").select(*docs.columns)


@batched
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's id, token ids (16-bit little-endian numbers), their number, and digests of the ids and of their decoding."""
    return bpe.bpe_digests(docs, ids=True)


STAGES = [("quality", quality), ("toxicity", not_toxic), ("near_dedup", deduplicated), ("mixing", mixed), ("bpe", encoded)]

#: Trained models decide, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        erased(*before)
        before = [docs]
    return docs
