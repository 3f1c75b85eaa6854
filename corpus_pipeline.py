"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.

Defined results: rows travel whole, so other columns pass whatever their names
are; an empty table stays empty. Documents without text fail the quality rules;
those without an id are kept by all stages but link with no other, come first
in the removal of passages, and pass through packing. Repeated rows are judged
alike, and one of them stays. Labels with nulls are ignored, and without labels
the first two stages use the base rule and keep all.

Texts go to Python workers in Arrow batches of ``BATCH_BYTES``, as an executor
holds each batch several times over (in the JVM and in the worker) for each of
its cores. Stages set this in their session; a lower setting stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import minhash, packing, quality, suffix, toxicity
from tidewater.llm._spark import table, written

BATCH_BYTES = 2 << 20  # packing encodes at most as many at once; no result depends on it
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, whose session sends Arrow batches of BATCH_BYTES at most (and a row); its plan may run later, so the setting stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
        if not 0 < now <= BATCH_BYTES:
            spark.conf.set(_BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


@_bounded
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(docs)


@_bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

ORACLE_SQL = None  # tokenizers and learned models are beyond SQL; a test holds each stage and run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
