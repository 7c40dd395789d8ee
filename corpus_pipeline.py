"""A corpus pipeline: quality, exact copies, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame; all but the
last return the columns of documents. run() writes every stage as Parquet in the shared folder and rereads it.
Stages may be called one by one, without the registered query: each sets what its Python workers are told.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokensieve import workers
from tokensieve.llm import common, exact_dedup, mixing, near_dedup, quality, subword

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frugal(stage: Stage) -> Stage:
    """stage, with workers.MEMORY for the Python workers that it starts."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        workers.frugal(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@frugal
def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels that lie beside the corpus."""
    return quality.kept_documents(spark, docs, sf_dir)


@frugal
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the greatest id stays."""
    return exact_dedup.kept_documents(spark, docs)


@frugal
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.75 connect, the one with the least id stays."""
    return near_dedup.kept_documents(spark, docs)


@frugal
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch in which the mix takes a document."""
    return mixing.mixed_documents(spark, docs)


@frugal
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each row, segmented with merge-dropout.

    The mix repeats a row for each epoch; the copies are numbered here, so that each epoch has its own segmentation.
    """
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang")
    numbered = docs.select("doc_id", "lang", "source", "text", F.row_number().over(copies).alias("_epoch"))
    encoded = subword.encode(spark, numbered, keep=("lang", "source"), copy_col="_epoch")
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", accept_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

#: A learned classifier and a tokenizer are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
