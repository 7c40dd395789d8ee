"""What the corpus operators share: text rules, settings and joins that check sizes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.sources.scratch import scratch, stored

__all__ = ["BATCHES", "LOWER", "UPPER", "WORD", "documents", "few", "lower_ascii", "partitions", "renamed", "restored", "scratch", "settings", "stored", "without"]

#: Fixed values of the text contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null stays null."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(spark: SparkSession, share: int = 16) -> int:
    """Files for a table that is small beside the input, one for each `share` shuffle partitions.

    Where Hadoop has no native library, an executor starts `chmod` three times for each file that it writes to a local
    folder, and until that runs the new process shares the executor's whole memory. So small tables shouldn't be scattered.
    """
    return max(1, partitions(spark) // share)


#: Arrow batches by bytes too: 10,000 rows of long texts, or of two sets each, take a GB.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names that no operator uses for its own columns, and the new name of each column."""
    names = {c: f"_k{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that renamed() renamed, under their names again."""
    return docs.select(*(F.col(n).alias(c) for c, n in names.items()))


#: Rows that a join may broadcast, a few MB of keys; counted before.
BROADCAST_ROWS = 100_000


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """docs less the rows whose key is in dropped(key).

    Whatever is dropped is stored and counted: if it is small, it is broadcast and the texts stay where they are;
    else both sides are shuffled.
    """
    gone = stored(dropped.select(F.col(key).alias("_gone")).distinct(), "dropped")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["_gone"], "left_anti")
