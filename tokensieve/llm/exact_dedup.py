"""Exact deduplication with streaming keyed state.

Rows become a feed of (digest, id, locator). A Structured Streaming aggregation without watermark
holds, for each digest, the greatest (id, locator) and a count in a RocksDB state store; nothing
expires. The state is then read back as a table. Where a digest has several rows (a hit), the full
normalised bytes of each row are compared with those of the row that the state names; rows that
differ in spite of equal digests are grouped again by their whole text.

Only DataFrame and SQL operations: no Python runs on the executors. The aggregation combines before
its shuffle, so a text that a third of all rows repeat costs one row per map task; joins of rows to
their group are plain equi-joins of short rows, which adaptive execution splits where one key is
hot. Text is moved for hits alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tokensieve.llm import common

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

#: Lets a join drop rows without a partner before they are shuffled, by a Bloom filter of at most 8 MB.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
}


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _place() -> Column:
    return F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("_place")


def scanned(docs: DataFrame) -> DataFrame:
    """docs, if it reads files and so knows each row's place; else docs stored."""
    try:
        docs.select(_place())
        return docs
    except Exception as e:
        if "UNRESOLVED_COLUMN" not in str(e):
            raise
    return common.stored(docs, "rows")


def with_locator(docs: DataFrame) -> DataFrame:
    """docs with _place, each row's place in storage (file and row). Frames that don't read files are stored first."""
    return scanned(docs).select("*", _place())


def keyed_state(spark: SparkSession, path: str, schema: StructType, state_dir: str | None = None) -> DataFrame:
    """(digest, keeper, group_size) of the feed (digest, id, _place) stored at path, kept in streaming state.

    state_dir: a checkpoint folder to go on with; rows of earlier runs then still count. A new one otherwise.
    """
    at = state_dir or common.scratch(spark, "state")
    with common.settings(spark, STATE):
        arrivals = spark.readStream.schema(schema).parquet(path)
        kept = arrivals.groupBy("digest").agg(F.max(F.struct("id", "_place")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    state = spark.read.format("statestore").load(at)
    value = state.schema["value"].dataType
    # the value holds the aggregate's buffers: the only struct is the greatest (id, _place), the only long the count
    of = {type(f.dataType): f.name for f in value.fields if f.name != "digest"}
    return state.select(F.col("key.digest"), F.col("value")[of[StructType]].alias("keeper"), F.col("value")[of[LongType]].alias("group_size"))


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, digest=sha256) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, _place (the row's place in storage).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the greatest id stays (a null id is less than any); of repeated rows with one id, the one with the greatest place stays,
    so that each group keeps exactly one row. An empty table gives an empty result. Other columns of docs are
    not read, so their names don't matter.

    digest: what keys the state; anything weaker than SHA-256 (tests) still gives right results, by the check of bytes.
    """
    rows = with_locator(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.select("id", "_place", common.lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    keyed = rows.withColumn("digest", digest(F.col("norm")))
    keyed.select("digest", "id", "_place").write.parquet(path := common.scratch(spark, "keys"))
    feed = spark.read.parquet(path)
    groups = common.stored(keyed_state(spark, path, feed.schema, state_dir), "groups")
    hits = groups.filter("group_size > 1")

    single = feed.join(hits.select("digest"), "digest", "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "_place"
    )
    members = common.stored(feed.join(hits, "digest").select("digest", "id", "_place", "keeper", "group_size"), "members")
    with common.settings(spark, BLOOM):  # texts are moved for members alone
        texts = common.stored(rows.select("_place", "norm").join(members.filter("group_size > 1"), "_place"), "texts")
    is_keeper = F.col("keeper._place") == F.col("_place")
    first = texts.filter(is_keeper).select("digest", F.col("norm").alias("keeper_norm"))
    same = F.coalesce(F.col("norm") == F.col("keeper_norm"), F.lit(False)).alias("same")
    checked = common.stored(texts.join(first, "digest", "left").select("id", "_place", "digest", "keeper", "group_size", same), "checked")
    odd = checked.filter(~F.col("same"))
    if odd.isEmpty():
        twins = checked.select("id", F.col("keeper.id").alias("keep_id"), "group_size", is_keeper.alias("kept"), "digest", "_place")
    else:
        fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("n_odd"))
        equal = checked.filter("same").join(fewer, "digest", "left")
        equal = equal.select("id", F.col("keeper.id").alias("keep_id"), (F.col("group_size") - F.coalesce("n_odd", F.lit(0))).alias("group_size"), is_keeper.alias("kept"), "digest", "_place")
        own = odd.select("_place").join(texts.select("id", "_place", "norm", "digest"), "_place")
        again = own.groupBy("norm").agg(F.max(F.struct("id", "_place")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        twins = equal.unionByName(own.join(again, "norm").select("id", F.col("keeper.id").alias("keep_id"), "group_size", is_keeper.alias("kept"), "digest", "_place"))
    result = single.unionByName(twins)
    if digest is not sha256:
        return result.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "_place")
    return result.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "_place")


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The row of docs that each group of equal texts keeps; the columns stay, whatever their names.

    Null texts count as empty and are a group of their own, of which one row stays; so does one of repeated rows. An
    empty table gives an empty result.
    """
    plain, names = common.renamed(docs)
    plain = scanned(plain)
    dropped = exact_dedup(spark, plain, names["doc_id"], names["text"]).filter(~F.col("kept"))
    return common.restored(common.without(with_locator(plain), dropped, "_place"), names)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, common.documents(spark, sf_dir)).drop("_place")


SQL = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
