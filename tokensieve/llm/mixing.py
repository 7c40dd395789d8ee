"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are in key order; the leading hex digits of the key cut
that order into ranges, whose sizes are summed and accumulated (one row per source and range), and a running sum
inside each range completes the distributed prefix sum. A source's budget is then whole epochs over the source
plus the rows at the front of its order, cut at the exact word.

A hot source is spread over all its ranges, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.exact_dedup import scanned, with_locator

#: Hex digits of the key that name a range: 16 ** DIGITS ranges for each source.
DIGITS = 3
WEIGHTS = (1, 2, 3)
CAP = 3


def n_words(text: Column) -> Column:
    """The number of words; 0 for null. Each word and the white space before it become one character."""
    space = r"\x20\x09-\x0D"
    trimmed = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.length(F.regexp_replace(trimmed, f"[{space}]*+[^{space}]++", "x")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources in code point order, null last, weigh as weights repeat; all sizes are shared by weight, no target
    passes cap times its source's size, and what is cut off is shared again among the others. That fixed point is
    found at once: sorted by the share at which they fill up, sources fill as long as the common share exceeds it.
    One row per source passes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("w", weigh.cast("long")).withColumn("cap", F.col("source_size") * cap)
    w = w.withColumn("full_at", F.col("cap").cast("double") / F.col("w"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    left = F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = left.cast("double") / (F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.withColumn("share", share)
    level = F.min(F.when(F.col("full_at") > F.col("share"), F.struct("full_at", "share"))).over(total)["share"]
    w = w.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("full_at") <= F.col("level")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return w.select("source", "source_size", target.alias("target"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "") -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, and the row's place (_place).

    Null texts have size 0 and null sources are a source of their own, the last. Repeated ids follow each other in
    the order (size, place). A source without words has target 0. An empty table gives an empty result. Other
    columns of docs are not read. taken sums up, for each source, to the integer part of its target.
    """
    rows = with_locator(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    sized = common.stored(rows.select("id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), "_place"), "sized")
    sized = sized.withColumn("range", F.substring("key", 1, DIGITS))

    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    per_source = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    starts = starts.join(per_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "words")
    starts = starts.withColumnsRenamed({"source": "of", "range": "at"})

    inside = Window.partitionBy("source", "range").orderBy("key", "size", "_place")
    running = sized.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = running.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("try_divide(floor(target), source_size)").cast("long"), F.lit(0))
    joined = joined.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"), "_place")


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each epoch that takes a document, whole documents only.

    The one document of a source at which the budget is cut is taken whole; documents without words are never taken.
    The columns stay, whatever their names. Null sources are a source of their own, null ids are ids like any other,
    repeated rows are taken one by one in the order of their places. An empty table gives an empty result.
    """
    plain, names = common.renamed(docs)
    plain = scanned(plain)
    of = {k: names[options.pop(k, default)] for k, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    taken = mix(spark, plain, **of, **options).filter("taken > 0").select("_place", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    out = with_locator(plain).join(taken, "_place")
    return common.restored(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))), names)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, common.documents(spark, sf_dir)).drop("_place")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / w AS full_at FROM s
), g AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS share
  FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (SELECT share FROM g WHERE full_at > share ORDER BY full_at, share LIMIT 1) AS level
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR full_at <= level THEN cap::DOUBLE ELSE w * level END AS target FROM f, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""
