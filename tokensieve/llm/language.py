"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every training text (one pass; each task adds up dense counts and emits one
row per language and bucket in use, so a language that holds most rows costs no more than any other). The counts
form a matrix of at most BUCKETS x languages, whose log probabilities are broadcast; scoring gathers the rows of a
batch's n-grams and adds them up per document in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tokensieve.llm import common

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Code points handled at once; longer texts are cut into pieces that overlap by the longest n-gram less one.
PIECE = 1 << 19
SMOOTHING = 0.5
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of pieces: the row of each piece, all code points joined, and where each piece starts."""
    rows, parts, held = [], [], 0
    lap = max(ORDERS) - 1

    def packed():
        sizes = np.array([len(p) for p in parts])
        return rows, np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)[:-1]))

    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, max(1, len(codes) - lap), PIECE):
            piece = codes[at : at + PIECE + lap]
            if not len(piece):
                continue
            rows.append(i)
            parts.append(piece)
            held += len(piece)
            if held >= PIECE:
                yield packed()
                rows, parts, held = [], [], 0
    if parts:
        yield packed()


def features(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams and the piece that each belongs to; every n-gram holds a letter.

    Whatever isn't a letter counts as one kind of blank.
    """
    is_letter = letters()[codes]
    c = np.where(is_letter, codes, 32).astype(np.uint64)
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    h = np.zeros(len(c), np.uint64)
    some = np.zeros(len(c), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = (h[:m] + c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        some = some[:m] | is_letter[n - 1 :]
        if n in ORDERS:
            use = some & (piece[:m] == piece[n - 1 :])
            yield ((h[use] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 16)).astype(np.int64), piece[:m][use]


def ngram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows of docs; one row per language with bucket -1 counts its documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += langs.count(lang)
            texts = batch.column(0).to_pylist()
            for lang in set(langs):
                for _, codes, starts in pieces([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    for bucket, _ in features(codes, starts):
                        found[lang][:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, n in found.items():
            use = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(use), pa.string()), pa.array(np.where(use == BUCKETS, -1, use), pa.int64()), pa.array(n[use], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


#: Languages at most: the matrix that is broadcast has a column of 0.26 MB for each.
MOST_LANGUAGES = 512


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages by code point, log priors, log probabilities by bucket and language) from all rows with a language.

    More than MOST_LANGUAGES languages are refused with a ValueError, before anything of theirs reaches the driver.
    """
    learned = common.stored(ngram_counts(docs.filter(F.col(lang_col).isNotNull()), text_col, lang_col), "counts")
    if (found := learned.filter("bucket = -1").count()) > MOST_LANGUAGES:
        raise ValueError(f"{found} languages; a model holds {MOST_LANGUAGES} at most")
    counts = learned.toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + 1, len(langs)))
    np.add.at(n, (counts["bucket"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)), counts["n"].to_numpy())
    docs_of = n[-1]  # bucket -1
    grams = n[:-1] + SMOOTHING
    return langs, np.log(docs_of / max(1, docs_of.sum())) if langs else docs_of, (np.log(grams) - np.log(grams.sum(0))).astype(np.float32)


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (the posterior probability of the prediction) for each row of docs.

    A text that is null or has no letter gets `und` and 0.0, and so does every text if nothing was learned. Ties
    go to the language that is first by code point. An empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total, seen = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
            for rows, codes, starts in pieces(texts) if langs else ():
                rows = np.array(rows)
                for bucket, piece in features(codes, starts):
                    if not len(piece):
                        continue
                    at = np.flatnonzero(np.diff(piece, prepend=-1))
                    np.add.at(total, rows[piece[at]], np.add.reduceat(logp[bucket], at, axis=0, dtype=np.float64))
                    seen[rows[piece[at]]] = True
            if langs:
                total += prior
                best = total.argmax(1)
                sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            pred = [langs[best[i]] if seen[i] else UNKNOWN for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array([float(sure[i]) if seen[i] else 0.0 for i in range(len(texts))], pa.float64())], [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField(id_col, rows.schema[0].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(score, schema)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    pred = predict(spark, docs, model)
    return pred.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


