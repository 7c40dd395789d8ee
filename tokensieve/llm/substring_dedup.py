"""Byte-level substring deduplication by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases (see `repeats`); the parse is the sequence of distinct phrases, each
with its first place in corpus order. Phrases that occur again repeat whole. For phrases that share a trigger but
differ, the dictionary of their bytes is sorted as a suffix array, cut off at the window's length, and combined with
the places of the parse into corpus order: windows of one rank repeat the first of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.repeats import Kind, Symbols, ranks, run
from tokensieve.llm.shingles import byte_codes

WINDOW, TRIGGER = 100, 16


def _symbols(texts: list[bytes]) -> Symbols:
    data = b"".join(texts)
    return Symbols(byte_codes()[np.frombuffer(data, np.uint8)], data, None, None, np.cumsum([0, *map(len, texts)]))


def judge(window: int):
    """Windows of one rank in the sorted dictionary, in the order of the corpus: all but the first occur earlier."""

    def of(texts: list[bytes], size: np.ndarray, ids: np.ndarray, start: np.ndarray, flank: np.ndarray) -> np.ndarray:
        windows = size - window + 1
        owner = np.repeat(np.arange(len(size)), windows)
        x = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        rank = ranks(np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.cumsum(size) - size, windows) + x, window)
        place = start[owner] + x
        order = np.lexsort((place, ids[owner], rank))
        same = np.zeros(len(order), bool)
        same[1:] = rank[order][1:] == rank[order][:-1]
        hit = np.zeros(len(order), bool)
        hit[order] = same
        return hit

    return of




def covered(size: int, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Which of size symbols lie in a window that starts in one of the runs [low, high]."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, low, 1)
    np.add.at(steps, high + width, -1)
    return np.cumsum(steps[:-1]) > 0


def finisher(window: int, text: bool):
    """text: return the remaining text as well."""

    def finish(texts: list[bytes], ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
        at = np.cumsum([0, *map(len, texts)])
        gone = covered(int(at[-1]), low, high, window)
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
        for i, t in enumerate(texts):
            mask = gone[at[i] : at[i + 1]]
            n = int(np.count_nonzero(mask))
            rest = np.frombuffer(t, np.uint8)[~mask].tobytes() if n else t
            out["n_bytes"].append(len(t))
            out["n_removed"].append(n)
            out["n_spans"].append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(len(mask) and mask[0])) if n else 0)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept_text"].append(rest)
        if not text:
            del out["kept_text"]
        return pd.DataFrame(out)

    return finish


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, text: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256 and, if text, kept_text (binary).

    Removed is every byte in a window that also starts earlier: in a smaller id, or in the same text further left. A
    null text is empty; texts shorter than the window lose nothing. A null id is less than any other; rows with one
    id count as one document, in which a window is earlier if it starts further left. An empty table gives an empty
    result. Other columns of docs are not read. Cuts follow bytes, so kept_text need not be valid UTF-8.
    """
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * text
    kind = Kind(window, min(TRIGGER, max(1, window // 4)), True, _symbols, judge(window), finisher(window, text))
    return run(spark, docs, id_col, text_col, kind, schema).withColumnRenamed("id", id_col)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, common.documents(spark, sf_dir)).select("doc_id", *(F.col(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))
