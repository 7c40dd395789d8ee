"""Removal of passages that recur across documents, by automata of repeated phrases.

Which phrases recur is confirmed as in `repeats`: a phrase that another document holds whole is known by its digest, and
phrases that share a flank may share windows. The texts of those go to the flank's bucket. There the windows that recur
are confirmed, compiled into Aho-Corasick automata, sharded by flank so that none grows beyond SHARD words of text, and
the phrases of all documents stream through the automaton of their shard, which locates every occurrence of every
window: one in a document of a greater id than the least that holds the window goes. A word is one character to an
automaton, numbered within the shard, so a window is a pattern of as many characters as it has words.

Streaming every document through every shard would cost the product of both; a document's phrases go to the shards of
their flanks alone, and no other shard can hold a window of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.repeats import Kind, Symbols, run
from tokensieve.llm.shingles import grams, mix, word_hashes
from tokensieve.llm.substring_dedup import covered

WINDOW, TRIGGER = 13, 5
#: Words of text behind an automaton, about; the phrases of one flank, at most repeats.HOT, stay together.
SHARD = 100_000


def _symbols(texts: list[bytes]) -> Symbols:
    lines = [b" ".join(t.split()) for t in texts]  # bytes split at 0x20 and 0x09-0x0D
    h, at, begin, end = word_hashes(lines, lower=False)
    return Symbols(h, b" ".join(lines), begin, end, at)


def shards(size: np.ndarray, flank: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Groups of runs with all runs of a flank, of about `most` symbols."""
    order = np.argsort(flank, kind="stable")
    held = np.cumsum(size[order]) // most
    held = held[np.searchsorted(flank[order], flank[order])]  # as the flank's first run
    yield from np.split(order, np.flatnonzero(np.diff(held)) + 1)


def confirmed(lines: list[str], ids: np.ndarray, window: int) -> dict[str, int]:
    """Windows that documents of different ids hold, and the least of those ids."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    windows = size - window + 1
    owner = np.repeat(np.arange(len(lines)), windows)
    x = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    h = grams(mix(flat), window)[np.repeat(np.cumsum(size) - size, windows) + x]
    _, group = np.unique(h, return_inverse=True)
    low, high = np.full(len(lines) and group.max() + 1, np.iinfo(np.int64).max), np.full(len(lines) and group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, ids[owner])
    np.maximum.at(high, group, ids[owner])
    use = np.flatnonzero((low < high)[group])
    out: dict[str, int] = {}
    for i, j, own in zip(owner[use].tolist(), x[use].tolist(), ids[owner[use]].tolist(), strict=True):
        text = lines[i][j : j + window]
        out[text] = min(out.get(text, own), own)
    return out


def compiled(passages: dict[str, int]) -> ahocorasick.Automaton:
    """An automaton that says of each passage it meets the least id that holds it."""
    automaton = ahocorasick.Automaton()
    for text, least in passages.items():
        automaton.add_word(text, least)
    automaton.make_automaton()
    return automaton


def spelled(texts: list[bytes]) -> list[str]:
    """The texts with a character for each word; the surrogates' code points are left out."""
    names: dict[bytes, int] = {}
    numbers = [[names.setdefault(w, len(names)) for w in t.split(b" ")] for t in texts]
    return ["".join([chr(i if i < 0xD800 else i + 0x800) for i in x]) for x in numbers]


def judge(window: int):
    """Whether each window of each run of words also stands in a document of a smaller id, by automata."""

    def of(texts: list[bytes], size: np.ndarray, ids: np.ndarray, start: np.ndarray, flank: np.ndarray) -> np.ndarray:
        base = np.cumsum(size - window + 1) - (size - window + 1)
        hit = np.zeros(int((size - window + 1).sum()), bool)
        for members in shards(size, flank, SHARD):
            lines, own = spelled([texts[i] for i in members.tolist()]), ids[members]
            passages = confirmed(lines, own, window)
            if not passages:
                continue
            automaton = compiled(passages)
            for line, i, at in zip(lines, own.tolist(), base[members].tolist(), strict=True):
                for last, least in automaton.iter(line):
                    if i > least:
                        hit[at + last - window + 1] = True
        return hit

    return of


def finisher(window: int, text: bool):
    def finish(texts: list[bytes], ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> pd.DataFrame:
        words = [t.split() for t in texts]
        at = np.cumsum([0, *map(len, words)])
        gone = covered(int(at[-1]), low, high, window)
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for i, w in enumerate(words):
            mask = gone[at[i] : at[i + 1]]
            n = int(np.count_nonzero(mask))
            kept = b" ".join([x for x, g in zip(w, mask.tolist(), strict=True) if not g] if n else w)
            out["n_words"].append(len(w))
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "surrogatepass"))
        if not text:
            del out["kept_text"]
        return pd.DataFrame(out)

    return finish


def passage_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, text: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256 and, if text, kept_text.

    Words are runs without white space, unchanged. Removed is every word in a window whose words, in their order, also
    start in a document of a smaller id; kept words are joined by one blank. A null text has no words; texts shorter
    than the window lose nothing. A null id is less than any other; rows with one id count as one document, whose
    windows don't repeat each other. An empty table gives an empty result. Other columns of docs are not read.
    """
    schema = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * text
    kind = Kind(window, min(TRIGGER, window), False, _symbols, judge(window), finisher(window, text))
    return run(spark, docs, id_col, text_col, kind, schema).withColumnRenamed("id", id_col)


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(spark, common.documents(spark, sf_dir)).select("doc_id", *(F.col(c) for c in ("n_words", "n_removed", "kept_sha256")))
