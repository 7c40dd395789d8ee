"""Finding every window that also occurs earlier in the corpus, without shuffling windows.

A text is a run of symbols (bytes or words). Within a window of N symbols the trigger is the K symbols with the least
rolling hash, the leftmost on ties: equal windows have equal triggers at equal places. Successive windows with one
trigger make a phrase, from the first window's start to the last one's end, so every window lies in exactly one
phrase, and phrases are some 2 / (N - K + 2) of the symbols. The windows of a phrase have two sides: those that hold at
least half of the other symbols left of the trigger, and the rest. All windows of a side share the trigger with the half
beside it, the side's flank; so equal windows are on the same side of phrases with one flank.

Texts are dealt into blocks of bounded size. Then

1. each block parses its texts and sends the digests and first places of its distinct phrases, and their flanks, to
   buckets by digest and by flank; what a block holds often it sends once;
2. a bucket finds each phrase's first place in the corpus (any other place repeats it whole), and the flanks that
   different phrases share: their sides are open. A flank that more than HOT phrases share is hot;
3. blocks send the symbols of open sides, the dictionary, to the flank's bucket; of hot ones they send digests of the
   windows, each distinct one once, to buckets by digest, so that a flank that very many phrases share lies in no one task;
4. a bucket finds the windows of its dictionary, or of its digests, that occur earlier, and tells the blocks;
5. each block joins all this to the windows of its texts.

Texts cross the network once: all steps of a block read one exchange. What differs is never taken for equal by a rolling
hash: those only choose triggers and flanks. Phrases and hot windows are equal by cryptographic digests of 96 bits of
all their bytes, windows of the dictionary by their symbols themselves.

A block sends a row to each bucket that it has something for, at most one for each of its phrases, however many buckets
there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.exact_dedup import with_locator
from tokensieve.llm.shingles import mix, powers

#: Bytes of text in a block and behind a bucket, about. Buckets are at least twice as many as shuffle partitions.
BLOCK, BUCKET = 2 << 20, 32 << 20
#: A flank that more phrases share is handled by digests of windows.
HOT = 512
_SEGMENT, _PLACE = 1 << 19, np.uint64((1 << 24) - 1)
NO_ID = -(1 << 63)  # what a null id counts as: less than any other

#: Rows between blocks and buckets: packed columns for one block and bucket.
PARCEL = "block int, bucket int, kind int, data binary"
TOLD, SYMBOLS, RUNS = 1, 2, 3
DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])


@dataclass
class Symbols:
    """The symbols of a block: a 64-bit code of each, all bytes, where each symbol begins and ends there, where texts start."""

    codes: np.ndarray
    data: bytes
    begin: np.ndarray | None  # None: symbols are bytes
    end: np.ndarray | None
    doc_at: np.ndarray

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[memoryview]:
        """The bytes of the runs of symbols [first, last)."""
        view = memoryview(self.data)
        a, b = (first, last) if self.begin is None else (self.begin[first], self.end[last - 1])
        return [view[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def digests(parts: list[memoryview]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(x, digest_size=DIGEST.itemsize).digest() for x in parts]), DIGEST)


def numbered(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct digest, of each digest the number of its content); numbers follow first places."""
    order = np.lexsort((np.arange(len(d)), d["b"], d["a"]))
    x = d[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = x[1:] != x[:-1]
    first = order[fresh]
    by = np.argsort(first)
    number = np.empty(len(first), np.int64)
    number[by] = np.arange(len(first))
    out = np.empty(len(d), np.int64)
    out[order] = number[np.cumsum(fresh) - 1]
    return first[by], out


class Routed:
    """Entries of a block by their bucket."""

    def __init__(self, to: np.ndarray):
        self.order = np.argsort(to, kind="stable")
        names, at = np.unique(to[self.order], return_index=True)
        ends = np.append(at[1:], len(to))[: len(at)]
        self.at = dict(zip(names.tolist(), zip(at.tolist(), ends.tolist(), strict=True), strict=True))

    def of(self, bucket: int) -> np.ndarray:
        a, b = self.at.get(bucket, (0, 0))
        return self.order[a:b]


@dataclass
class Parsed:
    """The phrases of a block; places count symbols from the block's start."""

    n: int  # N
    symbols: Symbols
    low: np.ndarray  # first window of each phrase
    high: np.ndarray  # last window
    first: np.ndarray  # by content number: the first phrase with the content
    number: np.ndarray  # of each phrase, the number of its content
    digest: np.ndarray  # by content number
    side_of: np.ndarray  # of each side of a distinct phrase: the content number
    side_low: np.ndarray  # first window of the side
    side_high: np.ndarray
    flank: np.ndarray  # its flank's hash
    contents: Routed = field(init=False)
    flanks: Routed = field(init=False)

    def route(self, buckets: int) -> None:
        self.contents = Routed((self.digest["a"] % np.uint64(buckets)).astype(np.int64))
        self.flanks = Routed(((self.flank >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.symbols.doc_at, place, side="right") - 1


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width successive values."""
    got, size = values, 1
    while size * 2 <= width:
        got = np.minimum(got[:-size], got[size:])
        size *= 2
    return np.minimum(got[: len(values) - width + 1], got[width - size : len(values) - size + 1]) if size < width else got


def parse(symbols: Symbols, n: int, k: int, buckets: int) -> Parsed:
    """The phrases of a block; symbols.codes are overwritten.

    What is kept for each symbol is a sum of 8 bytes and a place of 4; hashes are made segment by segment.
    """
    codes, doc_at = symbols.codes, symbols.doc_at
    size, w = len(codes), n - k + 1
    if size < n:
        none = np.zeros(0, np.int64)
        out = Parsed(n, symbols, none, none, none, none, np.zeros(0, DIGEST), none, none, none, none.astype(np.uint64))
        out.route(buckets)
        return out
    up, down = powers(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(np.multiply(codes, up[:size], out=codes), out=sums[1:])
    at = np.empty(size - n + 1, np.int32)
    for o in range(0, len(at), _SEGMENT):
        m = min(_SEGMENT, len(at) - o)
        grams = mix((sums[o + k : o + k + m + w - 1] - sums[o : o + m + w - 1]) * down[o : o + m + w - 1])
        keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        at[o : o + m] = (window_minimum(keyed, w) & _PLACE).astype(np.int32) + o
    lengths = np.diff(doc_at)
    fit = lengths >= n
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, doc_at[:-1][fit], 1)
    np.add.at(steps, (doc_at[1:] - n + 1)[fit], -1)
    whole = np.cumsum(steps, dtype=np.int32)[: len(at)] > 0
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
    low = np.flatnonzero(new)
    last = whole.copy()
    last[:-1] &= new[1:] | ~whole[1:]
    high = np.flatnonzero(last)
    t = at[low].astype(np.int64)
    digest = digests(symbols.cut(low, high + n))
    first, number = numbered(digest)
    lo, hi, t = low[first], high[first], t[first]
    half = (n - k + 1) // 2
    left, right = np.flatnonzero(lo <= t - half), np.flatnonzero(hi > t - half)

    def flank(start: np.ndarray, side: int) -> np.ndarray:
        return mix(mix((sums[start + k + half] - sums[start]) * down[start]) + np.uint64(side))

    sides = (np.concatenate(x) for x in ((left, right), (lo[left], np.maximum(lo[right], t[right] - half + 1)), (np.minimum(hi[left], t[left] - half), hi[right]), (flank(t[left] - half, 0), flank(t[right], 1))))
    out = Parsed(n, symbols, low, high, first, number, digest[first], *sides)
    out.route(buckets)
    return out


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def packed_ids(ids: np.ndarray) -> np.ndarray:
    """4 bytes for each id where they fit."""
    return ids.astype("<u4") if len(ids) and ids.min() >= 0 and ids.max() < 1 << 32 else ids.astype("<i8")


class Reader:
    """Columns of a parcel, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, dtype, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype, n, self.at)
        self.at += out.nbytes
        return out

    def ids(self, n: int, wide: int) -> np.ndarray:
        return self.take("<i8" if wide else "<u4", n).astype(np.int64)


REPEATED, OPEN, VERY_OPEN = 1, 1, 2


def places(p: Parsed, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of the text, place in the text) of windows."""
    doc = p.doc(low)
    return ids[doc], low - p.symbols.doc_at[doc]


def sent(p: Parsed, ids: np.ndarray, within: bool) -> Iterator[tuple[int, bytes]]:
    """Step 1: a parcel for each bucket: counts, phrases (digest, id and, within, place), flanks (hash, phrase, how many)."""
    own, start = places(p, p.low[p.first], ids)
    # a flank that several phrases of the block share is sent once, with their number
    order = np.lexsort((p.side_of, p.flank))
    fresh = np.ones(len(order), bool)
    fresh[1:] = p.flank[order][1:] != p.flank[order][:-1]
    many = np.zeros(len(order), np.uint32)
    heads = np.flatnonzero(fresh)
    many[order[heads]] = np.diff([*heads, len(order)])
    for b in p.contents.at.keys() | p.flanks.at.keys():
        c, f = p.contents.of(b), p.flanks.of(b)
        f = f[many[f] > 0]
        who = p.digest["a"][p.side_of[f]]
        d, i = p.digest[c], packed_ids(own[c])
        yield b, pack(
            np.array([len(c), len(f), i.itemsize == 8], "<u4"), d["a"], d["b"], i, start[c].astype("<u4") if within else np.zeros(0, "<u4"),
            p.flank[f].astype("<u4"), (who >> np.uint64(32)).astype("<u4"), (who & np.uint64(0xFFFF)).astype("<u2"), many[f],
        )


def leaders(d: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, leader): entries by content and place, and for each, in that order, where its content's first one stands."""
    order = np.lexsort((start, ids, d["b"], d["a"]))
    x = d[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = x[1:] != x[:-1]
    return order, np.flatnonzero(fresh)[np.cumsum(fresh) - 1]


def told(parcels: list[bytes], within: bool, hot: int) -> list[bytes]:
    """Step 2: an answer to each parcel: which phrases repeat, the state of each flank."""
    columns, sizes = [], []
    for data in parcels:
        r = Reader(data)
        c, f, wide = r.take("<u4", 3).tolist()
        d = np.empty(c, DIGEST)
        d["a"], d["b"] = r.take("<u8", c), r.take("<u4", c)
        columns.append((d, r.ids(c, wide), r.take("<u4", c if within else 0), r.take("<u4", f), r.take("<u4", f), r.take("<u2", f), r.take("<u4", f)))
        sizes.append((c, f))
    d, ids, start, flank, who, more, many = (np.concatenate(x) for x in zip(*columns, strict=True))
    order, leader = leaders(d, ids, start if within else ids)
    repeated = np.zeros(len(d), bool)
    repeated[order] = leader != np.arange(len(d)) if within else ids[order] > ids[order][leader]
    _, group = np.unique(flank, return_inverse=True)
    total = np.bincount(group, many)
    names = (who.astype(np.uint64) << np.uint64(16)) | more
    low, high = np.full(len(total), np.iinfo(np.uint64).max), np.zeros(len(total), np.uint64)
    np.minimum.at(low, group, names)
    np.maximum.at(high, group, names)
    several = np.zeros(len(total), bool)
    np.logical_or.at(several, group, many > 1)
    state = np.where(several | (low != high), np.where(total > hot, VERY_OPEN, OPEN), 0).astype("<u1")[group]
    out, i, j = [], 0, 0
    for c, f in sizes:
        which, shared = np.flatnonzero(repeated[i : i + c]), np.flatnonzero(state[j : j + f])
        out.append(pack(np.array([len(which), len(shared)], "<u4"), which.astype("<u4"), shared.astype("<u4"), state[j : j + f][shared]) if len(which) or len(shared) else b"")
        i, j = i + c, j + f
    return out


def states(p: Parsed, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(whether each content repeats, the state of each side; 0 for those of contents that repeat)."""
    repeated, by_flank = np.zeros(len(p.first), bool), {}
    order = np.argsort(p.flank, kind="stable")
    state = np.zeros(len(p.flank), np.uint8)
    for b, data in answers.items():
        r = Reader(data)
        c, f = r.take("<u4", 2).tolist()
        repeated[p.contents.of(b)[r.take("<u4", c)]] = True
        by_flank[b] = (r.take("<u4", f), r.take("<u1", f))
    heads = np.ones(len(order), bool)
    heads[1:] = p.flank[order][1:] != p.flank[order][:-1]
    is_head = np.zeros(len(order), bool)
    lead = np.lexsort((p.side_of, p.flank))
    is_head[lead[heads]] = True
    for b, (which, s) in by_flank.items():
        f = p.flanks.of(b)
        state[f[is_head[f]][which]] = s
    # all sides of one flank have its state
    state[lead] = state[lead][np.flatnonzero(heads)[np.cumsum(heads) - 1]] if len(lead) else state
    state[repeated[p.side_of]] = 0
    return repeated, state


def hot_windows(p: Parsed, state: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(side, window, number of the window's content, first window of each content) of all windows of hot sides."""
    side = np.flatnonzero(state == VERY_OPEN)
    count = p.side_high[side] - p.side_low[side] + 1
    owner = np.repeat(side, count)
    window = np.repeat(p.side_low[side] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    by = np.argsort(window, kind="stable")  # in the order of places, so that the first one of a content leads
    owner, window = owner[by], window[by]
    d = digests(p.symbols.cut(window, window + p.n))
    first, number = numbered(d)
    return owner, window, number, first


def opened(p: Parsed, answers: dict[int, bytes], ids: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Step 3: a parcel for each bucket: symbols of open sides, and digests of windows of hot ones."""
    _, state = states(p, answers)
    open_ = np.flatnonzero(state == OPEN)
    own, start = places(p, p.side_low[open_], ids)
    size = p.side_high[open_] - p.side_low[open_] + p.n
    parts = p.symbols.cut(p.side_low[open_], p.side_low[open_] + size)
    to = Routed(((p.flank[open_] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    _, window, _, first = hot_windows(p, state, ids)
    window = window[first]
    hot = digests(p.symbols.cut(window, window + p.n))
    hot_own, hot_start = places(p, window, ids)
    hot_to = Routed((hot["a"] % np.uint64(buckets)).astype(np.int64))
    for b in to.at.keys() | hot_to.at.keys():
        x, y = to.of(b), hot_to.of(b)
        data = [parts[i] for i in x.tolist()]
        yield b, pack(
            np.array([len(x), len(y)], "<u4"), open_[x].astype("<u4"), p.flank[open_[x]].astype("<u4"), size[x].astype("<u4"), own[x].astype("<i8"), start[x].astype("<u4"),
            np.array([len(v) for v in data], "<u4"), y.astype("<u4"), hot["a"][y], hot["b"][y], hot_own[y].astype("<i8"), hot_start[y].astype("<u4"),
        ) + b"".join(data)


def ranks(symbols: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Equal numbers for equal windows of n symbols at the places at: the order of a suffix array cut off at n.

    Prefix doubling: the rank of 2m symbols at a place is that of the pair of ranks of m symbols there and m further.
    """
    if symbols.dtype == np.uint8:
        padded = np.concatenate((symbols, np.zeros(8, np.uint8))).astype(np.uint64)
        word = np.zeros(len(symbols), np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | padded[i : i + len(symbols)]
        have = 8
    else:
        word, have = symbols, 1
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    del word
    while have * 2 <= n:
        nxt = np.concatenate((rank[have:], np.zeros(min(have, len(rank)), np.uint64)))
        rank = np.unique((rank << np.uint64(32)) | nxt, return_inverse=True)[1].astype(np.uint64)
        have *= 2
    pair = (rank[at] << np.uint64(32)) | rank[at + n - have]
    return np.unique(pair, return_inverse=True)[1]


#: Step 4's judgement: (bytes of each run of symbols, symbols in each, ids, places in the texts, flanks) -> for each window of
#: each run, whether it occurs earlier.
Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def earlier(parcels: list[bytes], n: int, within: bool, judge: Judge) -> list[bytes]:
    """Step 4: for each parcel the runs of windows that occur earlier, and which hot windows do."""
    columns, sizes, texts = [], [], []
    for data in parcels:
        r = Reader(data)
        x, y = r.take("<u4", 2).tolist()
        columns.append((*(r.take(t, x) for t in ("<u4", "<u4", "<u4", "<i8", "<u4", "<u4")), *(r.take(t, y) for t in ("<u4", "<u8", "<u4", "<i8", "<u4"))))
        at = r.at
        for length in columns[-1][5].tolist():
            texts.append(data[at : at + length])
            at += length
        sizes.append((x, y))
    which, flank, size, ids, start, _, hot, a, b, hot_ids, hot_start = (np.concatenate(c) for c in zip(*columns, strict=True))
    windows = size.astype(np.int64) - n + 1
    owner = np.repeat(np.arange(len(size)), windows)
    x = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = judge(texts, size.astype(np.int64), ids, start.astype(np.int64), flank) if len(size) else np.zeros(0, bool)
    # runs of successive windows of one side
    begin = hit.copy()
    begin[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    end = hit.copy()
    end[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    d = np.empty(len(a), DIGEST)
    d["a"], d["b"] = a, b
    order, leader = leaders(d, hot_ids, hot_start)
    again = np.zeros(len(d), bool)
    again[order] = leader != np.arange(len(d)) if within else hot_ids[order] > hot_ids[order][leader]
    out, i, j = [], 0, 0
    for n_x, n_y in sizes:
        own = slice(*np.searchsorted(owner[first], [i, i + n_x]))
        hits = hot[j : j + n_y][again[j : j + n_y]]
        f, l = first[own], last[own]
        out.append(pack(np.array([len(f), len(hits)], "<u4"), which[owner[f]].astype("<u4"), x[f].astype("<u4"), x[l].astype("<u4"), hits.astype("<u4")) if len(f) or len(hits) else b"")
        i, j = i + n_x, j + n_y
    return out


def repeated_windows(p: Parsed, answers: dict[int, bytes], runs: dict[int, bytes], ids: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Step 5: first and last window, counted from the block's start, of the runs of windows that occur earlier."""
    repeated, state = states(p, answers)
    number, here = p.number, np.arange(len(p.number))
    own = ids[p.doc(p.low)]
    later = here != p.first[number] if within else own > own[p.first[number]]
    all_of = later | repeated[number]
    found = []  # (content number, first and last window, from the phrase's start)
    for data in runs.values():
        r = Reader(data)
        f, h = r.take("<u4", 2).tolist()
        side, a, b = (r.take("<u4", f).astype(np.int64) for _ in range(3))
        base = p.side_low[side] - p.low[p.first[p.side_of[side]]]
        found.append((p.side_of[side], base + a, base + b))
    side, window, content, first = hot_windows(p, state, ids)
    if len(window):
        elsewhere = np.zeros(len(first), bool)
        for data in runs.values():
            r = Reader(data)
            f, h = r.take("<u4", 2).tolist()
            r.take("<u4", 3 * f)
            elsewhere[r.take("<u4", h)] = True
        own_hot = places(p, window, ids)[0]
        here_too = np.arange(len(window)) != first[content] if within else own_hot > own_hot[first[content]]
        hit = elsewhere[content] | here_too
        of = p.side_of[side[hit]]
        at = window[hit] - p.low[p.first[of]]
        found.append((of, at, at))
    lows, highs = [p.low[all_of]], [p.high[all_of]]
    if found:
        of, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(of, kind="stable")
        of, lo, hi = of[order], lo[order], hi[order]
        rest = here[~all_of]
        a, b = np.searchsorted(of, number[rest]), np.searchsorted(of, number[rest], side="right")
        phrase = np.repeat(rest, b - a)
        pick = np.arange(len(phrase)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        lows.append(p.low[phrase] + lo[pick])
        highs.append(p.low[phrase] + hi[pick])
    low, high = np.concatenate(lows), np.concatenate(highs)
    order = np.argsort(low, kind="stable")
    return low[order], high[order]


@dataclass
class Kind:
    """What symbols are, and what counts as earlier."""

    n: int
    k: int
    within: bool  # whether a place in the same text counts as earlier
    symbols: Callable[[list[bytes]], Symbols]
    judge: Judge
    finish: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]  # texts, ids, runs of windows -> result


def dealt(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(block, id, data) and the number of buckets; data is the text as UTF-8. Rows are dealt by their place in storage."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = with_locator(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("data")))
    total = rows.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    buckets = max(2 * common.partitions(spark), math.ceil(total / BUCKET))
    return rows.select(F.pmod(F.xxhash64("_place"), F.lit(blocks)).cast("int").alias("block"), "id", "data"), buckets


def run(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, kind: Kind, schema: str) -> DataFrame:
    """The rows that kind.finish makes of all blocks."""
    (rows, buckets), hot = dealt(spark, docs, id_col, text_col), HOT

    def block_of(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray, Parsed]:
        texts = [bytes(t) for t in pdf["data"]]
        ids = pdf["id"].astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64)
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        texts, ids = [texts[i] for i in order], ids[order]
        return texts, ids, parse(kind.symbols(texts), kind.n, kind.k, buckets)

    def parcels(block: int, rows: Iterator[tuple[int, bytes]], what: int) -> pd.DataFrame:
        rows = list(rows)
        return pd.DataFrame({"block": [block] * len(rows), "bucket": [b for b, _ in rows], "kind": [what] * len(rows), "data": [d for _, d in rows]})

    def step1(pdf: pd.DataFrame) -> pd.DataFrame:
        _, ids, p = block_of(pdf)
        return parcels(int(pdf["block"].iloc[0]), sent(p, ids, kind.within), 0)

    def answered(pdf: pd.DataFrame, answers: list[bytes], what: int) -> pd.DataFrame:
        out = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "kind": what, "data": answers})
        return out[out["data"].map(len) > 0]

    def step2(pdf: pd.DataFrame) -> pd.DataFrame:
        return answered(pdf, told(pdf["data"].tolist(), kind.within, hot), TOLD)

    def step3(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return parcels(0, iter(()), SYMBOLS)
        _, ids, p = block_of(left)
        return parcels(int(left["block"].iloc[0]), opened(p, dict(zip(right["bucket"], right["data"], strict=True)), ids, buckets), SYMBOLS)

    def step4(pdf: pd.DataFrame) -> pd.DataFrame:
        return answered(pdf, earlier(pdf["data"].tolist(), kind.n, kind.within, kind.judge), RUNS)

    def step5(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts, ids, p = block_of(left)
        by = {what: dict(zip(x["bucket"], x["data"], strict=True)) for what, x in right.groupby("kind")}
        low, high = repeated_windows(p, by.get(TOLD, {}), by.get(RUNS, {}), ids, kind.within)
        out = kind.finish(texts, ids, low, high)
        out["id"] = pd.array([None if i == NO_ID else i for i in ids], "Int64")
        return out

    answers = rows.groupBy("block").applyInPandas(step1, PARCEL).groupBy("bucket").applyInPandas(step2, PARCEL)
    answers = answers.repartition(common.partitions(spark), "block")
    open_ = rows.groupBy("block").cogroup(_anew(answers).groupBy("block")).applyInPandas(step3, PARCEL)
    runs = open_.groupBy("bucket").applyInPandas(step4, PARCEL)
    everything = _anew(answers).unionByName(runs)
    return _anew(rows).groupBy("block").cogroup(everything.groupBy("block")).applyInPandas(step5, f"id long, {schema}")


def _anew(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own, so that a cogroup can tell its sides apart."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
