"""Words of whole texts as hashes, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_codes() -> np.ndarray:
    """A 64-bit code of each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, n at least."""
    if len(_powers["up"]) < n:
        size = -(-n >> 19) << 19
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, step, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about CHUNK bytes."""
    i = held = 0
    for j, t in enumerate(texts):
        held += len(t) + 1
        if held >= CHUNK:
            yield i, j + 1
            i, held = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


#: Words of more bytes than this get a digest instead of a hash in numpy.
LONG = 128


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offset of each text's words, start and end byte of each word in the texts joined by a blank).

    A word's hash takes 8 bytes at a time and finalises after each, so no structure of a word makes it collide.
    """
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    black = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(black, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    if lower:
        joined = joined.lower()  # bytes: A-Z alone
    h = blocks_hashed(joined, starts, ends - starts, LONG)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = int.from_bytes(blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, bounds), starts, ends


def blocks_hashed(data: bytes, starts: np.ndarray, sizes: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """A hash of the first `most` bytes, at most, of each run of data: one step of 8 bytes after another."""
    padded = data + bytes(8)
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix(sizes.astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    at = np.arange(len(starts))
    for k in range(0, most, 8):
        at = at[sizes[at] > k]
        if not len(at):
            break
        left = np.minimum(sizes[at] - k, 8).astype(np.uint64)
        h[at] = mix((h[at] ^ (eight[starts[at] + k] << ((np.uint64(8) - left) << np.uint64(3)))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive words; they take no notice of where texts end."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total = (total + h[j : len(h) - n + 1 + j]) * np.uint64(0xD6E8FEB86659FD93 + 2 * int(n))
    return mix(total)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of n words of each text, as 64-bit hashes; the whole sequence if it is shorter."""
    for i, j in chunks(texts):
        h, at, _, _ = word_hashes(texts[i:j], lower=True)
        g = grams(h, n)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if b - a >= n:
                s = np.sort(g[a : b - n + 1])
                yield s[np.flatnonzero(np.diff(s, prepend=s[:1] - np.uint64(1)))]
            else:
                yield grams(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)
