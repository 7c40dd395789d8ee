"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is spaced as the model wants it (a leading blank, blanks as U+2581) and cut into units that no merge can
cross. Inside a unit the best pair (highest score, then leftmost) merges first, again and again. With dropout, a
candidate merge is skipped when a hash keyed by seed, document, the unit's place in it, unit and the candidate's place
is below the rate: the same key always gives the same segmentation, another seed, document, copy of a document or
place gives another one, and all of them decode to the same text.

Merges are remembered as a tree of states for each unit. The root is the merge without dropout, with the candidates
that it met. If the key skips none of them, the unit is what the state says. Otherwise the skipped ones lead to a child,
the merge that skips just these, with the candidates that it met besides; and so on, until the key skips nothing new.
That gives each occurrence exactly what its own key gives, with a few look-ups. What is met for the first time is merged
together, one step of the agenda at a time for all units of a batch, as columns in numpy, with one look at the table of
pairs for what stands before and after each merge. Long units go through a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tokensieve.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
#: Units up to this many characters are merged as columns; repeated ones are remembered. From CACHED states on the
#: memory is emptied before the next batch, which adds at most a state for each of its units.
SHORT, CACHED, ONCE = 64, 100_000, 1 << 21
#: A state with more candidates than this has no children: bits of a word name the skipped ones.
CHOICES = 63
#: Units whose candidates are hashed at once; words that are compared at once; places of a table of units that merge together.
HASHED, COMPARED, MERGED = 1 << 15, 1 << 19, 1 << 18
#: Units: blanks with the word after them, or runs of line feeds, or blanks alone. The model has no piece that joins a line feed to anything.
UNIT = re.compile(r" *[^ \n]+|\n+| +")  # what unit_starts() finds
BLANK = "▁"
NEVER = np.iinfo(np.int32).max
M64 = (1 << 64) - 1


def mix(x):
    """Finalise 64 bits; ints or arrays of uint64."""
    if isinstance(x, int):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
        return x ^ (x >> 31)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a model, as the merge loop needs them. Built from (piece, score, is it a byte) by id."""

    def __init__(self, rows: list[tuple[str, float, bool]], special: int = 3):
        self.texts = [p for p, _, _ in rows]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, b) in enumerate(rows) if b}
        self.ids = {p: i for i, (p, _, b) in enumerate(rows) if not b and i >= special}
        scores = np.array([s for _, s, _ in rows])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores rank alike
        self.raw = [bytes([int(p[3:5], 16)]) if b else p.replace(BLANK, " ").encode() if i >= special else b"" for i, (p, _, b) in enumerate(rows)]
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.code = np.full(0x110000, -1, np.int32)  # by code point; blanks are U+2581, a real U+2581 is no piece
        for p, i in self.ids.items():
            if len(p) == 1 and p != BLANK:
                self.code[ord(p)] = i
        self.code[ord(" ")] = self.ids.get(BLANK, -1)
        self.size = len(rows)
        # pairs in one table: that of (a, b) stands at first[a] + b, where no other left piece owns the place
        order = sorted(pairs)
        lefts, begin, many = np.unique(np.array([a for a, _, _ in order], np.int64), return_index=True, return_counts=True)
        rights, made = np.array([b for _, b, _ in order], np.int64), np.array([i for _, _, i in order], np.int32)
        self.first = np.full(self.size + 2, 2, np.int64)  # ids below 0 take the last two, which lead to places without an owner of theirs
        room, rng = self.size + 2 + 4 * len(order), np.random.default_rng(0)  # starts of rows end there
        self.owner, self.merged = np.full(room + self.size, -3, np.int32), np.full(room + self.size, -1, np.int32)
        for k in np.argsort(-many, kind="stable").tolist():  # the fullest first, each where chance has it fit
            own, to = rights[begin[k] : begin[k] + many[k]], len(self.owner)
            for _ in range(50):
                tries = rng.integers(self.size + 2, room, max(4, min(32, 4096 // len(own))))
                fits = np.flatnonzero((self.owner[tries[:, None] + own] < 0).all(1))
                if len(fits):
                    to = int(tries[fits[0]])
                    break
            else:  # beyond all others
                self.owner, self.merged = (np.concatenate((x, np.full(self.size, x[0]))) for x in (self.owner, self.merged))
            self.first[lefts[k]] = to
            self.owner[to + own], self.merged[to + own] = lefts[k], made[begin[k] : begin[k] + many[k]]

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([(sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i)) for i in range(sp.get_piece_size())])

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs of pieces make a piece, the pieces that those make). Ids below 0 are no pieces."""
        at = self.first[left] + right
        some = np.flatnonzero(self.owner[at] == left)
        return some, self.merged[at[some]]

    def joined(self, left: int, right: int) -> int:
        """The piece that two pieces make, or -1. Ids below 0 are no pieces."""
        at = self.first.item(left) + right
        return self.merged.item(at) if self.owner.item(at) == left else -1

    def spell(self, symbol: str) -> list[int]:
        """Byte pieces of a character that is no piece."""
        return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]


_CODES = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = mix(np.arange(1, 2 * SHORT + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).reshape(2, SHORT) | np.uint64(1)


def unit_starts(codes: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where the units of texts start, that are joined as code points."""
    feed, blank = codes == 10, codes == 32
    start = np.empty(len(codes), bool)
    start[1:] = (feed[1:] != feed[:-1]) | (blank[1:] & ~blank[:-1])
    start[text_at] = True
    return np.flatnonzero(start)


def unit_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each unit: its characters' codes times the multipliers of their places, summed up and mixed."""
    out = np.empty((2, len(starts)), np.uint64)
    for at in range(0, len(starts), HASHED):
        a, n = starts[at : at + HASHED], sizes[at : at + HASHED]
        part = codes[a[0] : a[-1] + n[-1]]
        place = (np.arange(len(part)) - np.repeat(a - a[0], n)) % SHORT
        code = _CODES[part]
        for k in range(2):
            out[k, at : at + HASHED] = np.add.reduceat(code * _PLACES[k][place], a - a[0]) + n.astype(np.uint64)
        for i in np.flatnonzero(n > SHORT).tolist():
            out[:, at + i] = xxhash.xxh64_intdigest(codes[a[i] : a[i] + n[i]].tobytes())
    return mix(out[0] + np.uint64(seed * 0xD6E8FEB86659FD93 & M64)), mix(out[1])


def unit_keys(units: list[str], seed: int) -> np.ndarray:
    """The first hash of each unit."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    return unit_hashes(codes, np.cumsum(sizes) - sizes, sizes, seed)[0] if units else np.zeros(0, np.uint64)


_PLACE = tuple(np.array([c], np.uint64).view(np.int64)[0] for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def place_of(start, middle, end):
    """Names the candidate that joins [start, middle) and [middle, end) of a unit; ints or arrays of int64."""
    if isinstance(start, int):
        return (start * 0x9E3779B97F4A7C15 + middle * 0xC2B2AE3D27D4EB4F + end * 0x165667B19E3779F9) & M64
    return (start * _PLACE[0] + middle * _PLACE[1] + end * _PLACE[2]).view(np.uint64)


def dropped(key, place, limit: int):
    """Whether the key skips the candidate. limit: the rate times 2**64."""
    if isinstance(key, int):
        return mix((key + place) & M64) < limit
    return mix(key + place) < np.uint64(min(limit, M64))


def characters(pieces: Pieces, unit: str) -> list[int]:
    """The pieces of a unit's characters, -1 where there is none."""
    return [int(pieces.code[ord(c)]) for c in unit]


def merge_one(pieces: Pieces, unit: str, skips: Callable[[int], bool], met: list[int] | None = None) -> list[int]:
    """The ids of a unit, by a heap of candidates, those left out that skips says. met gets the place of each candidate."""
    ids = characters(pieces, unit)
    n = len(ids)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a < 0 or b >= n or (m := pieces.joined(ids[a], ids[b])) < 0:
            return
        place = place_of(a, end[a], end[b])
        if met is not None:
            met.append(place)
        if not skips(place):
            heapq.heappush(heap, (int(pieces.rank[m]), a, end[a], end[b], m))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, middle, to, m = heapq.heappop(heap)
        b = middle
        if not alive[a] or end[a] != middle or b >= n or not alive[b] or end[b] != to:
            continue
        ids[a], end[a], alive[b] = m, to, False
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    out: list[int] = []
    for i in range(n):
        if alive[i]:
            out += [ids[i]] if ids[i] >= 0 else pieces.spell(unit[i])
    return out


def merge_keyed(pieces: Pieces, unit: str, key: int, limit: int) -> list[int]:
    """merge_one with the candidates skipped that the key skips."""
    return merge_one(pieces, unit, lambda place: dropped(key, place, limit))


#: skips(numbers of units, places) -> which candidates are left out.
Skips = Callable[[np.ndarray, np.ndarray], np.ndarray]


def merge_many(pieces: Pieces, units: list[str], skips: Skips) -> list[bytes]:
    """merge_one for many short units at once; little-endian uint32 ids of each."""
    if not units:
        return []
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids, n = merge_codes(pieces, codes, np.cumsum(sizes) - sizes, sizes, skips)
    ends = np.cumsum(n).tolist()
    return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def merge_codes(pieces: Pieces, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skips: Skips, met: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """merge_one for many short units at once, runs of code points; (ids of one after another, how many of each). met gets (numbers of units, places)."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ids = pieces.code[codes]
    lacking = np.cumsum(np.concatenate(([0], ids < 0)))
    odd = lacking[starts + sizes] > lacking[starts]
    numbers, flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(odd).tolist():  # characters without a piece
        places: list[int] = []
        unit = "".join(map(chr, codes[starts[i] : starts[i] + sizes[i]].tolist()))
        found = merge_one(pieces, unit, lambda place, i=i: bool(skips(np.array([i]), np.array([place], np.uint64))[0]), places)
        numbers.append(np.array([i]))
        flat.append(np.array(found, np.uint32))
        counts.append(np.array([len(found)]))
        if met is not None:
            met.append((np.full(len(places), i), np.array(places, np.uint64)))
    low = 0
    for width in (4, 6, 8, 10, 12, 16, 24, 32, SHORT):
        members = np.flatnonzero((sizes > low) & (sizes <= width) & ~odd)
        low = width
        most = min(1 << 14, MERGED // width)
        for at in range(0, len(members), most):
            rows = members[at : at + most]
            done = _merge_block(pieces, ids, starts[rows], sizes[rows], rows, skips, met, width)
            numbers.append(rows)
            flat.append(done[done >= 0].astype(np.uint32))
            counts.append((done >= 0).sum(1))
    order, n = np.argsort(np.concatenate(numbers)), np.concatenate(counts)
    begin = np.cumsum(n) - n
    return runs_of(np.concatenate(flat), begin[order], n[order]), n[order]


def _merge_block(pieces: Pieces, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, skips: Skips, met: list | None, width: int) -> np.ndarray:
    """Rows of ids, -2 between and after them, of units that are runs of flat.

    A piece stands where its first character does; end says where the next one stands, before where the last one does.
    Tables are rows of width + 1 places, addressed by row * (width + 1) + place.
    """
    n, wide = len(starts), width + 1
    cols = np.arange(wide)
    inside = cols < sizes[:, None]
    ids = np.where(inside, flat[np.minimum(starts[:, None] + cols, len(flat) - 1)], -2).astype(np.int32).ravel()
    end = np.tile(cols + 1, n)
    before = np.tile(cols - 1, n)
    joined, rank = np.full(n * wide, -1, np.int32), np.full(n * wide, NEVER, np.int32)

    def offer(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Set joined and rank of the pieces at a, each with the piece at b after it."""
        base = row * wide
        at, to = base + a, base + b
        some, new = pieces.join(ids[at], ids[to])
        place, number = place_of(a[some], b[some], end[to[some]]), numbers[row[some]]
        if met is not None:
            met.append((number, place))
        rank[at] = NEVER
        go = ~skips(number, place)
        at, new = at[some[go]], new[go]
        joined[at], rank[at] = new, pieces.rank[new]

    row, first = np.nonzero(inside[:, 1:])
    offer(row, first, first + 1)
    table, row = rank.reshape(n, wide), np.arange(n)
    while len(row):
        a = table[row].argmin(1)
        go = rank[row * wide + a] != NEVER
        row, a = row[go], a[go]
        base = row * wide
        at = base + a
        b = end[at]
        ids[at] = joined[at]
        end[at] = c = end[base + b]
        ids[base + b], rank[base + b] = -2, NEVER
        more = c < sizes[row]
        rank[at[~more]] = NEVER
        before[(base + c)[more]] = a[more]
        left = before[at]
        some = left >= 0
        offer(np.concatenate((row[more], row[some])), np.concatenate((a[more], left[some])), np.concatenate((c[more], a[some])))
    return ids.reshape(n, wide)


def runs_of(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of flat, one after another."""
    return flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def appended(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of a with that of b after it, and how long they are."""
    n = na + nb
    second = np.repeat(np.tile([False, True], len(n)), np.stack((na, nb), 1).ravel())
    out = np.empty(len(second), a.dtype)
    out[~second], out[second] = a, b
    return out, n


def padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of each run as a matrix, 0 (which names no candidate) to fill."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def among(table: np.ndarray, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place stands in the row of table that numbers names; so many at once that COMPARED words are compared."""
    out, most = np.zeros(len(numbers), bool), max(1, COMPARED // max(1, table.shape[1]))
    for at in range(0, len(numbers), most):
        out[at : at + most] = (table[numbers[at : at + most]] == places[at : at + most, None]).any(1)
    return out


class Table:
    """Numbers by pairs of 64 bits, for many at once: open addressing in arrays that hold at most half of what they could."""

    def __init__(self, bits: int = 16):
        self.a, self.b = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int64)
        self.mask, self.size = np.uint64((1 << bits) - 1), 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        out = np.full(len(a), -1, np.int64)
        todo, at = np.arange(len(a)), (a & self.mask).astype(np.int64)
        while len(todo):
            value = self.value[at]
            hit = (self.a[at] == a[todo]) & (self.b[at] == b[todo]) & (value >= 0)
            out[todo[hit]] = value[hit]
            go = ~hit & (value >= 0)
            todo, at = todo[go], (at[go] + 1) & int(self.mask)
        return out

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        """Pairs that aren't there yet, all different."""
        if 2 * (self.size + len(a)) > len(self.value):
            old, used = self, self.value >= 0
            bits = (2 * (self.size + len(a))).bit_length() + 1
            a, b, value = (np.concatenate((x[used], y)) for x, y in ((old.a, a), (old.b, b), (old.value, value)))
            self.__init__(bits)
        self.size += len(a)
        todo, at = np.arange(len(a)), (a & self.mask).astype(np.int64)
        while len(todo):
            free = self.value[at] < 0
            self.value[at[free]] = value[todo[free]]  # of several at one place the last one stays
            won = free & (self.value[at] == value[todo])
            self.a[at[won]], self.b[at[won]] = a[todo[won]], b[todo[won]]
            todo, at = todo[~won], at[~won]
            at = np.where(self.value[at] >= 0, (at + 1) & int(self.mask), at)


class Runs:
    """Runs of numbers, one after another."""

    def __init__(self, dtype):
        self.flat, self.ends = np.zeros(1 << 12, dtype), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        last = int(self.ends[-1])
        if last + len(values) > len(self.flat):
            self.flat = np.concatenate((self.flat[:last], np.zeros(last + len(values), self.flat.dtype)))
        self.flat[last : last + len(values)] = values
        self.ends = np.concatenate((self.ends, last + np.cumsum(sizes)))

    def size(self, which: np.ndarray) -> np.ndarray:
        return self.ends[which + 1] - self.ends[which]

    def of(self, which: np.ndarray) -> np.ndarray:
        return runs_of(self.flat, self.ends[which], self.size(which))


class Encoder:
    """Encodes texts; one per process. Memory: the model and the remembered states."""

    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.seed = pieces, seed
        self.limit = int(dropout * 2**64)
        self.forget()

    def forget(self) -> None:
        #: Two hashes of a unit -> state; (a hash of state and bits, bits of the skipped ones of its candidates) -> state.
        self.roots, self.children = Table(), Table()
        #: By state: ids, places of the candidates met first here; the unit's characters, the places met before, those skipped.
        self.ids, self.met = Runs(np.uint32), Runs(np.uint64)
        self.unit, self.known, self.left = Runs(np.uint32), Runs(np.uint64), Runs(np.uint64)
        self.states = 0
        #: By hash, what was asked for once; a clash only means that something is remembered the first time.
        self.once = np.zeros(ONCE, bool)

    def keys(self, units: list[str], starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The key of each unit at its place in the document that starts names."""
        return self.placed(unit_keys(units, self.seed), starts, places)

    @staticmethod
    def placed(own: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        return mix(own + mix(starts + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def worth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One place of each pair that is asked for a second time."""
        names = a ^ mix(b)
        _, first, many = np.unique(names, return_index=True, return_counts=True)
        at = (names[first] % np.uint64(ONCE)).astype(np.int64)
        again = (many > 1) | self.once[at]
        self.once[at[~again]] = True
        return first[again]

    def add(self, unit: np.ndarray, sizes: np.ndarray, known: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """New states: units merged without the candidates of left. All are runs: values, sizes."""
        first, n, table, old, met = self.states, len(sizes), padded(*left), padded(*known), []
        found = merge_codes(self.pieces, unit, np.cumsum(sizes) - sizes, sizes, lambda numbers, places: among(table, numbers, places), met)
        numbers, places = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        new = ~among(old, numbers, places)
        numbers, places = numbers[new], places[new]
        for runs, values, many in (
            (self.ids, *found),
            (self.met, places[np.argsort(numbers, kind="stable")], np.bincount(numbers, minlength=n)),
            (self.unit, unit, sizes),
            (self.known, *known),
            (self.left, *left),
        ):
            runs.add(values, many)
        self.states += n
        return np.arange(first, self.states)

    def learn(self, unit: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        none = np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
        self.roots.add(a, b, self.add(unit, sizes, none, none))

    @staticmethod
    def step(state: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """With the same bits, different states have different hashes."""
        return mix(mix(bits) + state.astype(np.uint64))

    def branch(self, state: np.ndarray, bits: np.ndarray) -> None:
        n = self.met.size(state)
        met, owner = self.met.of(state), np.repeat(np.arange(len(state)), n)
        which = np.arange(len(met)) - np.repeat(np.cumsum(n) - n, n)
        out = (bits[owner] >> which.astype(np.uint64)) & np.uint64(1) > 0
        known = appended(self.known.of(state), self.known.size(state), met, n)
        left = appended(self.left.of(state), self.left.size(state), met[out], np.bincount(owner[out], minlength=len(state)))
        self.children.add(self.step(state, bits), bits, self.add(self.unit.of(state), self.unit.size(state), known, left))

    def skipped(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of the state's candidates that each key skips, whether there are too many to say)."""
        bits, many = np.zeros(len(state), np.uint64), np.zeros(len(state), bool)
        for at in range(0, len(state), HASHED):
            part = state[at : at + HASHED]
            n = self.met.size(part)
            owner = np.repeat(np.arange(len(part)), n)
            hit = np.flatnonzero(dropped(key[at : at + HASHED][owner], self.met.of(part), self.limit))
            which = hit - (np.cumsum(n) - n)[owner[hit]]
            np.bitwise_or.at(bits[at : at + HASHED], owner[hit], np.uint64(1) << (which % 64).astype(np.uint64))
            many[at : at + HASHED] = n > CHOICES
        return bits, many

    def encode(self, texts: list[str | None], starts: list[int]) -> list[bytes | None]:
        """Ids as little-endian uint32 for each text; starts: the key of each document, of 64 bits."""
        if self.states > CACHED:
            self.forget()
        some = [i for i, t in enumerate(texts) if t]
        out: list[bytes | None] = [None if t is None else b"" for t in texts]
        if not some:
            return out
        joined = "".join([f" {texts[i]}" for i in some])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(texts[i]) + 1 for i in some), np.int64, len(some))
        text_at = np.cumsum(lengths) - lengths
        start = unit_starts(codes, text_at)
        sizes = np.diff(start, append=len(codes))
        n_units = np.diff(np.searchsorted(start, text_at), append=len(start))
        first = np.cumsum(n_units) - n_units
        own, other = unit_hashes(codes, start, sizes, self.seed)
        document = np.repeat(np.fromiter((starts[i] & M64 for i in some), np.uint64, len(some)), n_units)
        key = self.placed(own, document, np.arange(len(start)) - np.repeat(first, n_units))

        def spelled_out(which: np.ndarray) -> list[str]:
            return [joined[a:b] for a, b in zip(start[which].tolist(), (start[which] + sizes[which]).tolist(), strict=True)]

        state = self.roots.find(own, other)
        new = np.flatnonzero((state < 0) & (sizes <= SHORT))
        fresh = new[self.worth(own[new], other[new])]
        self.learn(runs_of(codes, start[fresh], sizes[fresh]), sizes[fresh], own[fresh], other[fresh])
        state[new] = self.roots.find(own[new], other[new])
        again = [np.flatnonzero(state < 0)]
        at = np.flatnonzero(state >= 0) if self.limit else again[0][:0]
        while len(at):
            bits, many = self.skipped(state[at], key[at])
            again.append(at[many & (bits > 0)])
            go = (bits > 0) & ~many
            at, bits = at[go], bits[go]
            step = self.step(state[at], bits)
            to = self.children.find(step, bits)
            new = np.flatnonzero(to < 0)
            fresh = new[self.worth(step[new], bits[new])]
            self.branch(state[at[fresh]], bits[fresh])
            to[new] = self.children.find(step[new], bits[new])
            again.append(at[to < 0])
            at, to = at[to >= 0], to[to >= 0]
            state[at] = to
        todo = np.concatenate(again)
        short, long = todo[sizes[todo] <= SHORT], todo[sizes[todo] > SHORT]
        keyed = key[short]
        merged, n_merged = merge_codes(self.pieces, codes, start[short], sizes[short], lambda numbers, places: dropped(keyed[numbers], places, self.limit))
        parts = [np.array(merge_keyed(self.pieces, u, int(k), self.limit), np.uint32) for u, k in zip(spelled_out(long), key[long].tolist(), strict=True)]
        # one source of ids, the remembered ones and then these
        known = int(self.ids.ends[-1])
        source = np.concatenate((self.ids.flat[:known], merged, *parts))
        n = self.ids.size(state)
        begin = self.ids.ends[state]
        redone = np.concatenate((short, long))
        n[redone] = np.concatenate((n_merged, np.fromiter(map(len, parts), np.int64, len(parts))))
        begin[redone] = known + np.cumsum(n[redone]) - n[redone]
        ids = runs_of(source, begin, n).astype("<u4").tobytes()
        ends = 4 * np.cumsum(n)[first + n_units - 1]
        for i, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = ids[a:b]
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder_for(pieces: Pieces, dropout: float, seed: int) -> Encoder:
    """This process's encoder, so that later tasks find units that earlier ones merged."""
    key = (id(pieces), dropout, seed)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(pieces, dropout, seed)
    return _encoders[key]


def spelled(raw: list[bytes], ids: list[int]) -> str:
    """The text of ids; raw: the bytes of each piece."""
    return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    return spelled(pieces.raw, ids)


def groups(texts: list[str | None], most: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about so many characters, so that a batch's units stay few."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encode(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), dropout: float = DROPOUT, seed: int = SEED, model: str = MODEL, copy_col: str | None = None) -> DataFrame:
    """id_col, the columns of keep, and ids (array of int) for each row of docs.

    A null text has null ids, an empty one an empty array. Rows with one id and text get the same ids, unless copy_col
    names the column that numbers the copies (epochs) of a document; the first, 1, gets what it gets without copy_col.
    A null id counts as the empty one. Other columns aren't read. The pieces (some 32,000 strings) are broadcast from the
    driver, so executors need no file of the model.
    """
    shared = spark.sparkContext.broadcast(Pieces.load(model))
    columns = [id_col, *keep]
    copy = F.col(copy_col).cast("long") if copy_col else F.lit(1).cast("long")
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("_text"), copy.alias("_copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value, dropout, seed)
        for whole in batches:
            all_texts = whole.column(len(columns)).to_pylist()
            for part in groups(all_texts):
                batch = whole.slice(part.start, part.stop - part.start)
                named = zip(batch.column(0).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)
                starts = [int.from_bytes(hashlib.blake2b(f"{seed}:{i}:{n}".encode(), digest_size=8).digest(), "little") for i, n in named]
                found = encoder.encode(all_texts[part], starts)
                sizes = np.cumsum([0, *(len(x or b"") // 4 for x in found)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(x or b"" for x in found), "<u4").astype(np.int32))
                mask = pa.array([x is None for x in found], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, mask=mask)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], ids], [*columns, "ids"])

    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in columns), StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The columns of keep and the text of each row's ids; null ids give a null text."""
    shared = spark.sparkContext.broadcast(Pieces.load(model).raw)
    rows = encoded.select(*keep, F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            lists = batch.column(len(keep))
            flat, at = lists.flatten().to_numpy(), 0
            texts: list[str | None] = []
            for n in lists.value_lengths().to_pylist():
                texts.append(None if n is None else spelled(raw, flat[at : at + n].tolist()) if n else "")
                at += n or 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in keep), StructField("text", StringType())])
    return rows.mapInArrow(run, schema)


def op9_subword_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, comma-joined), lossless: the decoded ids are the text."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text").withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    encoded = encode(spark, docs, keep=("_digest",))
    listed = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    encoded = encoded.select("doc_id", "_digest", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), listed.alias("ids_sha256"), "ids")
    decoded = decode(spark, encoded, keep=("doc_id", "_digest", "n_tokens", "ids_sha256"))
    same = F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("_digest"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", same.alias("lossless"))
