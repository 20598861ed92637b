"""Word sets of records: tokenising, word hashes, set identities, parity sketches and min-hash coordinates.

A word is a maximal run of letters and digits, in lower case. Every value here depends on the text alone, so any
executor computes the same one. All work is done a batch at a time on arrays of code points: a word's 63-bit hash is
the sum of one random number for each of its characters in its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\W_]+")
#: Code points that are hashed at a time; bounds memory, never results.
SLICE_CHARS = 1 << 20
_ODD, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Word hashes have 63 bits; frequent words are ordered behind all others, from here on.
FREQUENT = np.uint64(1 << 63)


@cache
def _in_word() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose values look random."""
    x = x * _ODD
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, pieces) of some SLICE_CHARS each; a longer text is cut between words."""
    owner, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + SLICE_CHARS)
            while end < len(t) and t[end - 1].isalnum() and t[end].isalnum():
                end += 1
            owner.append(i)
            pieces.append(t[at:end] if at or end < len(t) else t)
            size += end - at
            at = end
            if size >= SLICE_CHARS:
                yield owner, pieces
                owner, pieces, size = [], [], 0
    if pieces:
        yield owner, pieces


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word of lower-case texts, in order."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for owner, pieces in _slices(texts):
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cp = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _in_word()[cp]
        ends = np.cumsum(size)
        # a piece's border ends a word: mark starts and ends piece by piece
        first = np.zeros(len(cp), bool)
        first[(ends - size)] = True
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]) | inside & first)
        if not len(starts):
            continue
        at = np.flatnonzero(inside)
        bound = np.searchsorted(at, starts)
        n = np.diff(np.append(bound, len(at)))
        place = np.arange(len(at)) - np.repeat(bound, n)
        h = np.add.reduceat(mixed(cp[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)) + np.uint64(1)), bound)
        hashes.append(h >> np.uint64(1))
        owners.append(np.array(owner)[np.searchsorted(ends, starts, "right")])
    return np.concatenate(hashes), np.concatenate(owners)


class Order:
    """An order of words, rarest first: those that aren't listed as frequent by hash, then the listed ones as listed."""

    def __init__(self, frequent: list[int] | np.ndarray = ()):
        self.frequent = np.array(frequent, np.uint64)
        at = np.argsort(self.frequent)
        self.known, self.rank = self.frequent[at], at.astype(np.uint64)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return h
        i = np.searchsorted(self.known, h)
        i[i == len(self.known)] = 0
        return np.where(self.known[i] == h, FREQUENT + self.rank[i], h)

    def words(self, o: np.ndarray) -> np.ndarray:
        """The hashes that stand behind places in the order."""
        if not len(self.known):
            return o
        return np.where(o >= FREQUENT, self.frequent[np.where(o >= FREQUENT, o - FREQUENT, 0).astype(np.int64)], o)


class Sets:
    """The distinct words of records, one after another in `words` (hashes, each record's in the given order).

    rows: the records that have a word; n: how many each has; starts: where each begins.
    """

    def __init__(self, users: list, answers: list, order: Order | None = None):
        order = order or Order()
        h, owner = hashed_words([f"{u or ''}\n{a or ''}".lower() for u, a in zip(users, answers, strict=True)])
        o = order.of(h)
        cut = np.flatnonzero(np.diff(owner)) + 1
        starts = np.concatenate([[0], cut]) if len(owner) else np.zeros(0, np.int64)
        bounds = [*starts.tolist(), len(o)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            o[a:b].sort()
        new = np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, bool)
        new[starts] = True
        self.rows = owner[starts]
        self.n = np.add.reduceat(new, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.words = order.words(o[new])
        self.starts = np.cumsum(self.n) - self.n

    @classmethod
    def of(cls, batch: pa.RecordBatch, order: Order | None = None) -> Sets:
        return cls(batch.column("user_text").to_pylist(), batch.column("assistant_text").to_pylist(), order)

    def __len__(self) -> int:
        return len(self.n)

    def ids(self) -> np.ndarray:
        """A 64-bit number of each set: a sum over its words, so it is independent of their order."""
        return np.add.reduceat(mixed(self.words ^ np.uint64(0x5DEECE66D)), self.starts) if len(self) else np.zeros(0, np.uint64)

    def sketches(self) -> np.ndarray:
        """128-bit parity vectors. Two sets' vectors differ in at most as many bits as the sets have different words."""
        bit = mixed(self.words + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        low = bit < 64
        halves = [np.bitwise_xor.reduceat(np.where(keep, one, np.uint64(0)), self.starts) if len(self) else np.zeros(0, np.uint64) for keep in (low, ~low)]
        return np.stack(halves, axis=1)


def classes(ids: np.ndarray, sketches: np.ndarray) -> pa.Array:
    """The 128-bit identity of each set as binary: its number, and one drawn from its parity vector."""
    out = np.empty((len(ids), 2), np.uint64)
    out[:, 0] = ids
    out[:, 1] = mixed(sketches[:, 0] ^ mixed(sketches[:, 1]))
    return binary16(out)


def binary16(pairs: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binary values of 16 bytes."""
    n = len(pairs)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(pairs))])


class Signer:
    """Coordinates of word sets: each joins `width` min-hashes into one 64-bit value."""

    def __init__(self, coordinates: int, width: int):
        self.coordinates, self.width = coordinates, width
        seeds = np.frombuffer(b"".join(blake2b(b"coordinate %d" % i, digest_size=16).digest() for i in range(coordinates * width)), dtype=np.uint64)
        self.mul, self.add = seeds[0::2] | np.uint64(1), seeds[1::2]

    def __call__(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, coordinates) values of the sets that begin at `starts`."""
        if not len(starts):
            return np.zeros((0, self.coordinates), np.uint64)
        known, at = np.unique(words, return_inverse=True)
        x = mixed(known + np.uint64(0x632BE59BD9B4E019))
        mins = np.empty((len(known), self.coordinates * self.width), np.uint32)
        for i in range(0, len(known), 4096):
            y = x[i : i + 4096, None] * self.mul + self.add
            y ^= y >> np.uint64(29)
            y *= _MIX_A
            mins[i : i + 4096] = y >> np.uint64(32)
        bounds = np.append(starts, len(words))
        low = np.empty((len(starts), mins.shape[1]), np.uint32)
        i = 0
        while i < len(starts):  # sets of some 16,000 words together, at least one set
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + 16_384, "right")) - 1)
            np.minimum.reduceat(mins[at[bounds[i] : bounds[j]]], starts[i:j] - starts[i], axis=0, out=low[i:j])
            i = j
        v = np.zeros((len(starts), self.coordinates), np.uint64)
        for k in range(self.width):
            v = (v ^ low[:, k :: self.width]) * _ODD
            v ^= v >> np.uint64(31)
        v = (v + np.arange(self.coordinates, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        return v
