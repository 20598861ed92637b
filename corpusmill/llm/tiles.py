"""Inverted lists in packed form, and the block kernel that meets their members.

Map tasks append fixed-size binary postings to one buffer per bucket, so the shuffle moves a few large rows
instead of one row a posting. A reduce task takes one bucket at a time, sorts its postings by key and compares the
members of each list block by block with the 128-bit parity vectors, whose Hamming distance never exceeds the number
of words in which two sets differ: no pair at or above the threshold is lost, and no block exceeds BLOCK_PAIRS
comparisons. Postings of a list have side 0, and any pair of them may meet, or both sides, and then only pairs of a
side 0 with a side 1 meet: so a list that is too long is cut into a grid of cells, each a list of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .wordsets import mixed

POSTING = np.dtype([("key", "<u4"), ("id", "<u8"), ("s0", "<u8"), ("s1", "<u8"), ("n", "<u4"), ("pos", "<u2"), ("side", "u1"), ("skip", "<u2")])
BLOCK_ROWS, BLOCK_PAIRS = 128, 1 << 16
SHORT_LIST = 64
#: Pairs a member, or in all, beyond which a list is dense: it is linked through LEADERS first, then by label (see forest()).
DENSE, DENSE_PAIRS, LEADERS = 64, 2_000_000, 64
#: Bytes of postings in a bucket and in a task, about; and the most tasks of one shuffle.
BUCKET_BYTES, TASK_BYTES, MOST_TASKS = 1 << 20, 4 << 20, 20_000
FLUSH_BYTES = 24 << 20
BLOB_SCHEMA = "bucket int, blob binary"


class Buckets:
    """Collects postings by bucket and hands them out as Arrow batches."""

    def __init__(self, n: int):
        self.n, self.parts, self.bytes = n, [], 0

    def add(self, bucket: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((bucket.astype(np.int32), rows))
        self.bytes += rows.nbytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bucket, rows = np.concatenate([b for b, _ in self.parts]), np.concatenate([r for _, r in self.parts])
        self.parts, self.bytes = [], 0
        at = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[at], rows[at]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "blob"]
        )


def widths(postings: int, least: int) -> tuple[int, int]:
    """(tasks, buckets) for so many postings: both follow the bytes, so neither a task nor a bucket grows with the table."""
    size = postings * POSTING.itemsize
    tasks = min(max(least, -(-size // TASK_BYTES)), max(least, MOST_TASKS))
    return tasks, max(4 * tasks, -(-size // BUCKET_BYTES))


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its postings arranged), one bucket after another; rows must come sorted by bucket."""
    at, blobs = None, []
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if k != at and blobs:
                yield at, arrange(np.frombuffer(b"".join(blobs), POSTING))
                blobs = []
            at = k
            blobs.append(blob)
    if blobs:
        yield at, arrange(np.frombuffer(b"".join(blobs), POSTING))


def arrange(p: np.ndarray) -> np.ndarray:
    """Postings by key, side and size, each once though several tasks may have posted it."""
    p = p[np.lexsort((p["s0"], p["id"], p["n"], p["side"], p["key"]))]
    same = np.zeros(len(p), bool)
    same[1:] = (p["id"][1:] == p["id"][:-1]) & (p["key"][1:] == p["key"][:-1]) & (p["side"][1:] == p["side"][:-1]) & (p["s0"][1:] == p["s0"][:-1]) & (p["pos"][1:] == p["pos"][:-1])
    return p[~same] if same.any() else p


def numbered(p: np.ndarray) -> np.ndarray:
    """For each posting the index of one that stands for its set."""
    at = np.lexsort((p["s0"], p["id"]))
    new = np.ones(len(p), bool)
    new[1:] = (p["id"][at][1:] != p["id"][at][:-1]) | (p["s0"][at][1:] != p["s0"][at][:-1])
    out = np.empty(len(p), np.int64)
    out[at] = at[new][np.cumsum(new) - 1]
    return out


def grid(h: np.ndarray, ids: np.ndarray, side: np.ndarray | None, known: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which posting, its list's number, side) with the postings under hot values sent to the cells of a grid.

    h: the value of each posting; known: hot values, sorted; parts: into how many blocks each one's side 0 and side 1
    fall (by id). With sides a posting goes to the cells of its block and every block of the other side. Without, all
    postings fall into parts[:, 0] blocks; two blocks meet in one cell as its sides, and each block meets itself.
    """
    n = len(h)
    given = np.zeros(n, np.uint8) if side is None else side
    if not len(known) or not n:
        return np.arange(n), h, given
    i = np.searchsorted(known, h)
    i[i == len(known)] = 0
    hot = known[i] == h
    if not hot.any():
        return np.arange(n), h, given
    mine = np.where(hot, parts[i, given], 1).astype(np.int64)
    others = np.where(hot, parts[i, 0 if side is None else 1 - given], 1).astype(np.int64)
    own = (mixed(ids) % mine.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(n), others)
    x = np.arange(len(at)) - np.repeat(np.cumsum(others) - others, others)
    y = own[at]
    if side is None:
        first, second, s = np.minimum(x, y), np.maximum(x, y), (y > x).astype(np.uint8)
    else:
        first, second, s = np.where(given[at] == 0, y, x), np.where(given[at] == 0, x, y), given[at]
    cell = (first.astype(np.uint64) << np.uint64(32)) + second.astype(np.uint64)
    with np.errstate(over="ignore"):
        number = np.where(cell > 0, mixed(h[at] ^ mixed(cell)), h[at])
    return at, number, s


def filed(number: np.ndarray, p: np.ndarray, buckets: int) -> np.ndarray:
    """Writes the key of each posting and gives its bucket."""
    p["key"] = (number >> np.uint64(32)).astype(np.uint32)
    return (mixed(number) % np.uint64(buckets)).astype(np.int64)


def candidates(p: np.ndarray, num: int, den: int, sided: bool = False, dense: list[tuple[int, int]] | None = None, most: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings (i, j) of one list whose sizes and parity vectors allow an overlap of num/den.

    In a list with both sides i and j are on different ones, else every unordered pair comes once. p must be arranged.
    Short lists are met all at once by distance in the array, long ones in blocks. sided: the lists are those of
    prefix words, whose positions filter as well, and one side alone gives no pairs. dense: where given, a list with very many pairs yields its members'
    pairs with a few leaders instead of all pairs, and its bounds are appended to dense, for forest() to finish; most is
    the number of pairs a member that is not yet very many.
    """
    if len(p) < 2:
        return
    cut = np.flatnonzero(np.diff(p["key"])) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]])
    size = ends - starts
    two = (p["side"][ends - 1] > 0) | sided
    small = (size > 1) & (size <= SHORT_LIST)
    end_of, crossed = np.repeat(ends, size), np.repeat(two, size)
    at = np.flatnonzero(np.repeat(small, size))
    n, s0, s1, side = p["n"].astype(np.int64), np.ascontiguousarray(p["s0"]), np.ascontiguousarray(p["s1"]), p["side"]
    gap = 1
    while len(at := at[at + gap < end_of[at]]):
        j = at + gap
        ok = np.bitwise_count(s0[at] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[at] ^ s1[j])
        ok = (ok * (den + num) <= (den - num) * (n[at] + n[j])) & (den * np.minimum(n[at], n[j]) >= num * np.maximum(n[at], n[j]))
        ok &= ~crossed[at] | (side[at] != side[j])
        if ok.any():
            yield at[ok], j[ok]
        gap += 1
    for a, b in zip(starts[size > SHORT_LIST].tolist(), ends[size > SHORT_LIST].tolist(), strict=True):
        if dense is None:
            yield from met(p, a, b, num, den, sided)
            continue
        held, n_held = [], 0
        for x, y in met(p, a, b, num, den, sided):
            held.append((x, y))
            n_held += len(x)
            if n_held > min(most * (b - a), DENSE_PAIRS):
                dense.append((a, b))
                held = list(star(p, a, b, num, den))
                break
        yield from held


def met(p: np.ndarray, a: int, b: int, num: int, den: int, sided: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the list that lies in p from a to b."""
    m = a + int(np.searchsorted(p["side"][a:b], 1))
    if m == b:
        for x, y in meet(p[a:b], p[a:b], num, den, same=True) if not sided else ():
            yield x + a, y + a
    elif m > a:
        for x, y in (meet_sides if sided else meet)(p[a:m], p[m:b], num, den):
            yield x + a, y + m


def star(p: np.ndarray, a: int, b: int, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each member of a list with the first of its leaders that it may be linked to: at most one pair a member."""
    m = a + int(np.searchsorted(p["side"][a:b], 1))
    for lo, hi, c, d in [(a, b, a, b)] if m == b else [(a, m, m, b), (m, b, a, m)]:  # leaders, and their members
        free = np.ones(d - c, bool)
        for i in np.unique(np.linspace(lo, hi - 1, min(LEADERS, hi - lo)).astype(np.int64)) if hi > lo else ():
            for _, y in meet(p[i : i + 1], p[c:d], num, den):
                y = y[free[y] & (y + c != i)]
                free[y] = False
                yield np.full(len(y), i), y + c


class Labels:
    """Which members of a list are linked so far: labels that can be put together."""

    def __init__(self, label: np.ndarray):
        names, self.own = np.unique(label, return_inverse=True)
        self.parent = np.arange(len(names))
        self.now = self.own

    def find(self, i: int) -> int:
        up = self.parent
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Puts the labels of members x and y together, pair by pair; which pairs had different ones."""
        new = np.zeros(len(x), bool)
        for k, (i, j) in enumerate(zip(self.own[x].tolist(), self.own[y].tolist(), strict=True)):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                new[k] = True
        if new.any():
            while (up := self.parent[self.parent]).tolist() != self.parent.tolist():
                self.parent = up
            self.now = self.parent[self.own]
        return new


def shared(words: np.ndarray, starts: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Words that the sets x and y have in common, pair by pair. table: sorted marks of all (set, word), see marks()."""
    at = np.repeat(starts[x] - (np.cumsum(n[x]) - n[x]), n[x]) + np.arange(int(n[x].sum()))
    q = words[at] ^ mixed(np.repeat(y, n[x]).astype(np.uint64))
    i = np.searchsorted(table, q)
    i[i == len(table)] = 0
    return np.add.reduceat((table[i] == q).astype(np.int64), np.cumsum(n[x]) - n[x])


def marks(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sort(words ^ mixed(np.repeat(np.arange(len(n)), n).astype(np.uint64)))


def forest(p: np.ndarray, label: np.ndarray, words: np.ndarray, agree: Callable[[np.ndarray, np.ndarray], np.ndarray], num: int, den: int, step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link the members of one arranged list with each other: no more than there are members.

    label: what is linked already; words: the members' sets, one after another (p["n"] words each); agree: whether a
    pair collides often enough. Each pair that may be linked and whose labels still differ is compared on its words; a
    link puts two labels together, so a list of near copies is settled by its first links, and nothing is emitted
    for pairs that fail.
    """
    n = p["n"].astype(np.int64)
    starts, table, labels = np.cumsum(n) - n, marks(words, n), Labels(label)
    for x, y in met(p, 0, len(p), num, den):
        while len(x):
            apart = labels.now[x] != labels.now[y]
            x, y = x[apart], y[apart]
            i, j, x, y = x[:step], y[:step], x[step:], y[step:]
            if len(i):
                both = shared(words, starts, n, i, j, table)
                ok = both * den >= (n[i] + n[j] - both) * num
                ok[ok] = agree(i[ok], j[ok])
                new = labels.link(i[ok], j[ok])
                if new.any():
                    yield i[ok][new], j[ok][new]


def meet_sides(e: np.ndarray, t: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two lists of one prefix word, by the position filter as well.

    If the word is the first that two sets of n and m words share, at positions i and j, they share at most
    min(n - i, m - j) words. So a posting has a largest partner; where that is smaller than its own set, it needs
    no partner of its own kind: either list is cut in two, and of the four meetings one falls away.
    """
    cuts = []
    for p in (e, t):
        n = p["n"].astype(np.int64)
        most = (n - p["pos"]) * (num + den) // num - n
        cuts.append((most, np.flatnonzero(most >= n), np.flatnonzero(most < n)))
    (me, e_wide, e_late), (mt, t_wide, t_late) = cuts
    for rows in (e_wide, e_late):
        if len(rows) and len(t_wide):
            for x, y in meet(e[rows], t[t_wide], num, den, most_size=me[rows]):
                yield rows[x], t_wide[y]
    if len(t_late) and len(e_wide):
        for y, x in meet(t[t_late], e[e_wide], num, den, most_size=mt[t_late]):
            yield e_wide[x], t_late[y]


def meet(e: np.ndarray, t: np.ndarray, num: int, den: int, same: bool = False, most_size: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into e, into t) that can still reach an overlap of num/den; t must be sorted by n.

    most_size: for each row of e the largest n of a partner. same: e is t, and each unordered pair is met once.
    All bounds are exact integers.
    """
    en, tn = e["n"].astype(np.int64), t["n"].astype(np.int64)
    most_size = den * en // num if most_size is None else np.minimum(most_size, den * en // num)
    order = np.arange(len(e)) if same else np.argsort(most_size, kind="stable")
    e, en, most_size = e[order], en[order], most_size[order]
    e0, t0 = np.ascontiguousarray(e["s0"]), np.ascontiguousarray(t["s0"])
    e1, t1 = np.ascontiguousarray(e["s1"]), np.ascontiguousarray(t["s1"])
    # buffers of one block stay in the processor's cache and are used again for every block
    xor, bits, near = np.empty(BLOCK_PAIRS, np.uint64), np.empty(BLOCK_PAIRS, np.uint8), np.empty(BLOCK_PAIRS, bool)
    for i in range(0, len(e), BLOCK_ROWS):
        j = min(i + BLOCK_ROWS, len(e))
        largest = int(en[i:j].max())
        lo = int(np.searchsorted(tn, -(-num * int(en[i:j].min()) // den)))
        hi = int(np.searchsorted(tn, int(most_size[j - 1]), side="right"))
        column, wide = e0[i:j, None], BLOCK_PAIRS // (j - i)
        for a in range(max(lo, i) if same else lo, hi, wide):
            b = min(hi, a + wide)
            w = b - a
            k = (j - i) * w
            most = (den - num) * (largest + int(tn[b - 1])) // (den + num)
            np.bitwise_xor(column, t0[None, a:b], out=xor[:k].reshape(j - i, w))
            np.bitwise_count(xor[:k], out=bits[:k])
            np.less_equal(bits[:k], np.uint8(min(most, 64)), out=near[:k])
            at = np.flatnonzero(near[:k])
            if len(at):
                d = bits[at].astype(np.int64)
                x, y = at // w + i, at % w + a
                d += np.bitwise_count(e1[x] ^ t1[y])
                n, m = en[x], tn[y]
                ok = (d * (den + num) <= (den - num) * (n + m)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
                if same:
                    ok &= x < y
                if ok.any():
                    yield order[x[ok]], y[ok]
