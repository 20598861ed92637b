"""Problem 8: passages of evaluation items inside training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordsets import WORD

LEAST_WORDS = 12
#: Words of a shard that are sorted at a time, and characters of evaluation text sent to the tasks at a time.
SHARD_WORDS, ITEM_BLOCK_CHARS = 1_500_000, 32_000_000
#: Pairs of suffixes that are looked at together; bounds memory, never results.
EXPANDED = 2_000_000


class Items:
    """Evaluation items as word numbers; 0 stands between items and for words that no item has."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.number: dict[str, int] = {}
        parts: list[int] = []
        at: list[int] = []
        self.ids: list[int] = []
        for k, (item, text) in enumerate(sorted(rows, key=lambda r: r[0])):
            words = WORD.findall((text or "").lower())
            self.ids.append(item)
            parts += [self.number.setdefault(w, len(self.number) + 1) for w in words] + [0]
            at += [k] * (len(words) + 1)
        self.words, self.item = np.array(parts, np.int64), np.array(at, np.int64)


def _windows(t: np.ndarray, least: int) -> np.ndarray:
    """Positions from which `least` words in a row are item words: only these suffixes can hold a match."""
    zero = np.concatenate([[0], np.cumsum(t == 0)])
    return np.flatnonzero(zero[least:] == zero[:-least]) if len(t) >= least else np.zeros(0, np.int64)


def _order(t: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """For each position of `at` the rank of its first `least` words in lexicographic order (equal words, equal rank).

    Prefix doubling: ranks over 2k words come from two ranks over k. Positions past a window keep rank 0.
    """
    rank, k = t.copy(), 1
    while 2 * k <= least:
        use = _windows(t, 2 * k)
        _, new = np.unique(rank[use] * (rank.max() + 1) + rank[use + k], return_inverse=True)
        rank = np.zeros(len(t), np.int64)
        rank[use] = new + 1
        k *= 2
    return rank[at] * (rank.max() + 1 if len(rank) else 1) + rank[at + least - k]


class Suffixes:
    """Suffixes of text that both a shard and the items hold, in true lexicographic order.

    tokens[i] numbers the `least` words from place[i] on; a longer match is a longer run of equal tokens at places that
    follow each other. Prefix doubling ranks the first 2**k tokens of every suffix for each k, so two suffixes are
    compared, and their common prefix is measured, in as many steps as the longest run has binary digits.
    """

    def __init__(self, tokens: np.ndarray, place: np.ndarray):
        n = len(tokens)
        breaks = np.flatnonzero(np.diff(place) != 1) + 1
        self.end = np.repeat(np.append(breaks, n), np.diff(np.concatenate([[0], breaks, [n]])))
        self.levels, k, longest = [tokens], 1, int((self.end - np.arange(n)).max())
        while k < longest:
            r = self.levels[-1]
            nxt = np.arange(n) + k
            after = np.where(nxt < self.end, r[np.minimum(nxt, n - 1)], 0)
            self.levels.append(np.unique(r * (int(r.max()) + 1) + after, return_inverse=True)[1] + 1)
            k *= 2
        self.rank = self.levels[-1]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Equal tokens from suffixes p and q on, pair by pair."""
        x, y = p.copy(), q.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            ok = (x + step <= self.end[p]) & (y + step <= self.end[q])
            ok[ok] = self.levels[k][x[ok]] == self.levels[k][y[ok]]
            x, y = x + ok * step, y + ok * step
        return x - p

    def head(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Two numbers that tell the first n tokens of suffixes p from all others of that length; none (-1) where the run is shorter."""
        k = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
        whole = p + n <= self.end[p]
        last = np.where(whole, p + n - (1 << k), p)
        levels = np.stack(self.levels)
        return np.where(whole, levels[k, p], -1), np.where(whole, levels[k, last], -1)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, offset) of count[i] entries for each i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _parts(count: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose counts add up to some `most`, at least one entry each."""
    total, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def matches(docs: list[tuple[int, str | None]], items: Items, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """(doc_id, item_id, words, position) with the longest verbatim match of each item in each document of a shard.

    position is the first place of a longest match. Suffixes of the shard and of the items that start with the same
    `least` words are put in suffix order. Documents and items that share such a start are pairs; in each, every item
    suffix is looked up among the document's by binary search, and the neighbours on both sides hold the longest match.
    Time grows with the texts and the number of pairs, not with how often a passage is repeated.
    """
    parts, owner, start = [], [], [0]
    for doc, text in docs:
        parts += [items.number.get(x, 0) for x in WORD.findall((text or "").lower())]
        parts.append(0)
        owner.append(doc)
        start.append(len(parts))
    n = len(parts)
    t = np.concatenate([np.array(parts, np.int64), [0], items.words])
    at = _windows(t, least)
    if not len(at) or at[0] >= n or at[-1] < n:
        return []
    key = _order(t, at, least)
    common = np.intersect1d(key[at < n], key[at >= n])
    if not len(common):
        return []
    keep = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
    at, key = at[keep], key[keep]
    s = Suffixes(np.searchsorted(common, key) + 1, at)
    mine = np.flatnonzero(at < n)
    test = np.flatnonzero(at >= n)
    doc, item = np.searchsorted(np.array(start), at[mine], "right") - 1, items.item[at[test] - n - 1]
    n_items = len(items.ids)

    # documents and items with an equal start, each pair once
    du, iu = np.unique(s.levels[0][mine] * len(docs) + doc), np.unique(s.levels[0][test] * n_items + item)
    d_start, i_start = (np.searchsorted(u // w, np.arange(1, len(common) + 2)) for u, w in ((du, len(docs)), (iu, n_items)))
    sizes = np.diff(d_start) * np.diff(i_start)
    pairs = np.zeros(0, np.int64)
    for part in _parts(sizes, EXPANDED):
        g, k = _spread(sizes[part])
        g += part.start
        width = np.diff(i_start)[g]
        pairs = np.union1d(pairs, du[d_start[g] + k // width] % len(docs) * n_items + iu[i_start[g] + k % width] % n_items)

    # each document's suffixes in order, each item's suffixes
    in_doc = np.lexsort((at[mine], s.rank[mine], doc))
    sorted_mine, scale = mine[in_doc], int(s.rank.max()) + 1
    sorted_key = doc[in_doc] * scale + s.rank[sorted_mine]
    d_bound, i_bound = np.searchsorted(doc[in_doc], np.arange(len(docs) + 1)), np.searchsorted(item, np.arange(n_items + 1))
    out = []
    for part in _parts(np.diff(i_bound)[pairs % n_items] + np.diff(d_bound)[pairs // n_items], EXPANDED):
        d, i = pairs[part] // n_items, pairs[part] % n_items
        of, k = _spread(np.diff(i_bound)[i])
        q = test[i_bound[i[of]] + k]
        place = np.searchsorted(sorted_key, d[of] * scale + s.rank[q])
        longest = np.zeros(len(of), np.int64)
        for side in (place - 1, place):
            inside = (side >= d_bound[d[of]]) & (side < d_bound[d[of] + 1])
            longest[inside] = np.maximum(longest[inside], s.common(sorted_mine[side[inside]], q[inside]))
        first = np.cumsum(np.diff(i_bound)[i]) - np.diff(i_bound)[i]
        best = np.maximum.reduceat(longest, first)
        # where it stands first: document suffixes that begin like an item suffix, for as many words
        x, y = s.head(q, best[of])
        of_d, k = _spread(np.diff(d_bound)[d])
        p = sorted_mine[d_bound[d[of_d]] + k]
        v, w = s.head(p, best[of_d])
        ids = np.unique(np.stack([np.concatenate([of, of_d]), np.concatenate([x, v]), np.concatenate([y, w])], axis=1), axis=0, return_inverse=True)[1].ravel()
        hit = np.isin(ids[len(of) :], ids[: len(of)][x >= 0])
        where = np.full(len(d), np.iinfo(np.int64).max)
        np.minimum.at(where, of_d[hit], at[p[hit]])
        out += [(owner[a], items.ids[b], m + least - 1, pos - start[a]) for a, b, m, pos in zip(d.tolist(), i.tolist(), best.tolist(), where.tolist(), strict=True)]
    return out


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, words, position) for every document with `least` or more consecutive words of an item.

    words and position tell the longest match and where in the document it stands first. A narrow pass over the documents: each partition sorts its own
    suffixes, shard by shard, and searches all items in them; only hits leave. The items are sent to the tasks in
    blocks of at most ITEM_BLOCK_CHARS characters, whatever their number, each block against all documents.
    Documents and items of fewer than `least` words, null and empty ones match nothing; equal items all match.
    """
    size = eval_items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BLOCK_CHARS))
    out = None
    for k in range(blocks):
        part = eval_items.select("item_id", "text").where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        items = Items([(r.item_id, r.text) for r in part.collect()])

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            shard: list[tuple[int, str | None]] = []
            size = 0

            def found() -> pa.RecordBatch:
                hits = matches(shard, items, least)
                return pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "words", "position"])

            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    shard.append((doc, text))
                    size += len(text or "") // 5
                    if size > SHARD_WORDS:
                        yield found()
                        shard, size = [], 0
            yield found()

        hits = documents.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, words int, position int")
        out = hits if out is None else out.union(hits)
    return out


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no passage of an item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
