"""Byte-pair vocabularies: training on a corpus, encoding, decoding, checking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .encode import canonical_hash

Merge = tuple[int, int]
#: Ids below this are bytes and role tokens; merge i makes id FIRST + i.
FIRST = 261
#: Distinct texts, and their bytes, whose token sequences the driver holds while it trains; more are counted in tasks, with the same merges.
DRIVER_TEXTS, DRIVER_BYTES = 200_000, 64 << 20
#: Merges that tasks replay on the kept sequences before those are kept anew; changes no result.
REPLAY = 6
#: Vocabularies of more merges are applied text by text, others to a batch at once; both give the same ids.
BATCH_MERGES = 256


def corpus(rows: DataFrame, byte_limit: int | None = None) -> DataFrame:
    """(line, part, text): each row's system (if any), user and assistant in order, up to the first text that overflows the limit.

    The running total is taken by row first, then inside a row, so only per-row sums go through the ordered
    window; those are pre-aggregated by blocks of lines.
    """
    parts = rows.select("line", F.posexplode(F.array("system", "user", "assistant")).alias("part", "text")).where((F.col("part") > 0) | (F.col("text") != ""))
    if byte_limit is None:
        return parts
    parts = parts.withColumn("_n", F.octet_length("text").cast("long")).withColumn("_block", F.floor(F.col("line") / 10_000))
    blocks = parts.groupBy("_block").agg(F.sum("_n").alias("_b"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_b").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("_n").over(W.partitionBy("_block").orderBy("line", "part"))
    summed = parts.join(before, "_block").withColumn("_total", F.col("_before") + inside)
    stop = summed.where(F.col("_total") > byte_limit).agg(F.min(F.struct("line", "part")).alias("s")).first().s
    kept = summed if stop is None else summed.where((F.col("line") < stop.line) | ((F.col("line") == stop.line) & (F.col("part") < stop.part)))
    return kept.select("line", "part", "text")


def _merge(seq: list[int], pair: Merge, new: int) -> list[int]:
    out, i = [], 0
    while i < len(seq):
        if i + 1 < len(seq) and seq[i] == pair[0] and seq[i + 1] == pair[1]:
            out.append(new)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def train(texts: DataFrame, vocab_size: int, min_frequency: int = 2, text: str = "text") -> tuple[list[Merge], str]:
    """(merges, why it stopped). Every overlapping pair counts; the most frequent wins, of several the smallest.

    Equal texts fall together with their number first, by an aggregate. Up to DRIVER_TEXTS distinct ones train on
    the driver; beyond, each step is a job that counts pairs in tasks and brings back one pair.
    """
    if vocab_size < FIRST:
        raise ValueError(f"vocab_size must be at least {FIRST}")
    distinct = cut(texts.groupBy(text).agg(F.count("*").alias("n")).where(f"`{text}` <> ''"))
    size = distinct.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    merges: list[Merge] = []
    if size.texts > DRIVER_TEXTS or size.bytes > DRIVER_BYTES:
        tasks = _Tasks(distinct, text)
        while len(merges) < vocab_size - FIRST:
            best = tasks.best(merges)
            if best is None or best[0] < min_frequency:
                tasks.kept.unpersist()
                return merges, "no_pairs" if best is None else "min_frequency_not_met"
            merges.append(best[1])
        tasks.kept.unpersist()
        return merges, "target_vocab_reached"
    head = distinct.collect()
    groups = _grouped([r[0] for r in head], [r.n for r in head])
    del head
    while len(merges) < vocab_size - FIRST:
        best = _best(_counted(groups, FIRST + len(merges)))
        if best is None:
            return merges, "no_pairs"
        if best[0] < min_frequency:
            return merges, "min_frequency_not_met"
        merges.append(best[1])
        groups = [(n, _merge_all(x, best[1], FIRST + len(merges) - 1)) for n, x in groups]
    return merges, "target_vocab_reached"


def _flat(texts: list[str]) -> np.ndarray:
    """Bytes of all texts in one array, each text followed by -1."""
    coded = [t.encode() for t in texts]
    out = np.full(sum(map(len, coded)) + len(coded), -1, np.int32)
    ends = np.cumsum([len(c) + 1 for c in coded]) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = np.frombuffer(b"".join(coded), np.uint8)
    return out


def _grouped(texts: list[str], numbers: list[int]) -> list[tuple[int, np.ndarray]]:
    """The texts in flat arrays by how often each occurs."""
    by: dict[int, list[str]] = {}
    for t, n in zip(texts, numbers, strict=True):
        by.setdefault(n, []).append(t)
    return [(n, _flat(ts)) for n, ts in by.items()]


def _merge_all(x: np.ndarray, pair: Merge, new: int) -> np.ndarray:
    """_merge over a flat array."""
    at = np.flatnonzero((x[:-1] == pair[0]) & (x[1:] == pair[1]))
    if not len(at):
        return x
    if pair[0] == pair[1]:  # of a run only every other place, from its start
        first = np.concatenate([[True], np.diff(at) != 1])
        at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
    out, keep = x.copy(), np.ones(len(x), bool)
    out[at] = new
    keep[at + 1] = False
    return out[keep]


def _counted(groups: list[tuple[int, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, number) of every pair of neighbours; ids are below size."""
    k, keys, numbers = size + 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, x in groups:
        pairs = (x[:-1].astype(np.int64) + 1) * k + x[1:] + 1
        if k * k <= 4 * max(len(x), 50_000):
            c = np.bincount(pairs, minlength=k * k)
            u = np.flatnonzero(c)
            c = c[u]
        else:
            u, c = np.unique(pairs, return_counts=True)
        inside = (u >= k) & (u % k > 0)
        keys.append(u[inside])
        numbers.append(c[inside] * n)
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, at, np.concatenate(numbers))
    return u // k - 1, u % k - 1, total


def _best(counted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[int, Merge] | None:
    a, b, n = counted
    if not len(n):
        return None
    i = int(np.argmax(n))  # the first of several, and pairs are in order
    return int(n[i]), (int(a[i]), int(b[i]))


class _Tasks:
    """Sequences kept in the tasks as flat arrays by number of occurrences; merges are replayed on them."""

    def __init__(self, distinct: DataFrame, text: str):
        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g = _grouped(b.column(text).to_pylist(), b.column("n").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in g], pa.int64()), pa.array([x.tobytes() for _, x in g], pa.binary())], ["n", "ids"])

        self.kept, self.done = distinct.mapInArrow(flat, "n long, ids binary").persist(), 0
        self.older: DataFrame | None = None

    def best(self, merges: list[Merge]) -> tuple[int, Merge] | None:
        todo = list(enumerate(merges))[self.done :]

        def replayed(b: pa.RecordBatch, todo: list[tuple[int, Merge]]) -> Iterator[tuple[int, np.ndarray]]:
            for n, ids in zip(b.column("n").to_pylist(), b.column("ids"), strict=True):
                x = np.frombuffer(ids.as_buffer(), np.int32)
                for i, m in todo:
                    x = _merge_all(x, m, FIRST + i)
                yield n, x

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g = list(replayed(b, todo))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in g], pa.int64()), pa.array([x.tobytes() for _, x in g], pa.binary())], ["n", "ids"])

        if len(todo) >= REPLAY:
            self.older, self.kept, self.done = self.kept, self.kept.mapInArrow(keep, "n long, ids binary").persist(), len(merges)
        size, left = FIRST + len(merges), list(enumerate(merges))[self.done :]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, c, n = _counted(list(replayed(b, left)), size)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.int64())], ["a", "b", "n"])

        r = self.kept.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if self.older is not None:
            self.older.unpersist()
            self.older = None
        return None if r is None else (r.n, (r.a, r.b))


def encode_ids(text: str, ranks: dict[Merge, int]) -> list[int]:
    """Token ids: of the pairs present the lowest rank is merged, everywhere from the left, until none is left."""
    seq = list(text.encode())
    while len(seq) > 1:
        best = min(set(zip(seq, seq[1:], strict=False)), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        seq = _merge(seq, best, FIRST + ranks[best])
    return seq


def encode(df: DataFrame, text: str, merges: list[Merge], out: str = "ids") -> DataFrame:
    """df with token ids of a text column; null has none. One Arrow pass; a merge may only refer to ids before it."""
    ranks = {m: i for i, m in enumerate(merges)}
    vocabulary(merges)

    @F.arrow_udf("array<int>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        for texts in batches:
            if len(merges) <= BATCH_MERGES:
                x = _flat([t or "" for t in texts.to_pylist()])
                for i, m in enumerate(merges):
                    x = _merge_all(x, m, FIRST + i)
                ends = np.flatnonzero(x < 0)
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends - np.arange(len(ends))]), pa.int32()), pa.array(x[x >= 0], pa.int32()))
                continue
            rows = []
            for t in texts.to_pylist():
                t = t or ""
                ids = known.get(t)
                if ids is None:
                    ids = encode_ids(t, ranks)
                    if len(t) < 256 and len(known) < 100_000:
                        known[t] = ids
                rows.append(ids)
            yield pa.array(rows, pa.list_(pa.int32()))

    return df.withColumn(out, f(F.col(text)))


def vocabulary(merges: list[Merge]) -> list[bytes | None]:
    """Bytes of every id; role tokens have none."""
    out: list[bytes | None] = [bytes([i]) for i in range(256)] + [None] * (FIRST - 256)
    for i, (a, b) in enumerate(merges):
        if not all(0 <= x < FIRST + i and out[x] is not None for x in (a, b)):
            raise ValueError(f"merge {i} refers to an id that isn't there")
        out.append(out[a] + out[b])
    return out


def decode_ids(ids: list[int], vocab: list[bytes | None]) -> str:
    """Text of ids; role tokens and unknown ids are left out, malformed bytes become U+FFFD."""
    return b"".join(vocab[i] or b"" for i in ids if 0 <= i < len(vocab)).decode("utf-8", "replace")


def decode(df: DataFrame, ids: str, merges: list[Merge], out: str = "text") -> DataFrame:
    vocab = vocabulary(merges)

    @F.arrow_udf("string")
    def f(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode_ids(x, vocab) for x in column.to_pylist()], pa.string())

    return df.withColumn(out, f(F.col(ids)))


def artifact(merges: list[Merge]) -> dict:
    """A vocabulary as a document that carries its own hash."""
    body = {"kind": "byte_bpe", "merges": [list(m) for m in merges]}
    return body | {"sha256": canonical_hash(body)}


def training_report(merges: list[Merge], stopped: str, config: dict, texts: DataFrame, text: str = "text") -> dict:
    """What goes beside an artifact: how it was trained, and on how much."""
    n = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return {"config": config, "summary": {"texts": n.texts, "training_bytes": n.bytes, "merges": len(merges), "vocab_size": FIRST + len(merges), "stopped": stopped, "sha256": artifact(merges)["sha256"]}}


def load_artifact(doc: dict) -> list[Merge]:
    body = {k: v for k, v in doc.items() if k != "sha256"}
    if doc.get("kind") != "byte_bpe" or canonical_hash(body) != doc.get("sha256"):
        raise ValueError("not a vocabulary, or changed since it was written")
    merges = [tuple(m) for m in doc["merges"]]
    vocabulary(merges)
    return merges
