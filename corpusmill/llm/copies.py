"""Problem 5: records that differ in formatting only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width


def letters_only(col: str) -> Column:
    """The letters and digits of a text, without case (ß counts as ss); null is empty."""
    return F.regexp_replace(F.lower(F.upper(F.coalesce(col, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def canonical(chat: DataFrame) -> DataFrame:
    """(key, row_id): both texts' letters and digits, the lesser text first, so the order of the fields doesn't count."""
    k = chat.select("row_id", letters_only("user_text").alias("u"), letters_only("assistant_text").alias("a"))
    return k.select(F.concat_ws("|", F.least("u", "a"), F.greatest("u", "a")).alias("key"), "row_id")


def _runs(chat: DataFrame) -> DataFrame:
    """(low, row_id, key): low is the smallest row_id of the record's run in its partition.

    Records are range-partitioned by their key's hash and row_id and sorted by hash, key and row_id, with Spark's
    external sort, then adjacent full keys are compared. The range takes in row_id, so a run of any length is spread
    over partitions instead of filling one task; and what is sampled to find the ranges are numbers, not texts. A row
    with a key tells the key and low of a run of the partition's first or last hash, which may go on next door, and
    has no row_id. Rows stream through: only the runs of one hash are remembered, never their rows.
    """
    n = shuffle_width(chat.sparkSession)
    k = canonical(chat).withColumn("h", F.xxhash64("key"))
    ordered = k.repartitionByRange(n, "h", "row_id").sortWithinPartitions("h", "key", "row_id")

    def batch(low: list[int], ids: list[int | None], keys: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["low", "row_id", "key"])

    def edges(runs: list[tuple[str, int]]) -> pa.RecordBatch:
        return batch([low for _, low in runs], [None] * len(runs), [key for key, _ in runs])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        runs: list[tuple[str, int]] = []  # (key, low) of the hash that is being read
        first = True
        for b in batches:
            low, ids = [], b.column("row_id").to_pylist()
            for h, key, r in zip(b.column("h").to_pylist(), b.column("key").to_pylist(), ids, strict=True):
                if h != at:
                    if first and runs:
                        yield edges(runs)
                        first = False
                    at, runs = h, []
                if not runs or runs[-1][0] != key:
                    runs.append((key, r))
                low.append(runs[-1][1])
            yield batch(low, ids, [None] * len(ids))
        if runs:
            yield edges(runs)

    return ordered.mapInArrow(scan, "low long, row_id long, key string")


def formatting_copies(chat: DataFrame) -> DataFrame:
    """(kept_id, row_id) of every record in chat: kept_id is the smallest row_id among its copies (itself if none).

    Runs inside a partition are settled there. A run that crosses a border is settled by the minimum over its parts,
    of which there are at most two hashes a partition: that table is broadcast (bound: twice the number of partitions,
    never the number of rows). Null and empty texts count as empty, so records without any letter or digit are copies
    of each other; ties keep the smallest row_id, which must be unique.
    """
    runs = _runs(chat)
    parts = runs.where("row_id is null").select("key", "low")
    moved = parts.join(parts.groupBy("key").agg(F.min("low").alias("kept")), "key").where("kept < low").select("low", "kept").distinct()
    return runs.where("row_id is not null").select("low", "row_id").join(F.broadcast(moved), "low", "left").select(F.coalesce("kept", "low").alias("kept_id"), "row_id")


def representatives(chat: DataFrame) -> DataFrame:
    """(kept_id, copies): one record of each, with the number of records it stands for."""
    return formatting_copies(chat).groupBy("kept_id").agg(F.count("*").alias("copies"))
