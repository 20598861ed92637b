"""Problem 7: documents placed in containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY, OPEN_WINDOWS, FAN_IN, MOST_TASKS = 4096, 64, 16, 20_000
_SCHEMA = "container long, container_piece int, doc_id long, piece int, start long, tokens long, closed boolean"


class Windows:
    """At most `most` open containers. Items go where least room is left over; the fullest leaves when none fits."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # (free, number), sorted
        self.items: dict[int, list] = {}
        self.made = 0

    def place(self, size: int, items: list) -> list | None:
        """Puts items of `size` tokens together somewhere; a container that had to leave, if one had."""
        left = None
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            free, k = self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                left = self.items.pop(self.open.pop(0)[1])
            free, k = self.capacity, self.made
            self.made += 1
            self.items[k] = []
        self.items[k] += items
        if free > size:
            insort(self.open, (free - size, k))
        else:
            left = (left or []), self.items.pop(k)
            return [*([left[0]] if left[0] else []), left[1]]
        return [left] if left else None


def _rows(containers: list[list], closed: bool) -> Iterator[pa.RecordBatch]:
    rows = [(*min((x[0], x[1]) for x in items), *x, closed) for items in containers for x in items]
    for i in range(0, len(rows), 8192):
        part = rows[i : i + 8192]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate(kinds)], ["container", "container_piece", "doc_id", "piece", "start", "tokens", "closed"])


def packed(documents: DataFrame, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS) -> DataFrame:
    """(container, container_piece, doc_id, piece, start, tokens): which tokens of which document lie in which container.

    Sizes are tokens of the byte tokenizer (UTF-8 bytes of text). Bounded-space best fit in each partition:
    `windows` containers are open, an item goes where the least room stays, the fullest is emitted when none fits.
    The windows still open at the end are merged over rounds, FAN_IN of the partitions that the first pass really had
    into one each time, down to one, whatever the session's shuffle width is: as whole units that are again placed
    best-fit, group by group, so no task ever holds more than FAN_IN * windows of them. A document is
    split only if it is longer than a container: into full pieces and a rest. A container is named by the least
    document and piece in it, so a recomputed task names it alike. Null and empty texts take no room and are in no
    container. Repeated doc_ids must not occur; other columns are ignored.
    """
    sizes = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens")).where("tokens > 0")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(capacity, windows)
        for b in batches:
            full: list[list] = []
            for doc, n in zip(b.column("doc_id").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                piece, start = 0, 0
                while n - start > capacity:
                    full.append([(doc, piece, start, capacity)])
                    piece, start = piece + 1, start + capacity
                if out := w.place(n - start, [(doc, piece, start, n - start)]):
                    full += out
            yield from _rows(full, True)
        yield from _rows(list(w.items.values()), False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, units = None, {}

        def merged() -> Iterator[pa.RecordBatch]:
            w, full = Windows(capacity, windows), []
            for _, items in sorted(units.items(), key=lambda x: (-sum(i[3] for i in x[1]), x[0])):
                if out := w.place(sum(i[3] for i in items), items):
                    full += out
            for rows in (_rows(full, True), _rows(list(w.items.values()), False)):
                for r in rows:
                    yield r.append_column("part", pa.array([group] * r.num_rows, pa.int32()))

        for b in batches:
            for c, cp, doc, piece, start, n, part in zip(*(b.column(x).to_pylist() for x in ("container", "container_piece", "doc_id", "piece", "start", "tokens", "part")), strict=True):
                if part != group:
                    yield from merged()
                    group, units = part, {}
                units.setdefault((c, cp), []).append((doc, piece, start, n))
        yield from merged()

    out = cut(sizes.mapInArrow(first, _SCHEMA).withColumn("part", F.spark_partition_id()))
    done, left = [out.where("closed")], out.where("not closed")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        grouped = left.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part")
        out = cut(grouped.mapInArrow(again, _SCHEMA + ", part int"))
        done.append(out.where("closed"))
        left = out.where("not closed")
        if parts == 1:
            break
    for x in done:
        left = left.unionByName(x)
    return left.drop("closed", "part")


def packing_summary(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of unused space (0 without containers) and the least containers that could hold them."""
    c = containers.groupBy("container", "container_piece").agg(F.sum("tokens").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return c.agg(F.count("*").alias("containers"), total.alias("tokens"), F.max("n").alias("fullest"), F.coalesce(1 - F.try_divide(total, F.count("*") * capacity), F.lit(0.0)).alias("unused_share"), F.ceil(total / capacity).alias("least_containers"))
