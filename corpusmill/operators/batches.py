"""Batches of a split in file order, with epochs, and a state from which they go on exactly."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import ordinals

FORMAT = 3
#: What each format of a saved state must agree in; a later format takes in the earlier ones.
AGREE = {
    1: ("split", "batch_size", "max_length", "max_rows"),
    2: ("split_spec", "tokenizer_manifest_hash", "repeat", "drop_last", "assistant_only_loss"),
    3: ("shuffle_buffer_size", "shuffle_seed", "pack_sequences"),
}


@dataclass
class State:
    """Where a stream stands: rows of the epoch that were read, of which so many were in the split, and totals."""

    epoch: int = 0
    row_cursor: int = 0
    matches_in_epoch: int = 0
    batches_emitted: int = 0
    examples_emitted: int = 0


class Batches:
    """The rows of a split in the order of a unique column, `batch_size` at a time, epoch after epoch.

    rows(order, assigned_split, ...): all rows of a source; max_rows keeps its first ones, counted over all splits.
    Positions are found once, by a range sort that gathers nothing; after that a batch is a filter on positions, the
    same however often it is asked for, and the state is five numbers. repeat: epochs follow each other, and a batch
    may take its rows from two; else the last batch may be short, or falls away with drop_last. config holds whatever
    else must be as it was when a state is loaded (see AGREE); fingerprint names the source.
    """

    def __init__(self, rows: DataFrame, split: str, batch_size: int, fingerprint: str, *, order: str = "line", max_rows: int | None = None, repeat: bool = True, drop_last: bool = False, **config):
        if batch_size < 1 or (max_rows is not None and max_rows < 1):
            raise ValueError("batch_size and max_rows must be positive")
        self.rows, self.order, self.split, self.size, self.repeat, self.drop_last, self.fingerprint = rows, order, split, batch_size, repeat, drop_last, fingerprint
        self.config = {"split": split, "batch_size": batch_size, "max_rows": max_rows, "repeat": repeat, "drop_last": drop_last} | {k: config.get(k) for ks in AGREE.values() for k in ks if k not in ("split", "batch_size", "max_rows", "repeat", "drop_last")}
        at = ordinals(rows.select(order, F.coalesce("assigned_split", F.lit("")).alias("_split")), order, "row")
        if max_rows is not None:
            at = at.where(F.col("row") < max_rows)
        self.total = at.count()
        self.places = ordinals(at.where(F.col("_split") == split).select("row", order), "row", "match")
        self.matches = self.places.count()
        self.state = State()

    def take(self, batches: int) -> DataFrame:
        """(batch, slot, epoch, the rows' columns) of the next batches, fewer at the end of a stream that doesn't repeat; the state moves on."""
        if self.repeat and not self.matches:
            raise RuntimeError("no readable rows" if not self.total else f"no rows for split {self.split!r}")
        s, start = self.state, self.state.matches_in_epoch
        n = batches * self.size
        if not self.repeat:
            n = min(n, self.matches - start)
            if self.drop_last:
                n -= n % self.size
        # position p of the epochs' endless row of matches holds match p mod matches
        at = self.places.withColumn("_k", F.explode(F.sequence(F.ceil((F.lit(start) - F.col("match")) / max(self.matches, 1)).cast("long"), F.floor((F.lit(start + n - 1) - F.col("match")) / max(self.matches, 1)).cast("long"))) if n > 0 else F.lit(0)).where(F.lit(n > 0))
        p = F.col("_k") * self.matches + F.col("match") - start
        placed = at.where((p >= 0) & (p < n)).select(self.order, (F.floor(p / self.size) + s.batches_emitted).cast("long").alias("batch"), F.pmod(p, F.lit(self.size)).cast("int").alias("slot"), (F.col("_k") + s.epoch).cast("int").alias("epoch"))
        self._move(n)
        return self.rows.join(placed, self.order).select("batch", "slot", "epoch", *self.rows.columns)

    def _move(self, n: int) -> None:
        if n < 1:
            return
        s, end = self.state, self.state.matches_in_epoch + n
        epochs, inside = divmod(end, self.matches) if self.repeat else (0, end)
        if self.repeat and inside == 0:  # an epoch ends when the next row is asked for
            epochs, inside = epochs - 1, self.matches
        row = self.places.where(F.col("match") == inside - 1).first()["row"]
        self.state = State(s.epoch + epochs, row + 1, inside, s.batches_emitted + -(-n // self.size), s.examples_emitted + n)

    def saved(self) -> dict:
        return {"format_version": FORMAT, "source_sha256": self.fingerprint, **self.config, "state": asdict(self.state)}

    def load(self, saved: dict) -> None:
        """Goes on from a saved state of format 1 to 3; another source or configuration is an error, as are unknown or negative counters."""
        version = saved.get("format_version")
        if version not in AGREE:
            raise ValueError("unsupported format of a stream's state")
        if saved.get("source_sha256") != self.fingerprint:
            raise ValueError("the source changed since the state was saved")
        for name in (k for v, ks in AGREE.items() if v <= version for k in ks):
            if saved.get(name) != self.config[name]:
                raise ValueError(f"{name} of the saved state is another")
        if version < 3 and ((self.config["shuffle_buffer_size"] or 0) > 1 or self.config["pack_sequences"]):
            raise ValueError("a state of an older format can't restore shuffling or packing")
        state = saved.get("state")
        if not isinstance(state, dict) or set(state) - set(asdict(State())):
            raise ValueError("counters are missing or unknown")
        new = State(**state)
        if min(asdict(new).values()) < 0:
            raise ValueError("counters cannot be negative")
        self.state = new
