"""Problem 6: rows that fail to parse, beside the rows that load."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values: the fields of a record, in order, and the spellings of the splits
FIELDS = ("id", "split", "task_family", "difficulty", "system", "user", "assistant", "answer_format", "eval_type", "metadata_json")
SPLITS = {"train": "train", "training": "train", "val": "val", "validation": "val", "valid": "val", "dev": "val", "test": "test", "testing": "test"}
REASONS = ("quoting", "column_count", "empty_user", "empty_assistant", "unknown_split", "invalid_metadata")

_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"(?=,|\Z)')
_BARE = re.compile(r'[^",]*(?=,|\Z)')


def split_record(line: str) -> list[str] | None:
    """Fields of one record, or None if a double quote neither encloses a whole field nor stands doubled in one."""
    if '"' not in line:
        return line.split(",")
    out, at = [], 0
    while True:
        m = _QUOTED.match(line, at)
        if m:
            out.append(m.group(1).replace('""', '"'))
        elif m := _BARE.match(line, at):
            out.append(m.group())
        else:
            return None
        at = m.end()
        if at == len(line):
            return out
        at += 1


def _no_constant(name: str) -> None:
    raise ValueError(name)


def strict_object(text: str) -> bool:
    """Whether text is a JSON object by the strict grammar (no NaN or Infinity)."""
    try:
        return isinstance(json.loads(text, parse_constant=_no_constant), dict)
    except (ValueError, RecursionError):
        return False


def diagnose(line: str | None, max_columns: int = len(FIELDS)) -> tuple[list[str] | None, str | None]:
    """(fields, None) of a conforming record, else (None, the first reason that applies)."""
    fields = split_record(line or "")
    if fields is None:
        return None, "quoting"
    if len(fields) != max_columns:
        return None, "column_count"
    row = dict(zip(FIELDS, fields, strict=True))
    split = row["split"].strip().lower()
    if not row["user"].strip():
        return None, "empty_user"
    if not row["assistant"].strip():
        return None, "empty_assistant"
    if split and split not in SPLITS:
        return None, "unknown_split"
    if row["metadata_json"].strip() and not strict_object(row["metadata_json"]):
        return None, "invalid_metadata"
    return fields, None


def strict_load(raw: DataFrame) -> DataFrame:
    """(raw_id, the ten fields) of the conforming records of raw(raw_id, raw_line, ...); one narrow pass.

    Fields come out as written, without their enclosing quotes; the split is not yet normalised. A record may
    hold line breaks inside quotes and be of any length. A null line is an empty record, which doesn't conform.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rows = [], []
            for i, line in enumerate(b.column("raw_line").to_pylist()):
                fields, _ = diagnose(line)
                if fields:
                    keep.append(i)
                    rows.append(fields)
            cols = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column("raw_id").take(pa.array(keep, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], ["raw_id", *FIELDS])

    return raw.select("raw_id", "raw_line").mapInArrow(load, "raw_id long, " + ", ".join(f"`{f}` string" for f in FIELDS))


def rejected(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """raw's records that `loaded` lacks, with the reason: an anti-join on raw_id, then a diagnosis of the remainder.

    All columns of raw but raw_line are kept (a column named `reason` is replaced). Repeated records are separate
    rows as long as their raw_id differs. Empty tables give no rows.
    """
    keep = [c for c in raw.columns if c not in ("raw_line", "reason")]
    left = raw.select(*keep, "raw_line").join(loaded.select("raw_id"), "raw_id", "left_anti").select(*keep, "raw_line")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema if f.name in keep)

    def why(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([diagnose(x)[1] for x in b.column("raw_line").to_pylist()], pa.string())], [*keep, "reason"])

    return left.mapInArrow(why, schema + ", reason string").where("reason is not null")
