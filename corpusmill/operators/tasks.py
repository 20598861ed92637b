"""Algorithmic tasks: their answers as array expressions, and seeded generators."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_column
from .encode import IGNORE, in_batches, pad_batches

TASKS = ("copy", "reverse", "parity", "modular_addition", "sorting", "selective_copy", "associative_recall", "bracket_balance", "finite_state_parity")
OPEN, CLOSE = 24, 25


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda s, x: s + x)


def is_balanced(tokens: Column | str, opening: int = OPEN, closing: int = CLOSE) -> Column:
    """Whether brackets match: the depth never falls below 0 and ends at 0; other tokens don't count."""
    start = F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok"))
    step = lambda a, x: F.struct((a["d"] + F.when(x == opening, 1).when(x == closing, -1).otherwise(0)).alias("d"), (a["ok"] & (a["d"] + F.when(x == opening, 1).when(x == closing, -1).otherwise(0) >= 0)).alias("ok"))
    end = F.aggregate(as_column(tokens), start, step)
    return end["ok"] & (end["d"] == 0)


def answer(task: str, v: Column | str) -> Column:
    """The answer to a task whose input is an array of ints.

    selective_copy reads (selector, value) pairs, associative_recall (key, value) pairs and a last key,
    modular_addition left, right and modulus.
    """
    v = as_column(v)
    pairs = lambda n: F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda i: F.struct(F.get(v, 2 * i).alias("k"), F.get(v, 2 * i + 1).alias("v")))
    match task:
        case "copy":
            return v
        case "reverse":
            return F.reverse(v)
        case "parity":
            return F.array(total(v) % 2)
        case "modular_addition":
            return F.array((F.get(v, F.lit(0)) + F.get(v, F.lit(1))) % F.get(v, F.lit(2)))
        case "sorting":
            return F.array_sort(v)
        case "selective_copy":
            return F.transform(F.filter(pairs(F.size(v)), lambda p: p["k"] == 1), lambda p: p["v"])
        case "associative_recall":
            return F.slice(F.transform(F.filter(pairs(F.size(v) - 1), lambda p: p["k"] == F.element_at(v, -1)), lambda p: p["v"]), 1, 1)
        case "bracket_balance":
            return F.array(is_balanced(v).cast("int"))
        case "finite_state_parity":
            return F.array(total(F.transform(v, lambda x: x % 2)) % 2)
    raise ValueError(f"no task {task!r}")


def draw_input(task: str, length: int, rng: random.Random) -> list[int]:
    """An input of the given length by CPython's generator, so a seed fixes it."""
    if length < 1:
        raise ValueError("length must be positive")
    some = lambda n, below=16: [rng.randrange(below) for _ in range(n)]
    match task:
        case "parity":
            return some(length, 2)
        case "modular_addition":
            m = max(2, min(16, length + 2))
            return [*some(2, m), m]
        case "sorting":
            return some(length, min(16, max(2, length)))
        case "selective_copy":
            values, picks = some(length), some(length, 2)
            if not any(picks):
                picks[rng.randrange(length)] = 1
            return [x for p in zip(picks, values, strict=True) for x in p]
        case "associative_recall":
            keys = rng.sample(range(16), k=min(max(2, length), 16))
            values = some(len(keys))
            return [x for p in zip(keys, values, strict=True) for x in p] + [rng.choice(keys)]
        case "bracket_balance":
            n, depth, out = max(1, length // 2) * 2, 0, []
            for i in range(n):
                up = depth == 0 or (depth < n - i and rng.randrange(2) == 0)
                out.append(OPEN if up else CLOSE)
                depth += 1 if up else -1
            if rng.randrange(2):
                k = rng.randrange(n)
                out[k] = OPEN + CLOSE - out[k]
            return out
        case "finite_state_parity":
            return some(length, 4)
    return some(length)


def generate(spark: SparkSession, task: str, n: int, length: int, seed: int) -> DataFrame:
    """(example, task, prompt, answer) of n examples; example i has its own generator, so any task may make it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([draw_input(task, length, random.Random(f"{seed}:{task}:{i}")) for i in ids.to_pylist()], pa.list_(pa.int32()))], ["example", "prompt"])

    x = spark.range(n).mapInArrow(run, "example long, prompt array<int>")
    return x.withColumn("task", F.lit(task)).withColumn("answer", answer(task, "prompt"))


def encoded(examples: DataFrame, max_length: int) -> DataFrame:
    """examples(prompt, answer, ...) with input_ids and labels, which are IGNORE up to the answer; longer ones are an error."""
    ids = F.concat("prompt", "answer")
    n = F.when(F.size(ids) > max_length, F.raise_error(F.concat(F.lit("an example requires "), F.size(ids).cast("string"), F.lit(f" positions of {max_length}"))).cast("int")).otherwise(F.size(ids))
    return examples.withColumn("input_ids", F.slice(ids, 1, n)).withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORE), F.size("prompt")), F.col("answer")))


def collated(examples: DataFrame, max_length: int, size: int, order: str = "example", pad: int = 0) -> DataFrame:
    """Encoded examples in batches of `size` by order, padded to their batch's longest, with attention_mask."""
    return pad_batches(in_batches(encoded(examples, max_length), size, order), pad)
