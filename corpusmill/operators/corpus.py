"""The older one-text corpora: audit, inspection, samples; shuffles and generated hold-out tasks."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import row_hash
from ..functions.text import strip
from ..sources.conversations import ASSISTANT_COLUMNS, OLD_SPLITS, SYSTEM_COLUMNS, USER_COLUMNS
from .audit import assigned, check_fractions
from .grids import STEPS


def rendered(df: DataFrame, text: str, target: str | None = None) -> DataFrame:
    """df with `rendered`; rows whose rendering is empty fall away.

    A user and an assistant column are put in an envelope of SYSTEM, USER and ASSISTANT parts, each where it isn't
    empty, with the first system text that there is. Else it is the text, and the target under it if there is one.
    """
    full = lambda c: F.nullif(strip(c), F.lit(""))
    if target and text.lower() in USER_COLUMNS and target.lower() in ASSISTANT_COLUMNS:
        systems = [full(c) for name in SYSTEM_COLUMNS for c in df.columns if c.lower() == name]
        parts = {"SYSTEM": F.coalesce(*systems) if systems else F.lit(None).cast("string"), "USER": full(text), "ASSISTANT": full(target)}
        t = F.concat_ws("\n\n", *[F.concat(F.lit(f"{name}:\n"), c) for name, c in parts.items()])
    else:
        t = F.concat_ws("\n", full(text), full(target) if target else F.lit(None).cast("string"))
    return df.withColumn("rendered", t).where("rendered <> ''")


def declared(c: str):
    """train, val or test by the wider list of spellings; null if there is none."""
    s = F.lower(strip(c))
    out = None
    for k, v in OLD_SPLITS.items():
        out = F.when(s == k, v) if out is None else out.when(s == k, v)
    return out


def old_split(text: str, seed: int = 1337, train: float = 0.9, val: float = 0.05, test: float = 0.05):
    """(unit, split) columns by the unkeyed hash of seed and text over 2**64 - 1."""
    check_fractions(train, val, test, 1e-6, needs_train=False)
    h = row_hash(seed)(F.col(text))
    unit = (h.cast("decimal(20,0)") + F.when(h < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(0)).cast("double") / float(2**64 - 1)
    return unit, assigned(unit, None, train, val)


def audit(df: DataFrame, key: str = "rendered", declared_split: str | None = None) -> DataFrame:
    """One row: rows, characters and bytes with their extremes, declared and hashed splits, duplicate rows and rate.

    Duplicates are counted by groups of a SHA-256, pre-aggregated; nothing is gathered. Empty input gives zeros.
    """
    d = declared(declared_split) if declared_split else F.lit(None).cast("string")
    n = F.char_length(key)
    per = df.select(F.sha2(key, 256).alias("h"), n.alias("n"), F.octet_length(key).alias("b"), d.alias("d")).groupBy("h", "d").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    one = per.groupBy("h").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(F.when(F.coalesce("d", F.lit("unknown")) == s, F.col("rows")).otherwise(0)).alias(s) for s in ("train", "val", "test", "unknown")])
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    m = one.agg(z(F.sum("rows")).alias("nonempty_rows"), z(F.sum("n")).alias("total_chars"), z(F.sum("b")).alias("total_bytes"), z(F.min("lo")).alias("min_chars"), z(F.max("hi")).alias("max_chars"), *[z(F.sum(s)).alias(f"declared_{s}") for s in ("train", "val", "test", "unknown")], z(F.sum(F.col("rows") - 1)).alias("duplicate_rows"))
    return m.withColumn("duplicate_rate", F.coalesce(F.try_divide("duplicate_rows", "nonempty_rows"), F.lit(0.0)))


def inspection(df: DataFrame, order: str, key: str = "rendered", first: int = 1000) -> DataFrame:
    """Rows, mean and largest length of the first thousand rows by order: a look at a corpus, bounded by design."""
    x = df.orderBy(order).limit(first)
    return x.agg(F.count("*").alias("rows"), F.avg(F.char_length(key)).alias("mean_chars"), F.max(F.char_length(key)).alias("max_chars"))


def head_samples(df: DataFrame, split: str, order: str, n: int) -> DataFrame:
    """The first n rows by order of each split; each split's top-n is taken on its own, so no group is gathered."""
    out = None
    for s in ("train", "val", "test"):
        part = df.where(F.col(split) == s).orderBy(order).limit(n)
        out = part if out is None else out.union(part)
    return out


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """df in an order that seed and epoch fix: a range sort by hash. A different permutation from a bounded buffer's, but of any size."""
    return df.orderBy(shuffle_key(key, seed, epoch))


def shuffle_key(key: str, seed: int, epoch: int):
    """What an epoch's order sorts by: a hash of seed, epoch and key, then the key itself, as one string."""
    text = F.col(key).cast("string")
    return F.concat(F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), text), 256), text)


def buffered(items: Iterator, size: int, rng: random.Random) -> Iterator:
    """A buffered shuffle of one stream: each item drawn at random from the next `size`; all leave before the end."""
    held = []
    for x in items:
        held.append(x)
        if len(held) >= size:
            yield held.pop(rng.randrange(len(held)))
    while held:
        yield held.pop(rng.randrange(len(held)))


def buffer_shuffled(df: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """Each partition through its own buffered shuffle; needs the memory of `size` rows a task and no exchange."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        held, schema = [], None
        for r in buffered(rows, size, random.Random(f"{seed}:{epoch}")):
            held.append(r)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.select(*names).mapInArrow(run, df.schema)


HOLDOUT = ("rotate90", "rotate180", "mirror_x", "mirror_y", "scale_object")


def holdout_tasks(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(task_id, rule, train, test): hold-out grid tasks, the rule by id, sides 2 to 4, 3 to 6 colours.

    One pair to learn from and one to be tested on; task i has its own generator, so any task may make it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("input", pa.list_(pa.list_(pa.int32()))), ("output", pa.list_(pa.list_(pa.int32())))]))
        for b in batches:
            ids, rules, pairs = b.column("id").to_pylist(), [], ([], [])
            for i in ids:
                rng, side, colors = random.Random(f"{seed}:{i}"), 2 + i % 3, 3 + i % 4
                rules.append(HOLDOUT[i % 5])
                for part in pairs:
                    g = [[rng.randrange(colors) for _ in range(side)] for _ in range(side)]
                    part.append([{"input": g, "output": STEPS[rules[-1]](g)}])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rules, pa.string()), *(pa.array(p, kind) for p in pairs)], ["task_id", "rule", "train", "test"])

    grid = "array<array<int>>"
    pair = f"array<struct<input:{grid},output:{grid}>>"
    return spark.range(n).mapInArrow(run, f"task_id long, rule string, train {pair}, test {pair}")


def write_holdout(tasks: DataFrame, path: str, seed: int) -> None:
    """Task files: one JSON object a line with id, rule, train and test, written by all tasks at once."""
    name = F.format_string(f"synthetic_{seed}_%04d_%s", "task_id", "rule")
    tasks.select(F.to_json(F.struct(name.alias("id"), F.struct(F.col("rule").alias("transform"), F.lit(seed).alias("seed")).alias("meta"), "train", "test")).alias("value")).write.text(path)


def needle_cases(spark: SparkSession, n: int, length: int, seed: int, vocabulary: int = 64) -> DataFrame:
    """(case, prompt, answer): a key and its value hidden in filler, the key asked again at the end."""
    if length < 4:
        raise ValueError("length must be at least 4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts, answers = [], []
            for i in b.column("id").to_pylist():
                rng = random.Random(f"{seed}:{i}")
                key, value = vocabulary + rng.randrange(16), vocabulary + 16 + rng.randrange(16)
                p = [rng.randrange(vocabulary) for _ in range(length - 3)]
                at = rng.randrange(len(p) + 1)
                prompts.append([*p[:at], key, value, *p[at:], key])
                answers.append(value)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(prompts, pa.list_(pa.int32())), pa.array(answers, pa.int32())], ["case", "prompt", "answer"])

    return spark.range(n).mapInArrow(run, "case long, prompt array<int>, answer int")
