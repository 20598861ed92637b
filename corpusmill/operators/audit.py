"""The dataset audit: counters, lengths, splits, warnings and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, unit_interval
from ..functions.text import fingerprint_text
from ..session import cut
from ..sources.conversations import normalized_split
from .dedup import normalized_content
from .validate import group_key, with_reasons


def check_fractions(train: float, val: float, test: float, slack: float = 1e-9, needs_train: bool = True) -> None:
    if min(train, val, test) < 0 or abs(train + val + test - 1) > slack or (needs_train and train <= 0):
        raise ValueError("split fractions must be non-negative, sum to 1 and leave rows to train on")


def assigned(unit: Column, declared: Column | None, train: float, val: float) -> Column:
    """train, val or test from a unit interval; a usable declared split wins where one is given."""
    by_hash = F.when(unit < train, "train").when(unit < train + val, "val").otherwise("test")
    return by_hash if declared is None else F.when(declared.isin("train", "val", "test"), declared).otherwise(by_hash)


def with_split(rows: DataFrame, seed: int = 1337, train: float = 0.9, val: float = 0.05, test: float = 0.05, respect_declared: bool = False, group_aware: bool = True) -> DataFrame:
    """rows with content_hash, group_key and assigned_split. All rows of a group share a split; a row keeps its own for ever."""
    check_fractions(train, val, test)
    r = rows.withColumn("content_hash", content_hash("system", "user", "assistant"))
    if group_aware:  # parsed once, not for each key
        r = r.withColumn("_metadata", F.try_parse_json("metadata_json")).withColumn("group_key", group_key(F.col("content_hash"), F.col("_metadata"))).drop("_metadata")
    else:
        r = r.withColumn("group_key", F.col("content_hash"))
    return r.withColumn("assigned_split", assigned(unit_interval("group_key", seed), normalized_split("split") if respect_declared else None, train, val))


def summary(rows: DataFrame, **split) -> DataFrame:
    """The audit's counters over rows, in one row. Duplicates are looked for among accepted rows, ids among all."""
    placed = with_split(with_reasons(rows), **split)
    # the texts are read once: what is written and counted are lines, reasons and hashes
    marked = cut(placed.select("line", "reasons", "content_hash", F.col("assigned_split").alias("split"), F.sha2(fingerprint_text(normalized_content()), 256).alias("text_hash")))
    has = lambda reason: F.count_if(F.array_contains("reasons", reason))
    every = marked.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.size("reasons") == 0).alias("accepted_rows"),
        F.count_if(F.size("reasons") > 0).alias("rejected_rows"),
        has("empty_user").alias("empty_user_rows"),
        has("empty_assistant").alias("empty_assistant_rows"),
        has("oversized_field").alias("oversized_field_rows"),
        has("invalid_metadata_json").alias("invalid_metadata_rows"),
        has("duplicate_id").alias("duplicate_ids"),
    )
    h = marked.where(F.size("reasons") == 0)
    exact = h.groupBy("text_hash").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_content_rows"))
    # of each content, all rows but those in its first row's split
    parts = h.groupBy("content_hash", "split").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    crosses = parts.groupBy("content_hash").agg((F.sum("n") - F.min_by("n", "line")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cross_split_duplicate_rows"))
    by_split = h.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")])
    one = every
    for other in (exact, crosses, by_split):  # each a single row
        one = one.withColumn("_", F.lit(0)).join(other.withColumn("_", F.lit(0)), "_").drop("_")
    return one


def counters(good: DataFrame) -> DataFrame:
    """(counter, key, rows) of assigned and declared split, family and difficulty; blank is `unspecified`. One shuffle for all."""
    kinds = {"split": F.col("assigned_split"), "declared_split": normalized_split("split"), "task_family": F.col("task_family"), "difficulty": F.col("difficulty")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.when(v == "", "unspecified").otherwise(v).alias("key")) for k, v in kinds.items()]))
    return good.select(pairs.alias("x")).groupBy("x.counter", "x.key").agg(F.count("*").alias("rows"))


def lengths(good: DataFrame) -> DataFrame:
    """(field, count, minimum, maximum, mean, p50, p90, p99) in code points, quantiles interpolated, over all rows."""
    n = {"system_chars": F.length("system"), "user_chars": F.length("user"), "assistant_chars": F.length("assistant")}
    n["combined_chars"] = n["system_chars"] + n["user_chars"] + n["assistant_chars"]
    x = good.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("n")) for k, v in n.items()])).alias("x")).select("x.field", "x.n")
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return x.groupBy("field").agg(F.count("*").alias("count"), F.min("n").cast("long").alias("minimum"), F.max("n").cast("long").alias("maximum"), F.avg("n").alias("mean"), q[0].alias("p50"), q[1].alias("p90"), q[2].alias("p99"))


def warnings(audit: DataFrame, respect_declared: bool = False) -> DataFrame:
    """(warning) of a one-row audit."""
    w = F.array_compact(
        F.array(
            F.when(F.col("cross_split_duplicate_rows") > 0, "Content occurs in more than one split."),
            F.when(F.lit(respect_declared) & (F.col("val_rows") + F.col("test_rows") == 0), "Declared splits leave no validation or test rows."),
            F.when(F.col("accepted_rows") == 0, "No row was accepted."),
        )
    )
    return audit.select(F.explode(w).alias("warning"))


def manifest(audit: DataFrame, limitations: int = 1) -> DataFrame:
    """The audit's row with `valid`: its split counts add up to the accepted rows and a limitation is stated."""
    return audit.withColumn("valid", (F.col("train_rows") + F.col("val_rows") + F.col("test_rows") == F.col("accepted_rows")) & F.lit(limitations >= 1))


def compile_gate(audit: DataFrame, allow_cross_split: bool = False) -> DataFrame:
    """(passes, failures): whether rejects, cross-split duplicates or an empty training split stand in the way."""
    f = F.array_compact(
        F.array(
            F.when(F.col("rejected_rows") > 0, "rejected_rows"),
            F.when((F.col("cross_split_duplicate_rows") > 0) & F.lit(not allow_cross_split), "cross_split_duplicates"),
            F.when(F.col("train_rows") == 0, "empty_train"),
        )
    )
    return audit.select((F.size(f) == 0).alias("passes"), F.array_join(f, ",").alias("failures"))
