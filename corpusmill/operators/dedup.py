"""Exact, near and cross-split duplicates of texts, and the leakage manifest."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import simhash
from ..functions.text import casefold, fingerprint_text
from ..session import cut

#: Distinct fingerprints of a bucket that one task meets with as many others.
BUCKET_BLOCK = 20_000


def normalized_content() -> Column:
    """System, user and assistant joined by line breaks."""
    return F.concat_ws("\n", "system", "user", "assistant")


def firsts(rows: DataFrame, key: str, *keep: str, line: str = "line") -> DataFrame:
    """(key, first_line, n, first_<keep>...): each key's first row, pre-aggregated, so a hot key is one partial row a task."""
    return rows.groupBy(key).agg(F.min(line).alias("first_line"), F.count("*").alias("n"), *[F.min_by(k, line).alias(f"first_{k}") for k in keep])


def _hashed(rows: DataFrame, text: Column | None, *more: Column) -> DataFrame:
    """(line, text_hash, more), written: the texts are read once."""
    return cut(rows.select("line", F.sha2(fingerprint_text(normalized_content() if text is None else text), 256).alias("text_hash"), *more))


def exact_duplicates(rows: DataFrame, text: Column | None = None, *more: Column) -> DataFrame:
    """(line, text_hash, exact_of, more): exact_of is the first line of the same words in the same order, null on that line.

    Case, punctuation, spacing and field borders don't count; texts without words are equal to each other. Null
    texts count as empty. The texts are read once: what is kept and joined are lines and hashes.
    """
    h = _hashed(rows, text, *more)
    return _with_first(h, firsts(h.select("line", "text_hash"), "text_hash"))


def _with_first(h: DataFrame, first: DataFrame) -> DataFrame:
    f = first.where("n > 1").select("text_hash", "first_line")
    return h.join(f, "text_hash", "left").withColumn("exact_of", F.when(F.col("line") > F.col("first_line"), F.col("first_line"))).drop("first_line")


def _keys(bits: int, distance: int) -> list[Column]:
    """Bucket keys of a fingerprint `fp` of that many bits.

    Up to distance 3: of five blocks two stay whole, so every pair of blocks is a key; nothing is lost and keys have
    two fifths of the bits. Beyond: the four bands of the classic index, which may lose pairs, as that index does.
    """
    if distance <= 3:
        cut = [round(i * bits / 5) for i in range(6)]
        block = [F.expr(f"shiftright(fp, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(cut, cut[1:], strict=False)]
        return [F.shiftleft(block[i], 16).bitwiseOR(block[j]) for i, j in combinations(range(5), 2)]
    w = bits // 4
    return [F.expr(f"shiftright(fp, {i * w}) & {(1 << w) - 1}L") for i in range(4)]


def near_duplicates(rows: DataFrame, distance: int = 3, family: str = "blake2b", fold: str = "casefold", text: Column | None = None) -> DataFrame:
    """(line, text_hash, exact_of, fp, near_of): near_of is the least line before whose fingerprint differs in at most `distance` bits.

    Exact duplicates match nothing and are matched by nothing. Equal fingerprints are settled by an aggregate, so
    only distinct ones meet: an equi-join on bucket keys whose residue checks order and distance in the JVM. A bucket of
    more than BUCKET_BLOCK fingerprints is a grid of cells, so it is neither capped nor one task's work. With 0..16
    bits of distance; null texts count as empty, whose fingerprint is 0.
    """
    if not 0 <= distance <= 16:
        raise ValueError("distance must be between 0 and 16")
    bits = 64 if family == "blake2b" else 60
    h = _hashed(rows, text, simhash(family, fold)(normalized_content() if text is None else text).alias("fp"))
    texts = cut(firsts(h, "text_hash", "fp").withColumnRenamed("first_fp", "fp"))
    one = cut(texts.groupBy("fp").agg(F.min("first_line").alias("first")))
    before = _met(one, _keys(bits, distance), distance).groupBy("fp").agg(F.min("other").alias("other"))
    named = texts.join(one, "fp").join(before, "fp", "left").select(F.col("first_line").alias("line"), F.least("other", F.when(F.col("first_line") > F.col("first"), F.col("first"))).alias("near_of"))
    return _with_first(h, texts).join(cut(named.where("near_of is not null")), "line", "left")


def _met(one: DataFrame, keys: list[Column], distance: int) -> DataFrame:
    """(fp, other): for each fingerprint the first lines before its own of those in a bucket with it that are near."""
    named = F.array(*[F.lit(k << 40).bitwiseOR(c.cast("long")) for k, c in enumerate(keys)])
    b = one.select(F.explode(named).alias("key"), "fp", "first")
    hot = cut(b.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_BLOCK).select("key", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("parts")))
    on, x = ["key"], b
    y = b.select("key", F.col("fp").alias("fp0"), F.col("first").alias("other"))
    if not hot.isEmpty():
        b = b.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        on, x = ["key", "i", "j"], b.select("key", "fp", "first", F.col("own").alias("i"), every.alias("j"))
        y = b.select("key", F.col("fp").alias("fp0"), F.col("first").alias("other"), F.col("own").alias("j"), every.alias("i"))
    return x.join(y, on).where("other < first").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))) <= distance).select("fp", "other")


def cross_split(rows: DataFrame, key: str = "content_hash", split: str = "split") -> DataFrame:
    """rows with `crosses`: whether the first row of the same content lies in another split. Best called on few columns."""
    rows = cut(rows)
    f = firsts(rows, key, split).where("n > 1").select(key, F.col(f"first_{split}").alias("_first"))
    return rows.join(f, key, "left").withColumn("crosses", F.coalesce(F.col("_first") != F.col(split), F.lit(False))).drop("_first")


def duplicate_rate(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, duplicates and their share."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return n.select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"), F.when(F.col("rows") > 0, (F.col("rows") - F.col("distinct_rows")) / F.col("rows")).otherwise(0.0).alias("duplicate_rate"))


def leakage_status(scan: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """scan(line, hash, split, ...) with `status` against the manifest(hash, split) and the scan's own earlier lines.

    new: the hash was not seen; known_same_split: seen in this split; cross_split_duplicate: seen in others only.
    """
    scan = cut(scan)  # lines, hashes and splits, which are used three times
    per = firsts(scan.select("line", "hash", "split"), "hash").select("hash", F.col("first_line").alias("_h"))
    both = scan.groupBy("hash", "split").agg(F.min("line").alias("_hs"))
    r = scan.join(per, "hash").join(both, ["hash", "split"])
    if manifest is not None:
        r = r.join(manifest.select("hash", "split", F.lit(True).alias("_same")).distinct(), ["hash", "split"], "left").join(manifest.select("hash", F.lit(True).alias("_any")).distinct(), "hash", "left")
    else:
        r = r.withColumn("_same", F.lit(None).cast("boolean")).withColumn("_any", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("_same") | (F.col("line") > F.col("_hs")), "known_same_split").when(F.col("_any") | (F.col("line") > F.col("_h")), "cross_split_duplicate").otherwise("new")
    )
    return r.withColumn("status", status).drop("_h", "_hs", "_same", "_any")


def leakage_manifest(scan: DataFrame, seen: str) -> DataFrame:
    """(hash, splits, tasks, first_seen, last_seen): one entry a payload; its task ids stay rows of the scan, which has no bound."""
    return scan.groupBy("hash").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count("*").alias("tasks"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def folded(c: str) -> Column:
    """Case-folded text, where parity with full case folding matters."""
    return casefold(F.col(c))
