"""Compiled datasets: encoded examples by split, with summaries, checksums, random access and resumable order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import affine_order, canonical_hash, encode_chat, with_ordinal

SPLITS = ("train", "val", "test")


#: The columns of the shards.
SHARDS = "pos long, line long, input_ids array<int>, labels array<int>, target_token_count int, truncated boolean, raw_bytes int, target_bytes int, split string"


def split_summary(encoded: DataFrame) -> DataFrame:
    """By split: examples, tokens, truncated examples and bytes; a split without rows comes out with zeros."""
    return _summed(encoded, "assigned_split", F.octet_length("system") + F.octet_length("user") + F.octet_length("assistant"), F.octet_length("assistant"))


def _summed(encoded: DataFrame, split: str, raw: Column, target: Column) -> DataFrame:
    have = encoded.groupBy(F.col(split).alias("assigned_split")).agg(
        F.count("*").alias("examples"),
        F.sum(F.size("input_ids")).alias("input_tokens"),
        F.sum("target_token_count").cast("long").alias("target_tokens"),
        F.count_if("truncated").alias("truncated_examples"),
        F.sum(raw).alias("raw_utf8_bytes"),
        F.sum(target).alias("target_utf8_bytes"),
    )
    all_splits = encoded.sparkSession.createDataFrame([(s,) for s in SPLITS], "assigned_split string")
    counts = [c for c in have.columns if c != "assigned_split"]
    return all_splits.join(have, "assigned_split", "left").select(F.col("assigned_split").alias("split"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_compiled(good: DataFrame, path: str, max_length: int = 512, source: str | None = None, audit: dict | None = None) -> dict:
    """Encodes good(line, assigned_split, system, user, assistant), writes Parquet by split and a manifest; returns it.

    One pass: rows are encoded once, and the summary is taken from the Parquet just written. Everything goes to a
    sibling folder that is renamed at the end, so a failed run leaves nothing at `path`. source: the file or folder
    that the rows were read from, whose digest is kept; audit: its counters, which the manifest must agree with.
    """
    spark = good.sparkSession
    fs, final = _fs(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    tmp = f"{path}.writing"
    fs.delete(_fs(spark, tmp)[1], True)
    try:
        encoded = encode_chat(with_ordinal(good, "line", "pos", by="assigned_split"), max_length)
        raw = F.octet_length("system") + F.octet_length("user") + F.octet_length("assistant")
        encoded.select(F.col("assigned_split").alias("split"), "pos", "line", "input_ids", "labels", "target_token_count", "truncated", raw.alias("raw_bytes"), F.octet_length("assistant").alias("target_bytes")).write.partitionBy("split").parquet(f"{tmp}/shards")
        written = spark.read.schema(SHARDS).parquet(f"{tmp}/shards")
        manifest = {"format": 2, "max_length": max_length, "splits": {r.split: r.asDict() for r in _summed(written, "split", F.col("raw_bytes"), F.col("target_bytes")).collect()}, "files": digests(spark, f"{tmp}/shards")}
        if source is not None:
            manifest |= {"source": source, "source_sha256": source_digest(spark, source)}
        if audit is not None:
            manifest["audit"] = audit
        check_manifest(manifest)
        out = fs.create(_fs(spark, f"{tmp}/manifest.json")[1], True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not fs.rename(_fs(spark, tmp)[1], final):
            raise OSError(f"cannot rename {tmp}")
    except BaseException:
        fs.delete(_fs(spark, tmp)[1], True)
        raise
    return manifest


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file, hashed where it lies; file names and digests only reach the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    rows = files.select(F.regexp_extract("path", r"shards/(.*)$", 1).alias("f"), F.sha2("content", 256).alias("h")).collect()
    return {r.f: r.h for r in rows}


def source_digest(spark: SparkSession, source: str) -> str:
    """SHA-256 over the digests of a source's files in name order; each file is hashed where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    return canonical_hash([r.h for r in files.select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()])


def check_manifest(m: dict) -> None:
    """Raises where a manifest contradicts itself: format, lengths, splits, counters, and its audit if it has one."""
    counters = ("examples", "input_tokens", "target_tokens", "truncated_examples", "raw_utf8_bytes", "target_utf8_bytes")
    splits = m.get("splits") or {}
    rules = {
        "unsupported compiled dataset format": m.get("format") in (1, 2),
        "max_length must be at least 2": m.get("max_length", 0) >= 2,
        "a source needs a SHA-256 digest": "source" not in m or len(m.get("source_sha256", "")) == 64,
        "no training split": "train" in splits,
        "the training split is empty": splits.get("train", {}).get("examples", 0) >= 1,
        "a split is filed under another name": all(k == s.get("split") for k, s in splits.items()),
        "a counter is negative or missing": all(s.get(c, -1) >= 0 for s in splits.values() for c in counters),
    }
    if (a := m.get("audit")) is not None:
        rules |= {
            "the audit is of another source": "sha256" not in a or a["sha256"] == m.get("source_sha256"),
            "the audit's accepted rows aren't those compiled": a.get("accepted_rows") == sum(s.get("examples", 0) for s in splits.values()),
            "the audit has rejected rows": a.get("rejected_rows", 0) == 0,
        }
    for fault, holds in rules.items():
        if not holds:
            raise ValueError(fault)


def verify(spark: SparkSession, path: str) -> list[str]:
    """What differs from the manifest: its own contradictions, missing or changed files, counts of examples and tokens, and the source if it is there."""
    fs, m = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(m):
        return ["manifest missing"]
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    try:
        check_manifest(manifest)
    except ValueError as e:
        return [f"manifest: {e}"]
    now = digests(spark, f"{path}/shards")
    bad = [f"missing {f}" for f in manifest["files"] if f not in now] + [f"digest {f}" for f, h in now.items() if manifest["files"].get(f) != h]
    if not bad:
        per = spark.read.schema(SHARDS).parquet(f"{path}/shards").groupBy("split").agg(F.count("*").alias("examples"), F.sum(F.size("input_ids")).alias("input_tokens"), F.sum(F.size("labels")).alias("labels"))
        have = {r.split: r for r in per.collect()}
        for s, x in manifest["splits"].items():
            r = have.get(s)
            bad += [f"examples {s}"] * ((r.examples if r else 0) != x["examples"])
            bad += [f"{c} {s}" for c in ("input_tokens", "labels") if (r[c] if r else 0) != x["input_tokens"]]
    if (source := manifest.get("source")) and _fs(spark, source)[0].exists(_fs(spark, source)[1]) and source_digest(spark, source) != manifest["source_sha256"]:
        bad.append("source digest")
    return bad


def example_at(spark: SparkSession, path: str, split: str, index: int) -> dict:
    """One example by position; negative ones count from the end, others outside the split are an IndexError."""
    df = spark.read.parquet(f"{path}/shards").where(F.col("split") == split)
    if index < 0:
        index += df.count()
    row = df.where(F.col("pos") == index).first() if index >= 0 else None
    if row is None:
        raise IndexError(index)
    return row.asDict()


def resume(df: DataFrame, n: int, seed: int, epoch: int, cursor: int, take: int) -> DataFrame:
    """The next `take` examples of an epoch's order from a saved cursor: a filter, the same however often it is asked."""
    return affine_order(df, n, seed, epoch, "pos").where((F.col("cursor") >= cursor) & (F.col("cursor") < cursor + take))


def missing_splits(rows: DataFrame, split: str = "split", *by: str) -> DataFrame:
    """(by, split) of train, val and test that have no row, in all or for a value of by: a stream asked for one would never end an epoch."""
    have = rows.select(*by, F.col(split).alias("split")).distinct()
    wanted = (have.select(*by).distinct() if by else rows.sparkSession.range(1)).select(*by, F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    same = [wanted[c].eqNullSafe(have[c]) for c in (*by, "split")]
    return wanted.join(have, same, "left_anti")
