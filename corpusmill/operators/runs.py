"""The run registry as an append-only log with a latest-wins view, and what is read off it."""

from __future__ import annotations

import hashlib
import json
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "completed", "failed", "cancelled")
SUMMARY = ("run_id", "status", "created_at", "updated_at", "version", "commit_sha", "experiment_hash", "config_hash", "decision", "evidence_class", "report_path", "checkpoint_path", "failure", "parent_run_id")


def current(log: DataFrame, key: str = "run_id", at: str = "updated_at", born: str = "created_at") -> DataFrame:
    """One row a key: the last written one (by `at`, then by the other columns), with the creation time of the first.

    An upsert appends; the view is one aggregate, so no table format with MERGE is needed. Repeated writes fall
    together; a null `at` is oldest; rows without a key are left out.
    """
    rest = [c for c in log.columns if c not in (key, at)]
    last = F.max(F.struct(at, *rest))
    first = F.min_by(born, F.struct(F.col(at).isNull(), at, born))
    x = log.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_l"), first.alias("_b"))
    return x.select(*[F.col(key) if c == key else F.col("_b").alias(c) if c == born else F.col(f"_l.{c}").alias(c) for c in log.columns])


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends rows to the log at path."""
    rows.write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the current view of the log at path to a new place."""
    current(spark.read.parquet(path)).write.parquet(to)


def get(log: DataFrame, run_id: str) -> dict:
    row = current(log.where(F.col("run_id") == run_id)).first()
    if row is None:
        raise KeyError(run_id)
    return row.asDict()


def listing(log: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest runs, optionally of one status."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    c = current(log)
    return (c if status is None else c.where(F.col("status") == status)).orderBy(F.desc("created_at"), "run_id").limit(limit)


def with_status(log: DataFrame, updates: DataFrame) -> DataFrame:
    """The current view after updates(run_id, status, at, decision, metrics_json, failure).

    A null decision or metrics keeps the old one; failure is replaced even by null.
    """
    u = updates.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("status", "at", "decision", "metrics_json", "failure")], F.lit(True).alias("_u"))
    r = current(log).join(u, "run_id", "left")
    new = {
        "status": F.coalesce("_status", "status"),
        "updated_at": F.coalesce("_at", "updated_at"),
        "decision": F.coalesce("_decision", "decision"),
        "metrics_json": F.coalesce("_metrics_json", "metrics_json"),
        "failure": F.when(F.col("_u"), F.col("_failure")).otherwise(F.col("failure")),
    }
    return r.select(*[new[c].alias(c) if c in new else F.col(c) for c in log.columns])


def artifacts(log: DataFrame) -> DataFrame:
    """(run_id, name, path) of each run's current files, an upsert on run and name."""
    names = ("manifest", "report", "checkpoint")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_path").alias("path")) for n in names]))
    return current(log).select("run_id", pairs.alias("a")).select("run_id", "a.name", "a.path").where("path is not null")


def faults(log: DataFrame) -> DataFrame:
    """(run_id, fault) of current records that are not valid."""
    f = F.array_compact(
        F.array(
            F.when(F.btrim("run_id") == "", "empty run_id"),
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
            F.when((F.col("created_at") < 0) | (F.col("updated_at") < F.col("created_at")), "timestamps"),
            F.when((F.col("status") == "failed") & (F.coalesce("failure", F.lit("")) == ""), "failure message"),
        )
    )
    return current(log).select("run_id", F.explode(f).alias("fault"))


def lineage(log: DataFrame) -> DataFrame:
    """(run_id, ancestor, depth) by recursion over parent_run_id, to a depth of 50."""
    current(log).select("run_id", "parent_run_id").createOrReplaceTempView("_run_parents")
    return log.sparkSession.sql(
        "with recursive up(run_id, ancestor, depth) as (select run_id, parent_run_id, 1 from _run_parents where parent_run_id is not null union all select up.run_id, p.parent_run_id, depth + 1 from up join _run_parents p on p.run_id = up.ancestor where p.parent_run_id is not null and depth < 50) select run_id, ancestor, depth from up"
    )


def sweep(spark: SparkSession, name: str, base: dict, grid: dict[str, list], most: int = 256) -> DataFrame:
    """(trial, trial_id, parameters as JSON, config as JSON): the product of the grid's values in order of their sorted names.

    The grid is a plan of at most `most` trials, made on the driver; dotted names must exist in the base.
    """
    if not grid or any(not v for v in grid.values()):
        raise ValueError("the grid and each parameter's values must not be empty")
    names = sorted(grid)
    total = 1
    for v in grid.values():
        total *= len(v)
    if total > most:
        raise ValueError(f"{total} trials; at most {most}")
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    rows = []
    for i, values in enumerate(product(*(grid[n] for n in names))):
        config = json.loads(json.dumps(base))
        for n, v in zip(names, values, strict=True):
            *path, leaf = n.split(".")
            at = config
            for p in path:
                at = at.get(p) if isinstance(at, dict) else None
            if not isinstance(at, dict) or leaf not in at:
                raise ValueError(f"{n} is not in the base")
            at[leaf] = v
        params = dump(dict(zip(names, values, strict=True)))
        rows.append((i, f"{name}-{i:04d}-{hashlib.sha256(params.encode()).hexdigest()[:10]}", params, dump(config)))
    return spark.createDataFrame(rows, "trial int, trial_id string, parameters string, config string")


def outcomes(log: DataFrame, *by: str) -> DataFrame:
    """Runs by outcome."""
    return current(log).groupBy(*by).agg(F.count("*").alias("trials"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
