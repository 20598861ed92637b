"""Sample statistics, paired comparisons, thresholds, gates and scores."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: two-sided 95 % points of Student's t for 1 to 30 degrees of freedom; the normal one beyond
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)
NORMAL_95 = 1.96


def sample_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, standard deviation (0 for one value), its error, median, extremes and the 95 % interval of the mean."""
    m = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("standard_deviation"), F.median(value).alias("median"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    se = F.col("standard_deviation") / F.sqrt("count")
    t = F.when(F.col("count") <= 1, 0.0).when(F.col("count") <= 31, F.get(F.array(*map(F.lit, T_95)), F.col("count").cast("int") - 2)).otherwise(NORMAL_95)
    return m.withColumn("standard_error", se).withColumn("ci_low", F.col("mean") - t * se).withColumn("ci_high", F.col("mean") + t * se)


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p-value of wins against losses under equal odds: binomial terms summed in logarithms, so no count overflows."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct((-n * math.log(2)).cast("double").alias("t"), F.exp((-n * math.log(2)).cast("double")).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step)["s"]))


def paired_comparison(pairs: DataFrame, candidate: str, control: str, *by: str, higher_is_better: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Mean difference, wins, ties, losses, effect size dz, relative improvement and sign-test p of paired values; pairs with a null are left out."""
    d = F.col(candidate) - F.col(control)
    o = d if higher_is_better else -d
    x = pairs.where(d.isNotNull()).withColumn("_d", d).withColumn("_o", o)
    m = x.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.avg("_d").alias("mean_difference"),
        F.avg("_o").alias("oriented_mean_difference"),
        F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("_sd"),
        F.avg(control).alias("_c"),
        F.count_if(F.col("_o") > tolerance).alias("wins"),
        F.count_if(F.col("_o") < -tolerance).alias("losses"),
    )
    m = m.withColumn("ties", F.col("count") - F.col("wins") - F.col("losses"))
    m = m.withColumn("effect_size_dz", F.when(F.col("_sd") > 0, F.col("oriented_mean_difference") / F.col("_sd")))
    m = m.withColumn("relative_improvement", F.when(F.col("_c") != 0, F.col("oriented_mean_difference") / F.abs("_c")))
    return m.withColumn("sign_test_p", sign_test(F.col("wins"), F.col("losses"))).drop("_sd", "_c")


def bootstrap_interval(df: DataFrame, value: str, by: str, samples: int = 4000, seed: int = 0, most: int = 100_000) -> DataFrame:
    """(by, low, high) of the mean by resampling with CPython's generator, index int(q * (samples - 1)) without interpolation.

    Each group is one experiment's paired values. The stream of draws ties them to one task, so a group of more
    than `most` values is an error rather than a silent sample.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(list(g.columns))[value].tolist()
        if len(v) > most:
            raise ValueError(f"{len(v)} values in group {key}; at most {most}")
        rng = random.Random(seed)
        means = sorted(math.fsum(v[rng.randrange(len(v))] for _ in v) / len(v) for _ in range(samples)) if len(v) > 1 else v * samples
        return pd.DataFrame({by: [key[0]], "low": [means[int(0.025 * (samples - 1))]], "high": [means[int(0.975 * (samples - 1))]]})

    kind = dict(df.dtypes)[by]
    return df.select(by, value).where(F.col(value).isNotNull()).groupBy(by).applyInPandas(run, f"{by} {kind}, low double, high double")


def threshold_decision(value: Column, keep: float, kill: float, higher_is_better: bool = True) -> Column:
    """keep, kill or re_test; null where there is no value."""
    if (kill > keep) == higher_is_better and kill != keep:
        raise ValueError("the kill threshold lies on the wrong side of the keep threshold")
    good, bad = (value >= keep, value <= kill) if higher_is_better else (value <= keep, value >= kill)
    return F.when(value.isNull(), F.lit(None)).when(good, "keep").when(bad, "kill").otherwise("re_test")


def gates(df: DataFrame, value: str, seeds: str, failures: str, needed_seeds: int, keep: float, kill: float, robustness: Mapping[str, str] | None = None, higher_is_better: bool = True) -> DataFrame:
    """df with a status for each gate and the decision: a failed gate is never made up for by another's success.

    robustness: axis -> boolean column (null: not run). The primary metric alone may fail without ending the matter.
    """
    d = threshold_decision(F.col(value), keep, kill, higher_is_better)
    r = df.withColumn("gate_correctness", F.when(F.col(failures) == 0, "pass").otherwise("fail"))
    r = r.withColumn("gate_seeds", F.when(F.col(seeds) >= needed_seeds, "pass").otherwise("fail"))
    r = r.withColumn("gate_primary", F.when(d.isNull(), "not_run").when(d == "keep", "pass").when(d == "kill", "fail").otherwise("inconclusive"))
    axes = robustness or {}
    for axis, c in axes.items():
        r = r.withColumn(f"gate_{axis}", F.when(F.col(c).isNull(), "not_run").when(F.col(c), "pass").otherwise("fail"))
    hard = F.lit(False)
    missing = F.lit(False)
    for g in ("gate_correctness", "gate_seeds", *[f"gate_{a}" for a in axes]):
        hard = hard | (F.col(g) == "fail")
    for a in axes:
        missing = missing | (F.col(f"gate_{a}") != "pass")
    return r.withColumn("decision", F.when(hard | (F.col("gate_primary") == "fail"), "kill").when((F.col("gate_primary") == "pass") & ~missing, "keep").otherwise("re_test"))


def scorecard(df: DataFrame, stability: str, memory: str, symbolic: str, training: str, penalty: str) -> DataFrame:
    """df with the weighted total, clamped to 0..1, and its band."""
    total = 0.35 * F.col(stability) + 0.20 * F.col(memory) + 0.20 * F.col(symbolic) + 0.25 * F.col(training) - F.col(penalty)
    r = df.withColumn("total", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return r.withColumn("band", F.when(F.col("total") < 0.35, "kill").when(F.col("total") < 0.65, "retest").otherwise("keep"))


def variant_decision(rows: DataFrame, variant: str, finite: str, stability: str, loss_delta: str) -> DataFrame:
    """By variant: runs, finite runs, mean stability and loss change, and keep, kill or re-test."""
    m = rows.groupBy(variant).agg(F.count("*").alias("runs"), F.count_if(finite).alias("finite_runs"), F.avg(stability).alias("average_stability"), F.avg(loss_delta).alias("average_loss_delta"))
    d = F.when(F.col("finite_runs") < F.col("runs"), "kill").when((F.col("average_stability") >= 0.9) & (F.col("average_loss_delta") > 0), "keep").otherwise("re-test")
    return m.withColumn("decision", d)


def profile_metric(candidate: Column, control: Column) -> Column:
    """1 - candidate / control; a control of zero is an error."""
    return F.when(control == 0, F.raise_error(F.lit("the control is zero")).cast("double")).otherwise(1 - candidate / control)


def finite(*columns: str) -> Column:
    """Whether all columns are numbers that are neither null, NaN nor infinite."""
    ok = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return ok




def ratio_table(df: DataFrame, candidate: str, baseline: str, *by: str) -> DataFrame:
    """(by, ratio, average_ratio): candidate over baseline for each setting, and the mean of the ratios; a zero or null baseline has none."""
    r = df.select(*by, F.when(F.col(baseline) != 0, F.col(candidate) / F.col(baseline)).alias("ratio"))
    mean = r.agg(F.avg("ratio").alias("average_ratio"))
    return r.withColumn("_", F.lit(0)).join(F.broadcast(mean.withColumn("_", F.lit(0))), "_").drop("_")  # one row beside each


def over_budget(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """df with `exceeded`: the names of the columns above their limits, in the order given; a null is not above."""
    return df.withColumn("exceeded", F.array_compact(F.array(*[F.when(F.col(c) > most, F.lit(c)) for c, most in limits.items()])))


def external_experiment(pairs: DataFrame, candidate: str, control: str, needed: int, keep: float, kill: float, *by: str) -> DataFrame:
    """Paired values measured elsewhere to a decision: comparison, then gates on its mean difference and number of pairs."""
    m = paired_comparison(pairs, candidate, control, *by)
    bad = pairs.groupBy(*by).agg(F.count_if(~finite(candidate, control)).alias("failures"))
    m = m.join(bad, list(by)) if by else m.withColumn("_", F.lit(0)).join(bad.withColumn("_", F.lit(0)), "_").drop("_")
    return gates(m, "oriented_mean_difference", "count", "failures", needed, keep, kill).select(*by, "count", "oriented_mean_difference", "gate_correctness", "gate_seeds", "gate_primary", "decision")
