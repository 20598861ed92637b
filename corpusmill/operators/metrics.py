"""Corpus, sequence, generation and telemetry metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import utf8_bytes
from ..session import cut, shuffle_width


def unigram_baseline(train: DataFrame, held: DataFrame, text: str, alpha: float = 1.0, symbols: int = 259) -> DataFrame:
    """One row: tokens and mean negative log-likelihood of held-out bytes under add-alpha counts of the training bytes.

    Either side shrinks to at most 256 counts before anything is joined; null texts have no bytes.
    """
    count = lambda df, name: df.select(F.explode(utf8_bytes(text)).alias("b")).groupBy("b").agg(F.count("*").alias(name))
    c, h = count(train, "c"), count(held, "h")
    total = c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
    nll = -F.log((F.coalesce("c", F.lit(0)) + alpha) / (F.col("total") + alpha * symbols))
    x = h.join(c, "b", "left").crossJoin(F.broadcast(total))  # 256 rows with one
    m = x.agg(F.sum("h").alias("tokens"), (F.sum(nll * F.col("h")) / F.sum("h")).alias("mean_nll"))
    return m.select("tokens", "mean_nll", F.exp(F.least("mean_nll", F.lit(20.0))).alias("perplexity"))


def language_metrics(batches: DataFrame, *by: str) -> DataFrame:
    """batches(nll, n, raw_bytes): token-weighted mean, perplexity, bits a token and a byte; and the unweighted mean of batches."""
    m = batches.where("n > 0").groupBy(*by).agg(F.count("*").alias("batches"), F.sum("n").alias("tokens"), F.sum(F.col("nll") * F.col("n")).alias("_t"), F.sum("raw_bytes").alias("_b"), F.avg("nll").alias("validation_loss"))
    mean = F.col("_t") / F.col("tokens")
    return m.select(*by, "batches", "tokens", mean.alias("mean_loss"), F.exp(F.least(mean, F.lit(80.0))).alias("perplexity"), (mean / math.log(2)).alias("bits_per_token"), F.when(F.col("_b") > 0, F.col("_t") / (F.col("_b") * math.log(2))).alias("bits_per_byte"), "validation_loss")


def sequence_metrics(pairs: DataFrame, predicted: str, target: str, *by: str) -> DataFrame:
    """Exact matches and token accuracy of predicted against target arrays, position by position; nothing is exploded."""
    hit = F.aggregate(F.zip_with(predicted, target, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    x = pairs.withColumn("_hit", hit).withColumn("_n", F.size(target))
    exact = (F.col("_hit") == F.col("_n")) & (F.size(predicted) == F.col("_n"))
    m = x.groupBy(*by).agg(F.count("*").alias("examples"), F.count_if(exact).alias("exact_matches"), F.sum("_hit").alias("correct_tokens"), F.sum("_n").alias("target_tokens"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.withColumn("exact_match", rate("exact_matches", "examples")).withColumn("token_accuracy", rate("correct_tokens", "target_tokens"))


def longest_run(tokens: Column | str) -> Column:
    """Length of the longest run of one value in an array; 0 if it is empty. A single pass, whatever the length."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(tokens, start, step)["best"]


def generation_diagnostics(generated: DataFrame, tokens: str, eos: str, *by: str) -> DataFrame:
    """Distinct share, adjacent repetition, longest run and share of sequences that hold eos, over token arrays."""
    n = F.size(tokens)
    shifted = F.slice(tokens, 2, F.greatest(n - 1, F.lit(0)))
    same = F.aggregate(F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), shifted, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    m = generated.groupBy(*by).agg(
        F.count("*").alias("sequences"),
        F.sum(n).alias("tokens"),
        F.sum(F.size(F.array_distinct(tokens))).alias("_d"),
        F.sum(same).alias("_same"),
        F.sum(F.greatest(n - 1, F.lit(0))).alias("_pairs"),
        F.max(longest_run(tokens)).alias("longest_repeated_run"),
        F.avg(F.array_contains(tokens, eos).cast("int")).alias("eos_fraction"),
    )
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return m.select(*by, "sequences", "tokens", rate(F.col("_d"), F.col("tokens")).alias("unique_token_fraction"), rate(F.col("_same"), F.col("_pairs")).alias("adjacent_repetition_fraction"), "longest_repeated_run", "eos_fraction")


def telemetry(events: DataFrame, run: str, step: list[str], tokens: str, seconds: str, loss: str) -> DataFrame:
    """events with cumulative tokens and seconds, tokens a second and the best loss so far, per run in step order.

    A run of any length spreads over range partitions: each holds a block of it, blocks are summed first, and what
    comes before a block is added to the totals inside it. So no window holds more than one block of a run.
    """
    n = shuffle_width(events.sparkSession)
    blocks = cut(events.repartitionByRange(n, run, *step).withColumn("_block", F.spark_partition_id()))
    sums = blocks.groupBy(run, "_block").agg(F.sum(tokens).alias("_t"), F.sum(seconds).alias("_s"), F.min(loss).alias("_l"))
    past = W.partitionBy(run).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = cut(sums.select(F.col(run).alias("_run"), F.col("_block").alias("_b"), F.sum("_t").over(past).alias("_t"), F.sum("_s").over(past).alias("_s"), F.min("_l").over(past).alias("_l")))
    w = W.partitionBy(run, "_block").orderBy(*step).rowsBetween(W.unboundedPreceding, 0)
    r = blocks.join(before, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_block") == F.col("_b")))
    whole = lambda c, past: F.when(F.col(past).isNull(), c).when(c.isNull(), F.col(past)).otherwise(c + F.col(past))
    r = r.withColumn("total_tokens", whole(F.sum(tokens).over(w), "_t")).withColumn("total_seconds", whole(F.sum(seconds).over(w), "_s")).withColumn("best_loss", F.least(F.min(loss).over(w), "_l"))
    return r.drop("_block", "_run", "_b", "_t", "_s", "_l").withColumn("tokens_per_second", F.when(F.col("total_seconds") > 0, F.col("total_tokens") / F.col("total_seconds")))


def quantiles(df: DataFrame, value: str, *by: str, points: tuple[float, ...] = (0.5, 0.9, 0.99), exact: bool = True) -> DataFrame:
    """Quantiles; pXX columns. Exact ones are interpolated and keep a group's distinct values, so they suit lengths and
    rounded times; exact=False takes a sketch of fixed size, for any number of distinct values."""
    at = F.array(*map(F.lit, points))
    q = F.percentile(value, at) if exact else F.percentile_approx(value, at, 10_000)
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[q[i].alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


# ---- scores of a token at each step: filters as they are applied before drawing one -------------------------------


def exploded(df: DataFrame, key: str, scores: str) -> DataFrame:
    return df.select(key, F.posexplode(scores).alias("token", "s")).select(key, "token", F.col("s").cast("double").alias("score"))


def top_k(scores: DataFrame, key: str, k: int) -> DataFrame:
    """Tokens among the k best of their row; all that tie with the k-th stay."""
    return scores.withColumn("_r", F.rank().over(W.partitionBy(key).orderBy(F.desc("score")))).where(F.col("_r") <= k).drop("_r")


def with_probability(scores: DataFrame, key: str) -> DataFrame:
    w = W.partitionBy(key)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(scores: DataFrame, key: str, p: float) -> DataFrame:
    """The best tokens up to and including the one whose cumulative probability passes p; the best always stays."""
    before = F.coalesce(F.sum("p").over(W.partitionBy(key).orderBy(F.desc("score"), "token").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return with_probability(scores, key).withColumn("_b", before).where(F.col("_b") <= p).drop("_b", "p")


def min_p(scores: DataFrame, key: str, p: float) -> DataFrame:
    """Tokens with at least p times the best token's probability."""
    x = with_probability(scores, key)
    return x.withColumn("_m", F.max("p").over(W.partitionBy(key))).where(F.col("p") >= F.col("_m") * p).drop("_m", "p")


def argmax_penalised(scores: DataFrame, seen: DataFrame, key: str, penalty: float) -> DataFrame:
    """(key, token): the best token after dividing seen tokens' scores by the penalty (multiplying negative ones); least token on ties."""
    s = scores.join(seen.select(key, "token", F.lit(True).alias("_seen")).distinct(), [key, "token"], "left")
    adj = F.when(F.col("_seen"), F.when(F.col("score") < 0, F.col("score") * penalty).otherwise(F.col("score") / penalty)).otherwise(F.col("score"))
    return s.groupBy(key).agg(F.max_by("token", F.struct(adj.alias("a"), (-F.col("token")).alias("t"))).alias("token"))


def draw(scores: DataFrame, key: str, uniforms: DataFrame) -> DataFrame:
    """(key, token) by inverse distribution at the given uniforms(key, u): reproducible, unlike a generator's stream."""
    cum = F.sum("p").over(W.partitionBy(key).orderBy("token"))
    x = with_probability(scores, key).withColumn("_c", cum).join(uniforms, key).where(F.col("_c") >= F.col("u"))
    return x.groupBy(key).agg(F.min("token").alias("token"))


def route(scores: DataFrame, key: str, experts: int, batch: Column, per_token: int = 2, factor: float = 1.25, least: int = 1) -> DataFrame:
    """(key, batch, expert, p, accepted): each row's best experts, of which each takes its heaviest up to its capacity in the batch.

    Capacity is per batch, as batches are what is routed; so a window holds one batch's routes to one expert, however
    many rows there are.
    """
    p = with_probability(scores, key).withColumn("batch", batch)
    best = p.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("p"), "token"))).where(F.col("_r") <= per_token)
    cap = F.greatest(F.lit(least), F.ceil(factor * F.count("*").over(W.partitionBy("batch")) / experts))
    rank = F.row_number().over(W.partitionBy("batch", "token").orderBy(F.desc("p"), key))
    return best.withColumn("_cap", cap).select(key, "batch", F.col("token").alias("expert"), "p", (rank <= F.col("_cap")).alias("accepted"))


def router_entropy(scores: DataFrame, key: str) -> DataFrame:
    """One row: rows, and the mean entropy of their probabilities over all experts, in nats."""
    p = F.col("p")
    per = with_probability(scores, key).groupBy(key).agg(F.sum(-p * F.log(F.greatest(p, F.lit(1e-12)))).alias("h"))
    return per.agg(F.count("*").alias("rows"), F.avg("h").alias("router_entropy"))


def padding_fraction(batches: DataFrame, valid: Column, width: Column, *by: str) -> DataFrame:
    """By batch: the share of positions that hold no token; 0 of none."""
    m = batches.groupBy(*by).agg(F.sum(valid).alias("valid_tokens"), F.sum(width).alias("positions"))
    return m.withColumn("padding_fraction", 1 - F.col("valid_tokens") / F.greatest(F.lit(1), F.col("positions")))


def routing_load(routed: DataFrame) -> DataFrame:
    """By expert: routes, share of all, accepted and dropped ones; `collapsed` if one expert gets over 0.9 of all."""
    per = routed.groupBy("expert").agg(F.count("*").alias("routes"), F.count_if("accepted").alias("accepted_routes"))
    total = per.agg(F.sum("routes").alias("_all"), F.max("routes").alias("_most"))
    return per.crossJoin(F.broadcast(total)).select("expert", "routes", "accepted_routes", (F.col("routes") / F.col("_all")).alias("load_fraction"), (1 - F.col("accepted_routes") / F.col("routes")).alias("dropped_fraction"), (F.col("_most") / F.col("_all") > 0.9).alias("collapsed"))
