"""Metrics, statistics, score filters and the run registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit_interval
from ..functions.text import words
from ..operators import compiled, metrics, runs, stats
from ..session import table
from . import sql as S
from .registry import query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since their sums depend on the order of addition in the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_R = lambda x: f"round({x}, 6)"


@query(
    f"with d as (select coalesce(text, '') as t, {S.unit('doc_id::varchar', 11)} < 0.9 as train from documents), b as (select train, unnest(list_transform(range(octet_length(encode(t))), lambda i: substr(hex(encode(t)), 2 * i + 1, 2))) as b from d), c as (select b, count(*) filter (train) as c, count(*) filter (not train) as h from b group by b), m as (select sum(h)::bigint as tokens, sum(h * -ln((c + 1.0) / ((select sum(c) from c) + 259.0))) / sum(h) as x from c) select tokens, {_R('x')} as mean_nll, {_R('exp(least(x, 20))')} as perplexity from m"
)
def metrics_unigram(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("text", (unit_interval(F.col("doc_id").cast("string"), 11) < 0.9).alias("train"))
    return rounded(metrics.unigram_baseline(docs.where("train"), docs.where("not train"), "text"))


@query(
    f"with b as (select event_type, value / 100 as nll, length(props) as n, octet_length(encode(props)) + user_id % 5 as raw from events), m as (select event_type, count(*) as batches, sum(n)::bigint as tokens, sum(nll * n) as t, sum(raw) as rb, avg(nll) as v from b where n > 0 group by 1) select event_type, batches, tokens, {_R('t / tokens')} as mean_loss, {_R('exp(least(t / tokens, 80))')} as perplexity, {_R('t / tokens / ln(2)')} as bits_per_token, case when rb > 0 then {_R('t / (rb * ln(2))')} end as bits_per_byte, {_R('v')} as validation_loss from m"
)
def metrics_language(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("nll"), F.length("props").alias("n"), (F.octet_length("props") + F.col("user_id") % 5).alias("raw_bytes"))
    return rounded(metrics.language_metrics(b, "event_type"))


_SEQ = f"select task_family, {S.words('user_text')} as p, {S.words('assistant_text')} as t from chat_examples"


@query(
    f"with s as ({_SEQ}), x as (select task_family, len(list_filter(list_transform(range(1, least(len(p), len(t)) + 1), lambda i: p[i] = t[i]), lambda z: z)) as hit, len(t) as n, len(p) as m from s), m as (select task_family, count(*) as examples, count(*) filter (hit = n and m = n) as exact_matches, sum(hit)::bigint as correct_tokens, sum(n)::bigint as target_tokens from x group by 1) select *, {_R('exact_matches / examples')} as exact_match, {_R('case when target_tokens > 0 then correct_tokens / target_tokens else 0 end')} as token_accuracy from m"
)
def metrics_sequences(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_examples").select("task_family", words("user_text").alias("p"), words("assistant_text").alias("t"))
    return rounded(metrics.sequence_metrics(c, "p", "t", "task_family"))


@query(
    f"with s as (select doc_id, lang, {S.words('text')} as t from documents), u as (select doc_id, unnest(t) as w, generate_subscripts(t, 1) as i from s), g as (select doc_id, w, i - row_number() over (partition by doc_id, w order by i) as g from u), runs as (select doc_id, max(n) as longest from (select doc_id, count(*) as n from g group by doc_id, w, g) group by doc_id), x as (select lang, len(t) as n, len(list_distinct(t)) as dn, len(list_filter(range(1, len(t)), lambda i: t[i] = t[i + 1])) as same, coalesce(longest, 0) as longest, list_contains(t, 'the')::int as eos from s left join runs using (doc_id)) select lang, count(*) as sequences, sum(n)::bigint as tokens, {_R('case when sum(n) > 0 then sum(dn) / sum(n) else 0 end')} as unique_token_fraction, {_R('case when sum(greatest(n - 1, 0)) > 0 then sum(same) / sum(greatest(n - 1, 0)) else 0 end')} as adjacent_repetition_fraction, max(longest)::int as longest_repeated_run, {_R('avg(eos)')} as eos_fraction from x group by lang"
)
def metrics_generation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", words("text").alias("t"))
    return rounded(metrics.generation_diagnostics(t, "t", "the", "lang"))


@query(
    f"with w as (select event_id, user_id, sum(length(props)) over w as total_tokens, sum(value) over w as total_seconds, min(value) over w as best_loss from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)) select event_id, user_id, total_tokens::bigint as total_tokens, {_R('total_seconds')} as total_seconds, best_loss, case when total_seconds > 0 then {_R('total_tokens / total_seconds')} end as tokens_per_second from w"
)
def metrics_telemetry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("n", F.length("props").cast("long"))
    t = metrics.telemetry(e, "user_id", ["ts", "event_id"], "n", "value", "value")
    return rounded(t.select("event_id", "user_id", "total_tokens", "total_seconds", "best_loss", "tokens_per_second"))


@query(f"select event_type, count(*) as n, {_R('quantile_cont(value, 0.5)')} as p50, {_R('quantile_cont(value, 0.9)')} as p90, {_R('quantile_cont(value, 0.99)')} as p99 from events group by 1")
def metrics_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.quantiles(table(spark, d, "events"), "value", "event_type"))


@query("select event_type, count(*) as rows, count(*) filter (json_valid(props)) as valid, sum((json_extract(props, '$.k'))::bigint)::bigint as k from events group by 1")
def metrics_event_json(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(v.isNotNull()).alias("valid"), F.sum(F.try_variant_get(v, "$.k", "bigint")).alias("k"))


_SC = "s as (select vec_id, generate_subscripts(embedding, 1) - 1 as token, unnest(embedding)::double as score from embeddings)"
_PR = _SC + ", e as (select *, exp(score - max(score) over (partition by vec_id)) as x from s), p as (select vec_id, token, score, x / sum(x) over (partition by vec_id) as p from e)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.exploded(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"with {_SC} select vec_id, token::int as token, score from (select *, rank() over (partition by vec_id order by score desc) as r from s) where r <= 10")
def logits_top_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_k(_scores(spark, d), "vec_id", 10)


@query(f"with {_PR} select vec_id, token::int as token, score from (select *, coalesce(sum(p) over (partition by vec_id order by score desc, token rows between unbounded preceding and 1 preceding), 0) as b from p) where b <= 0.5")
def logits_top_p(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_p(_scores(spark, d), "vec_id", 0.5)


@query(f"with {_PR} select vec_id, token::int as token, score from (select *, max(p) over (partition by vec_id) as m from p) where p >= m * 0.8")
def logits_min_p(spark: SparkSession, d: str) -> DataFrame:
    return metrics.min_p(_scores(spark, d), "vec_id", 0.8)


@query(f"with {_SC}, seen as (select vec_id, (vec_id % 64) as token from embeddings union select vec_id, (label * 7) % 64 from embeddings), a as (select s.*, case when seen.token is null then score when score < 0 then score * 1.3 else score / 1.3 end as a from s left join seen on seen.vec_id = s.vec_id and seen.token = s.token) select vec_id, token::int as token from (select *, row_number() over (partition by vec_id order by a desc, token) as r from a) where r = 1")
def logits_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    seen = e.select("vec_id", (F.col("vec_id") % 64).cast("int").alias("token")).union(e.select("vec_id", ((F.col("label") * 7) % 64).cast("int")))
    return metrics.argmax_penalised(_scores(spark, d), seen, "vec_id", 1.3)


@query(f"with {_PR}, c as (select *, sum(p) over (partition by vec_id order by token) as c from p) select vec_id, min(token)::int as token from c where c >= {S.unit('vec_id::varchar', 5)} group by vec_id")
def logits_draw(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return metrics.draw(_scores(spark, d), "vec_id", e.select("vec_id", unit_interval(F.col("vec_id").cast("string"), 5).alias("u")))


_ROUTE = (
    _PR.replace("from embeddings)", "from (select vec_id, embedding[1:8] as embedding from embeddings))")
    + ", best as (select * from (select *, row_number() over (partition by vec_id order by p desc, token) as r from p) where r <= 2), routed as (select vec_id, token as expert, p, row_number() over (partition by vec_id // 64, token order by p desc, vec_id) <= greatest(1, ceil(1.25 * count(*) over (partition by vec_id // 64) / 8)) as accepted from best)"
)


@query(f"with {_ROUTE}, per as (select expert, count(*) as routes, count(*) filter (accepted) as accepted_routes from routed group by 1) select expert::int as expert, routes, accepted_routes, {_R('routes / (select sum(routes) from per)')} as load_fraction, {_R('1 - accepted_routes / routes')} as dropped_fraction, (select max(routes) / sum(routes) from per) > 0.9 as collapsed from per")
def routing_load(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("embedding"))
    return rounded(metrics.routing_load(metrics.route(metrics.exploded(e, "vec_id", "embedding"), "vec_id", 8, F.floor(F.col("vec_id") / 64))))


@query(f"with {_PR.replace('from embeddings)', 'from (select vec_id, embedding[1:8] as embedding from embeddings))')}, h as (select vec_id, sum(-p * ln(greatest(p, 1e-12))) as h from p group by vec_id) select count(*) as rows, {_R('avg(h)')} as router_entropy from h")
def routing_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("embedding"))
    return rounded(metrics.router_entropy(metrics.exploded(e, "vec_id", "embedding"), "vec_id"))


_T = ", ".join(map(str, stats.T_95))
_SS = "with m as (select {by}, count(value) as count, avg(value) as mean, coalesce(stddev_samp(value), 0) as sd, median(value) as median, min(value) as minimum, max(value) as maximum from {src} group by 1), t as (select *, sd / sqrt(count) as se, case when count <= 1 then 0 when count <= 31 then ([{t}])[count - 1] else 1.96 end as t from m) select {by}, count, round(mean, 6) as mean, round(sd, 6) as standard_deviation, round(median, 6) as median, minimum, maximum, round(se, 6) as standard_error, round(mean - t * se, 6) as ci_low, round(mean + t * se, 6) as ci_high from t"


@query(_SS.format(by="event_type", src="events", t=_T))
def stats_samples(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.sample_summary(table(spark, d, "events"), "value", "event_type"))


@query(_SS.format(by="user_id", src="events", t=_T))
def stats_samples_small(spark: SparkSession, d: str) -> DataFrame:
    """The same for each user, where groups are small enough for Student's t."""
    return rounded(stats.sample_summary(table(spark, d, "events"), "value", "user_id"))


_PAIRED = """with p as (select user_id, avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as b from events group by 1), x as (select *, a - b as d from p where a - b is not null),
 m as (select count(*) as count, avg(d) as md, coalesce(stddev_samp(d), 0) as sd, avg(b) as c, count(*) filter (d > 0.5) as wins, count(*) filter (d < -0.5) as losses from x)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(v("click").alias("a"), v("view").alias("b"))


@query(
    _PAIRED
    + " select count, round(md, 6) as mean_difference, round(md, 6) as oriented_mean_difference, wins, losses, count - wins - losses as ties, round(md / sd, 6) as effect_size_dz, round(md / abs(c), 6) as relative_improvement, round(least(1.0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) from (select wins + losses as n, unnest(range(0, least(wins, losses) + 1)) as k from m))), 6) as sign_test_p from m"
)
def stats_paired(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.paired_comparison(_pairs(spark, d), "a", "b", tolerance=0.5))


@query()
def stats_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean paired difference, by the users' parity."""
    p = _pairs(spark, d).select((F.col("user_id") % 2).alias("part"), (F.col("a") - F.col("b")).alias("value"))
    return stats.bootstrap_interval(p, "value", "part", seed=7)


_GATED = "with m as (select user_id, avg(value) filter (event_type = 'click') as v, count(*) filter (event_type = 'signup') as seeds, count(*) filter (event_type = 'error' and value > 300) as failures, bool_or(value > 20) filter (event_type = 'purchase') as robust from events group by 1)"


@query(
    _GATED
    + ", g as (select *, case when failures = 0 then 'pass' else 'fail' end as gate_correctness, case when seeds >= 3 then 'pass' else 'fail' end as gate_seeds, case when v is null then 'not_run' when v >= 50 then 'pass' when v <= 35 then 'fail' else 'inconclusive' end as gate_primary, case when robust is null then 'not_run' when robust then 'pass' else 'fail' end as gate_noise from m) select user_id, gate_correctness, gate_seeds, gate_primary, gate_noise, case when 'fail' in (gate_correctness, gate_seeds, gate_noise, gate_primary) then 'kill' when gate_primary = 'pass' and gate_noise = 'pass' then 'keep' else 're_test' end as decision from g"
)
def stats_gates(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: F.col("event_type") == k
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(of("click"), F.col("value"))).alias("v"), F.count_if(of("signup")).alias("seeds"), F.count_if(of("error") & (F.col("value") > 300)).alias("failures"), F.bool_or(F.when(of("purchase"), F.col("value") > 20)).alias("robust"))
    return stats.gates(m, "v", "seeds", "failures", 3, 50.0, 35.0, {"noise": "robust"}).drop("v", "seeds", "failures", "robust")


@query("with m as (select user_id, avg(value) as v from events group by 1) select user_id, case when v <= 40 then 'keep' when v >= 60 then 'kill' else 're_test' end as decision from m")
def stats_thresholds(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return m.select("user_id", stats.threshold_decision(F.col("v"), 40.0, 60.0, False).alias("decision"))


@query("with m as (select user_id, least(avg(value) / 100, 1) as a, count(*) filter (event_type = 'error') / count(*) as b from events group by 1), t as (select user_id, greatest(0, least(1, 0.35 * a + 0.2 * b + 0.2 * (1 - b) + 0.25 * a - case when b > 0.3 then 0.25 else 0 end)) as total from m) select user_id, round(total, 6) as total, case when total < 0.35 then 'kill' when total < 0.65 then 'retest' else 'keep' end as band from t")
def stats_scorecard(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("a"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("b"))
    m = m.withColumn("c", 1 - F.col("b")).withColumn("pen", F.when(F.col("b") > 0.3, 0.25).otherwise(0.0))
    return rounded(stats.scorecard(m, "a", "b", "c", "a", "pen").select("user_id", "total", "band"))


@query("with r as (select event_type as variant, value < 400 as finite, 1 - value / 1000 as s, value - 20 as l from events), m as (select variant, count(*) as runs, count(*) filter (finite) as finite_runs, avg(s) as a, avg(l) as b from r group by 1) select variant, runs, finite_runs, round(a, 6) as average_stability, round(b, 6) as average_loss_delta, case when finite_runs < runs then 'kill' when a >= 0.9 and b > 0 then 'keep' else 're-test' end as decision from m")
def stats_variants(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select(F.col("event_type").alias("variant"), (F.col("value") < 400).alias("finite"), (1 - F.col("value") / 1000).alias("s"), (F.col("value") - 20).alias("l"))
    return rounded(stats.variant_decision(r, "variant", "finite", "s", "l"))


@query("with m as (select user_id, sum(value) filter (event_type = 'view') as c, sum(value) as t from events group by 1) select user_id, round(1 - c / t, 6) as profile_gain from m where t > 0")
def stats_profile(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("c"), F.sum("value").alias("t")).where("t > 0")
    return rounded(m.select("user_id", stats.profile_metric(F.col("c"), F.col("t")).alias("profile_gain")))


_COLS = ("run_id", "status", "created_at", "updated_at", "version", "commit_sha", "experiment_hash", "config_hash", "decision", "evidence_class", "manifest_path", "report_path", "checkpoint_path", "hardware_json", "config_json", "metrics_json", "failure", "parent_run_id")
_REST = ", ".join(f"{c} desc nulls last" for c in _COLS if c not in ("run_id", "updated_at"))
_CUR = f"cur as (select * exclude (rn, born) replace (born as created_at) from (select *, row_number() over (partition by run_id order by updated_at desc nulls last, {_REST}) as rn, first_value(created_at) over (partition by run_id order by updated_at nulls last, created_at nulls first) as born from runs where run_id is not null) where rn = 1)"


@query(f"with {_CUR} select {', '.join(_COLS)} from cur")
def registry_current(spark: SparkSession, d: str) -> DataFrame:
    return runs.current(table(spark, d, "runs"))


@query(f"with {_CUR} select {', '.join(_COLS)} from cur where status = 'completed' order by created_at desc, run_id limit 20")
def registry_newest(spark: SparkSession, d: str) -> DataFrame:
    return runs.listing(table(spark, d, "runs"), "completed", 20)


@query(f"with {_CUR} select {', '.join(runs.SUMMARY)} from cur")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.current(table(spark, d, "runs")).select(*runs.SUMMARY)


@query(f"with {_CUR} select run_id, case when status = 'running' then 'failed' else status end as status, case when status = 'running' then updated_at + 1 else updated_at end as updated_at, decision, metrics_json, case when status = 'running' then null else failure end as failure from cur")
def registry_status_update(spark: SparkSession, d: str) -> DataFrame:
    """All running runs are marked failed: decision and metrics stay, the failure is replaced by null."""
    log = table(spark, d, "runs")
    none = F.lit(None).cast("string")
    u = runs.current(log).where("status = 'running'").select("run_id", F.lit("failed").alias("status"), (F.col("updated_at") + 1).alias("at"), none.alias("decision"), none.alias("metrics_json"), none.alias("failure"))
    return runs.with_status(log, u).select("run_id", "status", "updated_at", "decision", "metrics_json", "failure")


@query(f"with {_CUR} " + " union all ".join(f"select run_id, '{n}' as name, {n}_path as path from cur where {n}_path is not null" for n in ("manifest", "report", "checkpoint")))
def registry_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return runs.artifacts(table(spark, d, "runs"))


@query(f"with {_CUR.replace('from runs', 'from (select * replace (null::varchar as failure, updated_at - 7200 as updated_at) from runs) runs')} select run_id, fault from (select run_id, unnest(list_filter([case when trim(run_id) = '' then 'empty run_id' end, case when coalesce(status in ('queued', 'running', 'completed', 'failed', 'cancelled'), false) = false then 'status' end, case when created_at < 0 or updated_at < created_at then 'timestamps' end, case when status = 'failed' and coalesce(failure, '') = '' then 'failure message' end], lambda x: x is not null)) as fault from cur)")
def registry_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a registry whose failure messages are lost and whose updates lie two hours too early."""
    return runs.faults(table(spark, d, "runs").withColumn("failure", F.lit(None).cast("string")).withColumn("updated_at", F.col("updated_at") - 7200))


@query(f"with recursive {_CUR}, up(run_id, ancestor, depth) as (select run_id, parent_run_id, 1 from cur where parent_run_id is not null union all select up.run_id, p.parent_run_id, depth + 1 from up join cur p on p.run_id = up.ancestor where p.parent_run_id is not null and depth < 50) select * from up")
def registry_lineage(spark: SparkSession, d: str) -> DataFrame:
    return runs.lineage(table(spark, d, "runs"))


@query(f"with {_CUR} select evidence_class, count(*) as trials, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in runs.STATUSES) + " from cur group by 1")
def registry_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return runs.outcomes(table(spark, d, "runs"), "evidence_class")


@query("select row_number() over (order by b, a) - 1 as trial, '{\"model.depth\":' || b || ',\"train.lr\":' || a || '}' as parameters, 'grid-' || lpad((row_number() over (order by b, a) - 1)::varchar, 4, '0') || '-' || substr(sha256('{\"model.depth\":' || b || ',\"train.lr\":' || a || '}'), 1, 10) as trial_id from (values ('1'), ('2'), ('3')) x(b), (values ('0.1'), ('0.2')) y(a)")
def sweep_plan(spark: SparkSession, d: str) -> DataFrame:
    base = {"id": "base", "model": {"depth": 0, "width": 64}, "train": {"lr": 0.5}}
    return runs.sweep(spark, "grid", base, {"train.lr": [0.1, 0.2], "model.depth": [1, 2, 3]}).drop("config")


_BY_USER = "select user_id, sum(value) filter (event_type = 'view') as v, sum(value) filter (event_type = 'click') as c, count(*) as n, sum(value) as t from events group by 1"


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(of("view").alias("v"), of("click").alias("c"), F.count("*").alias("n"), F.sum("value").alias("t"))


@query(f"with m as ({_BY_USER}), r as (select user_id, case when v <> 0 then c / v end as r from m) select user_id, round(r, 6) as ratio, round((select avg(r) from r), 6) as average_ratio from r")
def stats_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ratio_table(_by_user(spark, d), "c", "v", "user_id"))


@query(f"with m as ({_BY_USER}) select user_id, array_to_string(list_filter([case when n > 70 then 'n' end, case when t > 3500 then 't' end], lambda x: x is not null), ',') as exceeded from m")
def stats_budget(spark: SparkSession, d: str) -> DataFrame:
    return stats.over_budget(_by_user(spark, d), {"n": 70, "t": 3500}).select("user_id", F.array_join("exceeded", ",").alias("exceeded"))


@query(
    f"with m as (select *, user_id % 7 as part from ({_BY_USER})), x as (select part, count(*) filter (c - v is not null) as count, avg(c - v) as d, count(*) filter (c is null or v is null) as failures from m group by 1) select part, count, round(d, 6) as oriented_mean_difference, case when failures = 0 then 'pass' else 'fail' end as gate_correctness, case when count >= 15 then 'pass' else 'fail' end as gate_seeds, case when d >= 30 then 'pass' when d <= -30 then 'fail' else 'inconclusive' end as gate_primary, case when failures > 0 or count < 15 or d <= -30 then 'kill' when d >= 30 then 'keep' else 're_test' end as decision from x"
)
def stats_external(spark: SparkSession, d: str) -> DataFrame:
    pairs = _by_user(spark, d).withColumn("part", F.col("user_id") % 7)
    return rounded(stats.external_experiment(pairs, "c", "v", 15, 30.0, -30.0, "part"))


@query("with h as (select distinct source, lower(split) as split from chat_examples), w as (select distinct source, unnest(['train', 'val', 'test']) as split from chat_examples) select source, split from w where not exists (select 1 from h where h.source is not distinct from w.source and h.split = w.split)")
def compiled_missing_splits(spark: SparkSession, d: str) -> DataFrame:
    """By source: the splits, by their own spelling, that no row is in."""
    return compiled.missing_splits(table(spark, d, "chat_examples").select("source", F.lower("split").alias("split")), "split", "source")


@query("select split from (values ('train'), ('val'), ('test')) s(split) where split not in (select lower(split) from chat_examples where split is not null)")
def compiled_missing_splits_all(spark: SparkSession, d: str) -> DataFrame:
    """Splits, by their own spelling, that no row of the whole table is in."""
    return compiled.missing_splits(table(spark, d, "chat_examples").select(F.lower("split").alias("split")))
