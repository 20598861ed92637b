"""Dataset audit, splits, duplicates and leakage over chat_examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import keyed_unit_interval, row_hash, simhash, unit_interval
from ..functions.text import casefold, fingerprint_text, nfkc
from ..operators import audit, dedup, validate
from ..sources.conversations import conversations, normalized_split
from ..session import table
from . import sql as S
from .registry import query


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "chat_examples"))


def good_of(spark: SparkSession, d: str) -> DataFrame:
    return audit.with_split(validate.accepted(rows_of(spark, d)))


_HAS = lambda r: f"count(*) filter (list_contains(reasons, '{r}'))"
_AUDIT = f"""with {S.SPLIT}, every as (select count(*) as total_rows, count(*) filter (len(reasons) = 0) as accepted_rows, count(*) filter (len(reasons) > 0) as rejected_rows,
 {_HAS('empty_user')} as empty_user_rows, {_HAS('empty_assistant')} as empty_assistant_rows, {_HAS('oversized_field')} as oversized_field_rows,
 {_HAS('invalid_metadata_json')} as invalid_metadata_rows, {_HAS('duplicate_id')} as duplicate_ids from marked),
 x as (select *, row_number() over (partition by {S.FINGERPRINT} order by line) as rn, first_value(assigned_split) over (partition by content_hash order by line) as fs from placed),
 dup as (select count(*) filter (rn > 1) as exact_duplicate_content_rows, count(*) filter (fs <> assigned_split) as cross_split_duplicate_rows,
 count(*) filter (assigned_split = 'train') as train_rows, count(*) filter (assigned_split = 'val') as val_rows, count(*) filter (assigned_split = 'test') as test_rows from x),
 audit as (select * from every, dup)"""


@query(_AUDIT + " select * from audit")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(rows_of(spark, d))


@query(_AUDIT + " select *, train_rows + val_rows + test_rows = accepted_rows as valid from audit")
def audit_manifest(spark: SparkSession, d: str) -> DataFrame:
    return audit.manifest(audit.summary(rows_of(spark, d)))


@query(_AUDIT + " select unnest(list_filter([case when cross_split_duplicate_rows > 0 then 'Content occurs in more than one split.' end, case when accepted_rows = 0 then 'No row was accepted.' end], lambda x: x is not null)) as warning from audit")
def audit_warnings(spark: SparkSession, d: str) -> DataFrame:
    return audit.warnings(audit.summary(rows_of(spark, d)))


@query(_AUDIT + " select len(f) = 0 as passes, array_to_string(f, ',') as failures from (select list_filter([case when rejected_rows > 0 then 'rejected_rows' end, case when cross_split_duplicate_rows > 0 then 'cross_split_duplicates' end, case when train_rows = 0 then 'empty_train' end], lambda x: x is not null) as f from audit)")
def audit_compile_gate(spark: SparkSession, d: str) -> DataFrame:
    return audit.compile_gate(audit.summary(rows_of(spark, d)))


@query(f"with {S.REASONS} select line, array_to_string(reasons, ',') as reasons from marked where len(reasons) > 0")
def audit_rejections(spark: SparkSession, d: str) -> DataFrame:
    return validate.with_reasons(rows_of(spark, d)).where(F.size("reasons") > 0).select("line", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {S.REASONS} select line, nullif(id, '') as id, array_to_string(reasons, ',') as reasons from marked where len(reasons) > 0 order by line limit 20")
def audit_rejection_sample(spark: SparkSession, d: str) -> DataFrame:
    return validate.rejection_sample(rows_of(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


_C = "select '{0}' as counter, case when {1} = '' then 'unspecified' else {1} end as key, count(*) as rows from placed group by all"


@query(f"with {S.SPLIT} " + " union all ".join(_C.format(k, v) for k, v in {"split": "assigned_split", "declared_split": S.split_norm("split"), "task_family": "task_family", "difficulty": "difficulty"}.items()))
def audit_counters(spark: SparkSession, d: str) -> DataFrame:
    return audit.counters(good_of(spark, d))


_L = "select '{0}' as field, count(*) as count, min(n)::bigint as minimum, max(n)::bigint as maximum, avg(n) as mean, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.9) as p90, quantile_cont(n, 0.99) as p99 from (select {1} as n from good)"


@query(f"with {S.REASONS} " + " union all ".join(_L.format(k, v) for k, v in {"system_chars": "length(system)", "user_chars": 'length("user")', "assistant_chars": "length(assistant)", "combined_chars": 'length(system) + length("user") + length(assistant)'}.items()))
def audit_lengths(spark: SparkSession, d: str) -> DataFrame:
    return audit.lengths(validate.accepted(rows_of(spark, d)))


@query(f"with {S.SPLIT} select line, content_hash, group_key, assigned_split from placed")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return good_of(spark, d).select("line", "content_hash", "group_key", "assigned_split")


@query(f"with {S.SPLIT} select line, case when s in ('train', 'val', 'test') then s else assigned_split end as assigned_split from (select *, {S.split_norm('split')} as s from placed)")
def split_declared(spark: SparkSession, d: str) -> DataFrame:
    return audit.with_split(validate.accepted(rows_of(spark, d)), respect_declared=True).select("line", "assigned_split")


@query(f"with {S.SPLIT} select assigned_split, task_family, count(*) as rows, sum(length(\"user\") + length(assistant))::bigint as chars from placed group by all")
def split_balance(spark: SparkSession, d: str) -> DataFrame:
    return good_of(spark, d).groupBy("assigned_split", "task_family").agg(F.count("*").alias("rows"), F.sum(F.length("user") + F.length("assistant")).alias("chars"))


@query()
def split_blake2b(spark: SparkSession, d: str) -> DataFrame:
    g = good_of(spark, d).withColumn("unit", keyed_unit_interval(1337)(F.col("group_key")))
    return g.select("line", audit.assigned(F.col("unit"), None, 0.9, 0.05).alias("assigned_split"), "unit")


@query()
def split_text_hash(spark: SparkSession, d: str) -> DataFrame:
    """The older split: an unkeyed 64-bit hash of seed and text over 2**64 - 1, fractions to 1e-6."""
    h = rows_of(spark, d).select("line", row_hash(1337)(dedup.normalized_content()).alias("h"))
    unit = (F.col("h").cast("decimal(20,0)") + F.when(F.col("h") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(0)).cast("double") / float(2**64 - 1)
    return h.select("line", "h", audit.assigned(unit, None, 0.9, 0.05).alias("assigned_split"))


@query(f"with {S.REASONS}, f as (select line, sha256({S.FINGERPRINT}) as text_hash from good) select line, text_hash, case when line > m then m end as exact_of from (select *, min(line) over (partition by text_hash) as m from f)")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_duplicates(validate.accepted(rows_of(spark, d))).select("line", "text_hash", "exact_of")


_VOTES = ", ".join(f"sum(case when (h >> {b}) & 1 = 1 then tf else -tf end) as b{b}" for b in range(60))
_FP = " + ".join(f"case when b{b} >= 0 then {1 << b}::bigint else 0 end" for b in range(60))
_SIMHASH = f"""with {S.REASONS}, f as (select line, {S.words(S.TEXT)} as ws, min(line) over (partition by {S.FINGERPRINT}) as m from good),
 left_rows as (select line, ws from f where line = m), tok as (select line, w, count(*) as tf from (select line, unnest(ws) as w from left_rows) group by all),
 v as (select w, ('0x' || substr(sha256(w), 1, 15))::bigint as h from (select distinct w from tok)), votes as (select line, {_VOTES} from tok join v using (w) group by line),
 fps as (select line, coalesce({_FP}, 0) as fp from left_rows left join votes using (line))"""


@query(_SIMHASH + " select line, case when exists (select 1 from tok where tok.line = fps.line) then fp else 0 end as fp from fps")
def dedup_simhash(spark: SparkSession, d: str) -> DataFrame:
    x = dedup.exact_duplicates(validate.accepted(rows_of(spark, d)), None, simhash("sha256", "lower")(dedup.normalized_content()).alias("fp"))
    return x.where("exact_of is null").select("line", "fp")


_BANDS = "bands as (select line, fp, unnest([0, 1, 2, 3]) as k, (fp >> (15 * unnest([0, 1, 2, 3]))) & 32767 as v from fps)"


@query(_SIMHASH + f", {_BANDS} select r.line, min(l.line) as near_of from bands r join bands l using (k, v) where l.line < r.line and bit_count(xor(l.fp, r.fp)) <= 3 group by r.line")
def dedup_near(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates(validate.accepted(rows_of(spark, d)), 3, "sha256", "lower").where("near_of is not null").select("line", "near_of")


@query()
def dedup_near_blake2b(spark: SparkSession, d: str) -> DataFrame:
    """Exact and near duplicates as the audit counts them, by 64-bit fingerprints of case-folded words."""
    x = dedup.near_duplicates(validate.accepted(rows_of(spark, d)))
    return x.agg(F.count("exact_of").alias("exact_duplicate_content_rows"), F.count("near_of").alias("near_duplicate_content_rows"))


@query(f"with {S.SPLIT} select line, content_hash, assigned_split as split, first_value(assigned_split) over (partition by content_hash order by line) <> assigned_split as crosses from placed")
def dedup_cross_split(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cross_split(good_of(spark, d).select("line", "content_hash", F.col("assigned_split").alias("split"))).select("line", "content_hash", "split", "crosses")


@query("select count(*) as rows, count(distinct coalesce(text, '')) as distinct_rows, count(*) - count(distinct coalesce(text, '')) as duplicate_rows, (count(*) - count(distinct coalesce(text, ''))) / count(*) as duplicate_rate from documents")
def dedup_rate(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_rate(table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "h")


_SCAN = f"{S.CONV}, scan as (select line, {S.HASH} as hash, {S.split_norm('split')} as split from conv)"


def _scan(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.hashing import content_hash

    return rows_of(spark, d).select("line", content_hash("system", "user", "assistant").alias("hash"), normalized_split("split").alias("split"))


_STATUS = f"with {_SCAN}, st as (select *, case when line > min(line) over (partition by hash, split) then 'known_same_split' when line > min(line) over (partition by hash) then 'cross_split_duplicate' else 'new' end as status from scan)"


@query(_STATUS + " select line, hash, split, status from st")
def leakage_status(spark: SparkSession, d: str) -> DataFrame:
    return dedup.leakage_status(_scan(spark, d)).select("line", "hash", "split", "status")


@query(_STATUS + " select status, count(*) as rows from st group by status")
def leakage_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedup.leakage_status(_scan(spark, d)).groupBy("status").agg(F.count("*").alias("rows"))


@query(f"with {_SCAN} select hash, array_to_string(list_sort(list(distinct split)), ',') as splits, count(*) as tasks, min(line) as first_seen, max(line) as last_seen from scan group by hash")
def leakage_manifest(spark: SparkSession, d: str) -> DataFrame:
    return dedup.leakage_manifest(_scan(spark, d), "line").withColumn("splits", F.array_join("splits", ","))


@query(f"with {_SCAN}, m as (select distinct hash, split from scan where split = 'train'), t as (select * from scan where split in ('val', 'test')) select line, hash, split, case when line > min(line) over (partition by hash, split) then 'known_same_split' when hash in (select hash from m) or line > min(line) over (partition by hash) then 'cross_split_duplicate' else 'new' end as status from t")
def leakage_against_train(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d)
    return dedup.leakage_status(s.where("split in ('val', 'test')"), s.where("split = 'train'").select("hash", "split")).select("line", "hash", "split", "status")


@query(f"select row_id as line, {S.collapse('user_text')} as collapsed, array_to_string({S.words('user_text')}, ' ') as fingerprint, {S.unit('row_id::varchar', 7)} as unit from chat_examples")
def text_primitives(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import collapse

    c = table(spark, d, "chat_examples")
    return c.select(F.col("row_id").alias("line"), collapse("user_text").alias("collapsed"), fingerprint_text("user_text").alias("fingerprint"), unit_interval(F.col("row_id").cast("string"), 7).alias("unit"))


@query()
def text_folded(spark: SparkSession, d: str) -> DataFrame:
    """Characters that full case folding and NFKC change, by language."""
    c = table(spark, d, "chat_examples").select("lang", casefold(F.col("user_text")).alias("folded"), nfkc(F.col("user_text")).alias("formed"), "user_text")
    return c.groupBy("lang").agg(F.count_if(F.col("folded") != F.lower("user_text")).alias("folded_rows"), F.count_if(F.col("formed") != F.col("user_text")).alias("formed_rows"))
