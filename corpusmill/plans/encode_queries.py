"""Encoding, packing and compiled datasets over accepted chat_examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bytes_text, utf8_bytes
from ..operators import batches, compiled, corpus, encode, metrics, validate
from ..session import table
from . import sql as S
from .audit_queries import good_of, rows_of
from .registry import query


def _bytes(c: str) -> str:
    return f"list_transform(range(octet_length(encode({c}))), lambda i: ('0x' || substr(hex(encode({c})), 2 * i + 1, 2))::int)"


_PARTS = f"""with {S.SPLIT}, parts as (select line, assigned_split, system, "user", assistant, [256] || case when system <> '' then [258] || {_bytes('system')} || [257] else [] end || [259] || {_bytes('"user"')} || [257] as p, {_bytes('assistant')} || [257] as t from placed)"""
_ENC = (
    _PARTS
    + """, kept as (select *, len(t) + 1 as need, 512 - len(t) - 1 as room from parts),
 k2 as (select *, case when len(p) <= room then p when room <= 1 then [256] else [256] || p[len(p) - room + 2:] end as kp from kept),
 enc as (select line, assigned_split, system, "user", assistant, case when need >= 512 then [260] || t[1:511] else kp || [260] || t end as ids, case when need >= 512 then 1 else len(kp) + 1 end as first, need >= 512 or len(p) + need > 512 as truncated from k2)"""
)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_chat(good_of(spark, d))


@query(f"with c as (select row_id as line, assistant_text as x from chat_examples where assistant_text is not null) select line, octet_length(encode(x))::bigint as n_bytes, sha256(array_to_string({_bytes('x')}, ',')) as ids from c")
def tokens_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_examples").where("assistant_text is not null")
    return c.select(F.col("row_id").alias("line"), F.octet_length("assistant_text").cast("long").alias("n_bytes"), F.sha2(F.array_join(utf8_bytes("assistant_text"), ","), 256).alias("ids"))


@query("select row_id as line, true as same from chat_examples where user_text is not null")
def tokens_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chat_examples").where("user_text is not null")
    return c.select(F.col("row_id").alias("line"), (bytes_text(utf8_bytes("user_text")) == F.col("user_text")).alias("same"))


@query(_ENC + " select line, len(ids)::int as input_token_count, (len(ids) - first)::int as target_token_count, truncated, sha256(array_to_string(ids, ',')) as ids, sha256(array_to_string(list_transform(ids, lambda x, i: case when i <= first then -100 else x end), ',')) as labels from enc")
def encode_examples(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("line", F.size("input_ids").alias("input_token_count"), "target_token_count", "truncated", F.sha2(F.array_join("input_ids", ","), 256).alias("ids"), F.sha2(F.array_join("labels", ","), 256).alias("labels"))


@query(_PARTS + " select line, least(len(p) + 1 + len(t), 512)::int as input_token_count, greatest(least(len(p) + 1 + len(t), 512) - len(p) - 1, 0)::int as target_token_count, len(p) + 1 + len(t) > 512 as truncated from parts")
def encode_cut_tail(spark: SparkSession, d: str) -> DataFrame:
    e = encode.encode_chat(good_of(spark, d), keep_target=False)
    return e.select("line", F.size("input_ids").alias("input_token_count"), "target_token_count", "truncated")


@query(_PARTS + " select line, sha256(array_to_string(case when len(p) + 1 <= 256 then p || [260] else [256] || (p || [260])[len(p) + 1 - 254:] end, ',')) as ids from parts")
def encode_prompts(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_prompt(good_of(spark, d), 256).select("line", F.sha2(F.array_join("prompt_ids", ","), 256).alias("ids"))


_BATCHED = ", ordered as (select *, row_number() over (order by line) - 1 as ordinal from enc), batched as (select *, ordinal // 64 as batch_id from ordered)"


@query(_ENC + _BATCHED + " select line, batch_id, max(len(ids)) over (partition by batch_id)::int as width, len(ids)::int as kept from batched")
def encode_padded(spark: SparkSession, d: str) -> DataFrame:
    b = encode.pad_batches(encode.in_batches(_encoded(spark, d), 64))
    return b.select("line", "batch_id", F.size("input_ids").alias("width"), F.size(F.filter("attention_mask", lambda x: x)).alias("kept"))


@query(_ENC + _BATCHED + ", p as (select batch_id, len(ids)::bigint as n, max(len(ids)) over (partition by batch_id) as w from batched) select batch_id, sum(n)::bigint as valid_tokens, sum(w)::bigint as positions, round(1 - sum(n) / sum(w), 9) as padding_fraction from p group by batch_id")
def encode_padding_fraction(spark: SparkSession, d: str) -> DataFrame:
    b = encode.in_batches(_encoded(spark, d).select("line", F.size("input_ids").alias("n")), 64)
    b = b.join(b.groupBy("batch_id").agg(F.max("n").alias("w")), "batch_id")
    m = metrics.padding_fraction(b, F.col("n"), F.col("w"), "batch_id")
    return m.withColumn("padding_fraction", F.round("padding_fraction", 9))


_FOLD = (
    _ENC.replace("with ", "with recursive ", 1)
    + _BATCHED
    + ", n as (select batch_id, ordinal, line, len(ids)::int as n from batched), fold as (select batch_id, ordinal, line, n, 0 as bin, 0 as start, n as used from n where ordinal % 64 = 0 union all select x.batch_id, x.ordinal, x.line, x.n, case when f.used + x.n > 1024 then f.bin + 1 else f.bin end, case when f.used + x.n > 1024 then 0 else f.used end, case when f.used + x.n > 1024 then x.n else f.used + x.n end from fold f join n x on x.ordinal = f.ordinal + 1 and x.batch_id = f.batch_id)"
)


@query(_FOLD + " select batch_id, line, n, bin, start from fold")
def encode_packing(spark: SparkSession, d: str) -> DataFrame:
    b = encode.in_batches(_encoded(spark, d).select("line", F.size("input_ids").alias("n")), 64)
    return encode.next_fit(b, 1024)


@query(_FOLD + " select batch_id, bin, 1024 as width, sum(n)::int as filled, sum(n - greatest(first, 1))::int as targets, count(*)::int as segments from fold join (select line, first from enc) using (line) group by batch_id, bin")
def encode_packed_rows(spark: SparkSession, d: str) -> DataFrame:
    e = _encoded(spark, d)
    placed = encode.next_fit(encode.in_batches(e.select("line", F.size("input_ids").alias("n")), 64), 1024)
    r = encode.packed_rows(e, placed, 1024)
    count = lambda c, bad: F.size(F.filter(c, lambda x: x != bad))
    return r.select("batch_id", "bin", F.size("input_ids").alias("width"), count("segment_ids", -1).alias("filled"), count("labels", encode.IGNORE).alias("targets"), (F.array_max("segment_ids") + 1).alias("segments"))


@query(
    _ENC
    + " select s.split, coalesce(examples, 0) as examples, coalesce(input_tokens, 0)::bigint as input_tokens, coalesce(target_tokens, 0)::bigint as target_tokens, coalesce(truncated_examples, 0) as truncated_examples, coalesce(raw_utf8_bytes, 0)::bigint as raw_utf8_bytes, coalesce(target_utf8_bytes, 0)::bigint as target_utf8_bytes from (values ('train'), ('val'), ('test')) s(split) left join (select assigned_split as split, count(*) as examples, sum(len(ids)) as input_tokens, sum(len(ids) - first) as target_tokens, count(*) filter (truncated) as truncated_examples, sum(octet_length(encode(system)) + octet_length(encode(\"user\")) + octet_length(encode(assistant))) as raw_utf8_bytes, sum(octet_length(encode(assistant))) as target_utf8_bytes from enc group by 1) x using (split)"
)
def compiled_summary(spark: SparkSession, d: str) -> DataFrame:
    return compiled.split_summary(_encoded(spark, d))


@query()
def compiled_order(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs' orders of all documents: each a permutation."""
    docs = encode.with_ordinal(table(spark, d, "documents").select(F.col("doc_id").alias("line")))
    n = docs.count()
    both = [encode.affine_order(docs, n, 99, e).withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return both[0].union(both[1])


@query("select line, (row_number() over (order by line) - 1) as ordinal, (row_number() over (order by line) - 1) // 32 as batch_id from (select doc_id as line from documents)")
def stream_batches(spark: SparkSession, d: str) -> DataFrame:
    return encode.in_batches(table(spark, d, "documents").select(F.col("doc_id").alias("line")), 32)


_TWICE = f"with {S.SPLIT}, v as (select line, row_number() over (order by line) - 1 as k from placed where assigned_split = 'val'), m as (select count(*) as m from v), p as (select unnest(range((2 * m + 63) // 64 * 64)) as p, m from m)"


@query(_TWICE + " select p // 64 as batch, (p % 64)::int as slot, (p // m)::int as epoch, line from p join v on v.k = p % m")
def stream_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Two epochs of the validation rows in batches of 64, saved after the second batch and taken up again by another stream."""
    rows = good_of(spark, d).select("line", "assigned_split")
    one, two = (batches.Batches(rows, "val", 64, "chat_examples") for _ in "ab")
    head = one.take(2)
    two.load(one.saved())
    return head.union(two.take(-(-2 * two.matches // 64) - 2)).select("batch", "slot", "epoch", "line")


@query("with b as (select doc_id as line, list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::int + 3) as b from documents) select line, least(len(b), 126)::int + 2 as n, sha256(array_to_string([1] || b[1:126] || [2] || list_transform(range(126 - least(len(b), 126)), lambda i: 0), ',')) as ids from b")
def old_encoding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("line"), "text")
    return encode.old_byte_encode(docs, "text").select("line", "n", F.sha2(F.array_join("ids", ","), 256).alias("ids"))


@query(f"with {S.CONV} select line, sha256(case when system <> '' then 'SYSTEM:' || chr(10) || system || chr(10) || chr(10) else '' end || 'USER:' || chr(10) || \"user\" || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) || assistant) as text from conv where \"user\" <> '' and assistant <> ''")
def old_rendering(spark: SparkSession, d: str) -> DataFrame:
    """The older one-text form of a conversation."""
    return corpus.rendered(rows_of(spark, d).where("user <> '' and assistant <> ''"), "user", "assistant").select("line", F.sha2("rendered", 256).alias("text"))


@query(f"with {S.REASONS} select line, \"user\" from good where line <= 1000")
def row_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand records, of which the valid ones load: a limit counts records, not accepted rows."""
    return validate.accepted(rows_of(spark, d).where("line <= 1000")).select("line", "user")
