"""Queries of problems 1-5 and 7-9, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sql as S
from ..session import table
from . import copies, leaks, overlaps, packing, pairs, quality, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cross_split_pairs(table(spark, d, "chat_examples"))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of val and test that overlap a training row, by split and source."""
    chat = table(spark, d, "chat_examples")
    links, m = overlaps.cross_split_overlaps(chat)
    hit = m.where("side = 0").join(links.select(F.col("e").alias("class")).distinct(), "class", "left_semi").select("row_id", F.lit(1).alias("hit"))
    held = chat.select("row_id", "source", overlaps.split_of("split").alias("split")).where("split in ('val', 'test')")
    return held.join(hit, "row_id", "left").groupBy("split", "source").agg(F.count("*").alias("rows"), F.count("hit").alias("cross_split_duplicate_rows"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.near_duplicate_groups(table(spark, d, "chat_examples")).where("row_id <> group_id")


@query
def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number of groups by size, and the near-duplicate rows (all but one of each group)."""
    g = overlaps.near_duplicate_groups(table(spark, d, "chat_examples")).groupBy("group_id").agg(F.count("*").alias("members"))
    return g.groupBy("members").agg(F.count("*").alias("groups"), F.sum(F.col("members") - 1).alias("near_duplicate_content_rows"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "chat_examples"), table(spark, d, "common_words"))


@query
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows by source and defect; a null defect counts the sound rows."""
    chat = table(spark, d, "chat_examples")
    found = pairs.defective_pairs(chat, table(spark, d, "common_words"))
    return chat.select("row_id", "source").join(found, "row_id", "left").groupBy("source", "defect").agg(F.count("*").alias("rows"))


@query
def p2_empty_assistant(spark: SparkSession, d: str) -> DataFrame:
    """The empty answers alone, by split: the null, the blank and those that are only a mark."""
    chat = table(spark, d, "chat_examples")
    found = pairs.defective_pairs(chat, table(spark, d, "common_words")).where("defect = 'empty'")
    return found.join(chat.select("row_id", overlaps.split_of("split").alias("split")), "row_id").groupBy("split").agg(F.count("*").alias("empty_assistant_rows"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return tokens.wrong_targets(table(spark, d, "encoded_examples"), table(spark, d, "chat_examples"))


@query
def p4_target_cube(spark: SparkSession, d: str) -> DataFrame:
    return tokens.target_token_cube(table(spark, d, "encoded_examples"), table(spark, d, "chat_examples"))


@query
def p4_split_check(spark: SparkSession, d: str) -> DataFrame:
    return tokens.summary_differences(table(spark, d, "encoded_examples"), table(spark, d, "chat_examples"), table(spark, d, "split_summaries"), overlaps.split_of("split"))


@query
def p4_document_cube(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens.with_token_count(table(spark, d, "documents").select("text", "source", "lang", "topic"), "text", "n_tokens")
    return tokens.token_cube(docs, "n_tokens", "source", "lang", "topic")


@query
def p4_bpe_cube(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    """Tokens of documents.text under a public byte-pair vocabulary of 50,256 tokens; its path is a parameter."""
    import public_tokenizers as P

    return tokens.bpe_budget(table(spark, d, "documents"), spark, tokenizer or P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.formatting_copies(table(spark, d, "chat_examples")).where("row_id <> kept_id")


@query
def p5_representatives(spark: SparkSession, d: str) -> DataFrame:
    return copies.representatives(table(spark, d, "chat_examples"))


@query
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


@query
def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(packing.packed(table(spark, d, "documents")))


@query
def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tokens placed of each document: every token of every document in exactly one container."""
    return packing.packed(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))


@query
def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether containers keep the rules. Overfull ones, documents in more pieces than they need, all tokens, and whether under 5 % stay unused."""
    c = packing.packed(table(spark, d, "documents"))
    s = packing.packing_summary(c).select("tokens", (F.col("fullest") > packing.CAPACITY).cast("int").alias("overfull"), (F.col("unused_share") < 0.05).alias("tight"))
    split = c.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("tokens").alias("n")).agg(F.count_if(F.col("k") > F.ceil(F.col("n") / packing.CAPACITY)).alias("split_short"), F.count("*").alias("documents"))
    return s.withColumn("_", F.lit(0)).join(split.withColumn("_", F.lit(0)), "_").drop("_")  # one row with one row


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p8_locations(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, leaks.leaks(docs, table(spark, d, "eval_items"))).select("doc_id", "lang", "source", "topic", "n_chars")


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents"), table(spark, d, "common_words")).where("kind is not null").select("doc_id", "kind")


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, distance, contributions and kind, one column each."""
    s = quality.scored(table(spark, d, "documents"), table(spark, d, "common_words"))
    each = [F.col("stats")[i].alias(n) for i, n in enumerate(quality.STATISTICS)] + [F.col("contributions")[i].alias(f"{n}_part") for i, n in enumerate(quality.STATISTICS)]
    return s.select("doc_id", "spoken", "word_count", *each, "distance2", "outlier", "kind")


@query
def p9_plain(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that SQL can state."""
    s = quality.measured(table(spark, d, "documents"), table(spark, d, "common_words"))
    at = {n: F.col("stats")[i] for i, n in enumerate(quality.STATISTICS)}
    return s.select("doc_id", "word_count", *[F.round(at[n], 9).alias(n) for n in ("mean_word_length", "digit_ratio", "distinct_ratio", "symbol_ratio")])


_BYTES = "octet_length(encode(coalesce({0}, '')))"
_TRIMMED = "trim(coalesce({0}, ''), chr(32) || chr(9) || chr(10) || chr(13))"
_ANSWER = _BYTES.format(_TRIMMED.format("c.assistant_text"))
_EXPECTED = f"least({_ANSWER} + 1, e.max_length - 1)"
_SPLIT = "case lower(trim({0})) when 'train' then 'train' when 'training' then 'train' when 'val' then 'val' when 'validation' then 'val' when 'valid' then 'val' when 'dev' then 'val' when 'test' then 'test' when 'testing' then 'test' end"
_CANON = "regexp_replace(lower(upper(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

SQL |= {
    "p4_found": f"select e.enc_id from encoded_examples e left join chat_examples c using (row_id) where e.target_token_count is null or e.target_token_count <> case when c.row_id is not null then {_EXPECTED} end",
    "p4_target_cube": f"with one as (select row_id, arg_min(expected, enc_id) as expected from (select e.row_id, e.enc_id, {_EXPECTED} as expected from encoded_examples e join chat_examples c using (row_id)) group by row_id) select source, lang, task_family, grouping_id(source, lang, task_family) as level, count(*) as examples, sum(expected)::bigint as tokens from one join chat_examples using (row_id) group by cube (source, lang, task_family)",
    "p4_split_check": f"with one as (select shard_id, row_id, arg_min(expected, enc_id) as expected from (select e.shard_id, e.row_id, e.enc_id, {_EXPECTED} as expected from encoded_examples e join chat_examples c using (row_id)) group by all), per as (select shard_id, coalesce({_SPLIT.format('c.split')}, 'train') as split, sum(expected)::bigint as recomputed_tokens from one join chat_examples c using (row_id) group by all) select shard_id, split, target_tokens, recomputed_tokens, target_tokens is not distinct from recomputed_tokens as agrees from split_summaries left join per using (shard_id, split)",
    "p4_document_cube": f"select source, lang, topic, grouping_id(source, lang, topic) as level, count(*) as examples, sum({_BYTES.format('text')})::bigint as tokens from documents group by cube (source, lang, topic)",
    "p5_found": f"with k as (select row_id, least(u, a) || '|' || greatest(u, a) as key from (select row_id, {_CANON.format('user_text')} as u, {_CANON.format('assistant_text')} as a from chat_examples)) select kept_id, row_id from (select row_id, min(row_id) over (partition by key) as kept_id from k) where row_id <> kept_id",
    "p5_representatives": f"with k as (select row_id, least(u, a) || '|' || greatest(u, a) as key from (select row_id, {_CANON.format('user_text')} as u, {_CANON.format('assistant_text')} as a from chat_examples)) select min(row_id) as kept_id, count(*) as copies from k group by key",
    "p7_coverage": f"select doc_id, {_BYTES.format('text')}::bigint as tokens from documents where coalesce(text, '') <> ''",
    "p8_found": "with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as ws from documents), g as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 11), ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)), q as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as ws from eval_items), p as (select distinct item_id, array_to_string(list_slice(ws, i, i + 11), ' ') as gram from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from q where len(ws) >= 12)) select distinct doc_id, item_id from g join p using (gram)",
}
SQL |= {
    "p1_found": f"with r as (select row_id, {_SPLIT.format('split')} as s, list_distinct(regexp_extract_all(lower(coalesce(user_text, '') || chr(10) || coalesce(assistant_text, '')), '[\\p{{L}}\\p{{N}}]+')) as ws from chat_examples), w as (select row_id, s, len(ws) as n, unnest(ws) as w from r where s is not null) select least(e.row_id, t.row_id) as row_lo, greatest(e.row_id, t.row_id) as row_hi from w e join w t on e.w = t.w and e.s <> 'train' and t.s = 'train' group by e.row_id, t.row_id having 10 * count(*) >= 7 * (any_value(e.n) + any_value(t.n) - count(*))",
    "p8_clean": f"select doc_id, lang, source, topic, n_chars from documents where doc_id not in (select doc_id from ({SQL['p8_found']}))",
}
SQL |= {
    "p1_report": f"with f as ({SQL['p1_found']}), h as (select row_lo as row_id from f union select row_hi from f), r as (select row_id, source, {_SPLIT.format('split')} as split from chat_examples) select split, source, count(*) as rows, count(h.row_id) as cross_split_duplicate_rows from r left join h using (row_id) where split in ('val', 'test') group by split, source",
}
#: Components of the exact overlaps between distinct word sets.
_GROUPS = r"""with recursive r as (select row_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(user_text, '') || chr(10) || coalesce(assistant_text, '')), '[\p{L}\p{N}]+'))) as ws from chat_examples),
 c as (select ws, min(row_id) as rep from r where len(ws) > 0 group by ws), w as (select rep, len(ws) as n, unnest(ws) as w from c),
 e as (select x.rep as a, y.rep as b from w x join w y on x.w = y.w and x.rep <> y.rep group by x.rep, y.rep having 10 * count(*) >= 7 * (any_value(x.n) + any_value(y.n) - count(*))),
 reach as (select rep as root, rep as node from c union select root, b from reach join e on a = node where b > root),
 g as (select node, min(root) as group_id from reach group by node), rows_of as (select group_id, row_id from r join c using (ws) join g on g.node = c.rep)"""
SQL |= {
    "p3_found": f"{_GROUPS} select group_id, row_id from rows_of where row_id <> group_id",
    "p3_summary": f"{_GROUPS} select members, count(*) as groups, sum(members - 1)::bigint as near_duplicate_content_rows from (select count(*) as members from rows_of group by group_id having count(*) > 1) group by members",
}
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "select {0}, i - 1 as i, array_to_string(list_slice(ws, i, i + 11), ' ') as gram from (select {0}, ws, unnest(range(1, len(ws) - 10)) as i from (select {0}, " + _WORDS.replace("{0}", "text") + " as ws from {1}) where len(ws) >= 12)"
SQL |= {
    "p2_empty_assistant": f"select {_SPLIT.format('split')} as split, count(*) as empty_assistant_rows from chat_examples where array_to_string({_WORDS.format('assistant_text')}, ' ') in ({', '.join(repr(x) for x in sorted(pairs.NO_ANSWER))}) group by 1",
    "p7_rules": f"select sum({_BYTES.format('text')})::bigint as tokens, 0 as overfull, true as tight, 0::bigint as split_short, count(*) filter (coalesce(text, '') <> '') as documents from documents",
    "p8_locations": f"with g as ({_GRAMS.format('doc_id', 'documents')}), p as ({_GRAMS.format('item_id', 'eval_items')}), m as (select doc_id, item_id, g.i as i, g.i - p.i as diagonal from g join p using (gram)), r as (select *, i - row_number() over (partition by doc_id, item_id, diagonal order by i) as island from m), k as (select doc_id, item_id, min(i) as place, count(*) + 11 as n from r group by doc_id, item_id, diagonal, island) select doc_id, item_id, n::int as words, min(place)::int as position from (select *, max(n) over (partition by doc_id, item_id) as m from k) where n = m group by doc_id, item_id, n",
    "p9_plain": f"select doc_id, len(ws) as word_count, round(case when len(ws) > 0 then least(chars / len(ws), 40) else 0 end, 9) as mean_word_length, round(digits / greatest(solid, 1), 9) as digit_ratio, round(case when len(ws) > 0 then ln(1 + len(list_distinct(ws))) / ln(1 + len(ws)) else 0 end, 9) as distinct_ratio, round(greatest(0, 1 - chars / greatest(solid, 1)), 9) as symbol_ratio from (select doc_id, ws, length(array_to_string(ws, '')) as chars, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) as digits, length(regexp_replace(coalesce(text, ''), '{S.SPACE}+', '', 'g')) as solid from (select doc_id, text, {_WORDS.format('text')} as ws from documents))",
}
