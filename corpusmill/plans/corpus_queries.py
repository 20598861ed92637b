"""Byte-pair vocabularies and one-text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpe, corpus, encode, grids
from ..session import table
from . import sql as S
from .audit_queries import rows_of
from .registry import query


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(line, part, text): the system, user and assistant texts of all rows."""
    return bpe.corpus(rows_of(spark, d))


@query()
def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    """Twenty merges trained on all texts of all rows."""
    merges, _ = bpe.train(_texts(spark, d), bpe.FIRST + 20)
    v = bpe.vocabulary(merges)
    return spark.createDataFrame([(i, a, b, v[bpe.FIRST + i].decode("utf-8", "replace")) for i, (a, b) in enumerate(merges)], "rank int, a int, b int, token string")


_PARTS = f"with {S.CONV.replace('conv as (', 'conv as materialized (')}, t as (select line, 0 as part, system as text from conv where system <> '' union all select line, 1, \"user\" from conv union all select line, 2, assistant from conv)"


def _coded(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    merges = bpe.train(t, bpe.FIRST + 20)[0]
    return bpe.decode(bpe.encode(t, "text", merges), "ids", merges, "back")


@query(_PARTS + " select line, part, true as same, octet_length(encode(text)) as bytes from t")
def bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every text of every row, encoded and decoded again."""
    return _coded(spark, d).select("line", "part", (F.col("back") == F.col("text")).alias("same"), F.octet_length("text").cast("long").alias("bytes"))


@query(_PARTS + " select part, count(*) as texts, sum(octet_length(encode(text)))::bigint as bytes, true as saves from t group by part")
def bpe_savings(spark: SparkSession, d: str) -> DataFrame:
    """By part: texts and bytes, and whether twenty merges save a twentieth of the tokens; a coder without merges saves nothing."""
    n = F.sum(F.octet_length("text"))
    return _coded(spark, d).groupBy("part").agg(F.count("*").alias("texts"), n.alias("bytes"), (F.sum(F.size("ids")) < 0.95 * n).alias("saves"))


@query(f"with {S.CONV}, p as (select line, 0 as part, system as text from conv where system <> '' union all select line, 1, \"user\" from conv union all select line, 2, assistant from conv), t as (select *, sum(octet_length(encode(text))) over (order by line, part) as total from p), s as (select min(line * 3 + part) as s from t where total > 200000) select line, part, octet_length(encode(text))::int as bytes from t, s where s is null or line * 3 + part < s")
def bpe_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The texts a vocabulary is trained on under a limit of 200,000 bytes: a prefix by definition of that limit."""
    return bpe.corpus(rows_of(spark, d), 200_000).select("line", "part", F.octet_length("text").alias("bytes"))


@query("with d as (select text, case lower(trim(coalesce(source, ''))) when 'train' then 'train' end as s from documents where trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) <> ''), r as (select regexp_replace(text, '^" + S.SPACE + "+|" + S.SPACE + "+$', '', 'g') as t from d) select count(*) as nonempty_rows, sum(length(t))::bigint as total_chars, sum(octet_length(encode(t)))::bigint as total_bytes, min(length(t)) as min_chars, max(length(t)) as max_chars, 0::bigint as declared_train, 0::bigint as declared_val, 0::bigint as declared_test, count(*) as declared_unknown, count(*) - count(distinct t) as duplicate_rows, (count(*) - count(distinct t)) / count(*) as duplicate_rate from r")
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit(corpus.rendered(table(spark, d, "documents"), "text"), declared_split="source")


@query("select count(*) as rows, avg(n) as mean_chars, max(n)::int as max_chars from (select length(regexp_replace(text, '^" + S.SPACE + "+|" + S.SPACE + "+$', '', 'g')) as n from documents where regexp_replace(coalesce(text, ''), '" + S.SPACE + "+', '', 'g') <> '' order by doc_id limit 1000)")
def corpus_inspection(spark: SparkSession, d: str) -> DataFrame:
    return corpus.inspection(corpus.rendered(table(spark, d, "documents"), "text"), "doc_id")


@query()
def corpus_old_split(spark: SparkSession, d: str) -> DataFrame:
    r = corpus.rendered(table(spark, d, "documents"), "text")
    unit, split = corpus.old_split("rendered")
    return r.select("doc_id", split.alias("split")).groupBy("split").agg(F.count("*").alias("rows"))


@query("select line, split from (select row_id as line, case lower(trim(split, chr(32) || chr(9) || chr(10) || chr(13))) when 'train' then 'train' when 'val' then 'val' when 'test' then 'test' end as split, row_number() over (partition by case lower(trim(split, chr(32) || chr(9) || chr(10) || chr(13))) when 'train' then 'train' when 'val' then 'val' when 'test' then 'test' end order by row_id) as k from chat_examples) where split is not null and k <= 25")
def corpus_head_samples(spark: SparkSession, d: str) -> DataFrame:
    r = rows_of(spark, d).select("line", F.lower("split").alias("split"))
    return corpus.head_samples(r, "split", "line", 25)


@query("select doc_id, row_number() over (order by sha256('7:0:' || doc_id) || doc_id) - 1 as place from documents")
def corpus_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their place in an epoch's order."""
    docs = table(spark, d, "documents").select("doc_id", corpus.shuffle_key("doc_id", 7, 0).alias("k"))
    return encode.with_ordinal(docs, "k", "place").select("doc_id", "place")


@query("select doc_id from documents")
def corpus_buffered(spark: SparkSession, d: str) -> DataFrame:
    """All documents through per-partition buffers: nothing lost, nothing twice. The order within is tested in the tests."""
    return corpus.buffer_shuffled(table(spark, d, "documents").select("doc_id"), 256, 7, 0)


@query()
def holdout_solved(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred hold-out tasks and the programs that solve them."""
    t = corpus.holdout_tasks(spark, 200, 5)
    r = grids.search(t).join(t.select("task_id", "rule", F.get("test", F.lit(0))["output"].alias("wanted")), "task_id")
    return r.select("task_id", "rule", "program", "solved", (F.get("predictions", F.lit(0)) == F.col("wanted")).alias("predicted"))


@query()
def needle_cases(spark: SparkSession, d: str) -> DataFrame:
    return corpus.needle_cases(spark, 500, 64, 2).select("case", F.size("prompt").alias("length"), "answer", F.get("prompt", F.array_position("prompt", F.element_at("prompt", -1)).cast("int")).alias("found"))
