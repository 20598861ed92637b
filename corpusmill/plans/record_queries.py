"""Problem 6: records that load, records that don't, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..session import table
from . import sql as S
from .registry import query

_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_AT = {f: f"f[{i}]" for i, f in enumerate(records.FIELDS, 1)}
_STRING = r'"(?:\\.|[^"\\])*"'
_META = _AT["metadata_json"]
#: JSON without NaN, Infinity and trailing commas, which DuckDB lets pass
_STRICT = f"case when json_valid({_META}) and not regexp_matches(regexp_replace({_META}, '{_STRING}', '0', 'g'), '(?i)nan|inf|,\\s*[\\]}}]') then json_type({_META}) = 'OBJECT' else false end"
#: with clause: every record with its fields and the first reason that applies
_READ = f"""raw as (select raw_id, source, line_no, coalesce(raw_line, '') as x from raw_rows),
 cells as (select *, list_transform(regexp_extract_all(',' || x, ',{_FIELD}', 1), lambda c: case when c[1] = '"' then replace(c[2:len(c) - 1], '""', '"') else c end) as f, regexp_full_match(x, '{_FIELD}(,{_FIELD})*') as quoted from raw),
 r as (select *, case when not quoted then 'quoting' when len(f) <> 10 then 'column_count' when {S.strip(_AT['user'])} = '' then 'empty_user' when {S.strip(_AT['assistant'])} = '' then 'empty_assistant'
 when lower({S.strip(_AT['split'])}) not in ('', {', '.join(repr(x) for x in records.SPLITS)}) then 'unknown_split' when {S.strip(_META)} <> '' and not {_STRICT} then 'invalid_metadata' end as reason from cells)"""


@query(f"with {_READ} select raw_id, reason from r where reason is not null")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_rows")
    return records.rejected(raw.select("raw_id", "raw_line"), records.strict_load(raw)).select("raw_id", "reason")


@query(f"with {_READ} select raw_id, source, line_no, " + ", ".join(f'{c} as "{k}"' for k, c in _AT.items()) + " from r where reason is null")
def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The conforming records as the ten fields, beside where they came from."""
    raw = table(spark, d, "raw_rows")
    return records.strict_load(raw).join(raw.select("raw_id", "source", "line_no"), "raw_id")


@query(f"with {_READ} select source, count(*) as rows, count(reason) as rejected_rows, count(*) filter (reason = 'invalid_metadata') as invalid_metadata_rows from r group by source")
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """By source: rows, and the rejected and invalid-metadata rows as a dataset audit counts them."""
    raw = table(spark, d, "raw_rows")
    bad = records.rejected(raw.select("raw_id", "raw_line"), records.strict_load(raw)).select("raw_id", "reason")
    return (
        raw.select("raw_id", "source")
        .join(bad, "raw_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("rows"), F.count("reason").alias("rejected_rows"), F.count_if(F.col("reason") == "invalid_metadata").alias("invalid_metadata_rows"))
    )
