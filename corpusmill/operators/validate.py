"""Validation of conversation rows: every reason a row is rejected for, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut

MAX_FIELD_CHARS = 1_000_000
#: metadata keys that name a group, in order of preference
GROUP_KEYS = ("group_id", "conversation_id", "source_id", "parent_id")


def metadata_valid(c: str = "metadata_json") -> Column:
    """Blank, or a JSON object."""
    return (F.col(c) == "") | F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def later_lines(rows: DataFrame) -> DataFrame:
    """(line) of every row whose id an earlier line has; blank ids never count.

    Only lines and ids are shuffled. The first line of an id is found by an aggregate, counted in each task before the
    shuffle, so an id that holds most rows fills no single task there; the join back is AQE's to split.
    """
    ids = rows.select("line", "id").where("id <> ''")
    first = ids.groupBy("id").agg(F.min("line").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("id", "_first")
    return ids.join(first, "id").where("line > _first").select("line")


def with_reasons(rows: DataFrame, max_chars: int = MAX_FIELD_CHARS) -> DataFrame:
    """rows with `reasons`: empty_user, empty_assistant, oversized_field, invalid_metadata_json, duplicate_id.

    An id is a duplicate on every line but its first, counting lines that are rejected for other reasons. The lines of
    duplicates are written first, so their size is known: few of them are broadcast and the texts stay where they are;
    many are joined by line, which no two rows share.
    """
    again = cut(later_lines(rows)).withColumn("_again", F.lit(True))
    over = F.greatest(*[F.length(c) for c in ("system", "user", "assistant")]) > max_chars
    reasons = F.array_compact(
        F.array(
            F.when(F.col("user") == "", "empty_user"),
            F.when(F.col("assistant") == "", "empty_assistant"),
            F.when(over, "oversized_field"),
            F.when(~metadata_valid(), "invalid_metadata_json"),
            F.when(F.col("_again"), "duplicate_id"),
        )
    )
    return rows.join(again, "line", "left").select(*rows.columns, reasons.alias("reasons"))


def accepted(rows: DataFrame) -> DataFrame:
    return with_reasons(rows).where(F.size("reasons") == 0).drop("reasons")


def rejection_sample(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` rejected rows by line: a report of fixed size."""
    return with_reasons(rows).where(F.size("reasons") > 0).select("line", F.nullif("id", F.lit("")).alias("id"), "reasons").orderBy("line").limit(limit)


def _named(v: Column, key: str) -> Column:
    """The value of a metadata key as text, if it is a string or a whole number (true and false count as such)."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    text = F.try_variant_get(v, f"$.{key}", "string")
    # whole numbers beyond 64 bits are decimals of over 18 digits without fraction; shorter ones were written with a point
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return F.when((kind == "STRING") | whole, text).when(kind == "BOOLEAN", F.initcap(text))


def group_key(content: Column, metadata: Column | None = None) -> Column:
    """The first group id in the metadata that isn't blank, as it is written, else the id, else the content hash; its kind stands in front.

    metadata: the parsed metadata_json, where it is at hand.
    """
    v = F.try_parse_json("metadata_json") if metadata is None else metadata
    from_meta = [F.when(strip(x) != "", F.concat(F.lit(f"metadata:{k}:"), x)) for k in GROUP_KEYS for x in [_named(v, k)]]
    return F.coalesce(*from_meta, F.when(F.col("id") != "", F.concat(F.lit("id:"), F.col("id"))), F.concat(F.lit("content:"), content))
