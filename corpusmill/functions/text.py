"""Text primitives: white space, words, case folding and normal forms."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: fixed values: the characters that count as white space (as str.split and str.strip see them), for Java's regex
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: A word is a run of letters, digits and underscores in any script.
WORDS = r"[\p{L}\p{N}_]+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same characters one by one, for trimming without a regular expression.
_SPACE_CHARS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _text(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


def _is_ascii(c: Column) -> Column:
    """Most texts are: they take patterns of plain ranges, several times as fast as Unicode classes."""
    return F.octet_length(c) == F.char_length(c)


def strip(c: Column | str) -> Column:
    """Without white space at either end; null becomes empty."""
    return F.btrim(_text(c), F.lit(_SPACE_CHARS))


def collapse(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends; null becomes empty."""
    t = _text(c)
    return F.btrim(F.when(_is_ascii(t), F.regexp_replace(t, r"[\x09-\x0D\x1C-\x20]+", " ")).otherwise(F.regexp_replace(t, f"{SPACE}+", " ")))


def words(c: Column | str) -> Column:
    """The words of a text in lower case, in order; null has none."""
    t = F.lower(_text(c))
    return F.when(_is_ascii(t), F.regexp_extract_all(t, F.lit("[a-z0-9_]+"), 0)).otherwise(F.regexp_extract_all(t, F.lit(WORDS), 0))


def fingerprint_text(c: Column | str) -> Column:
    """The words joined by single spaces: equal for texts that differ in case, punctuation and spacing only."""
    t = F.lower(_text(c))
    return F.btrim(F.when(_is_ascii(t), F.regexp_replace(t, "[^a-z0-9_]+", " ")).otherwise(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " ")))


@F.arrow_udf(StringType())
def casefold(texts: pa.Array) -> pa.Array:
    """Full Unicode case folding, which lower() doesn't do for some 300 characters (ß, ſ, µ ...)."""
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode normal form NFKC."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(IntegerType()))
def _bytes_of(texts: pa.Array) -> pa.Array:
    data = texts.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    body = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(body))


def utf8_bytes(c: Column | str) -> Column:
    """The bytes of a text as array<int>; null has none. One Arrow call a batch, without a Python loop over rows."""
    return _bytes_of(F.coalesce(as_column(c), F.lit("")))


def bytes_text(c: Column | str) -> Column:
    """The text of an array of token ids; ids above 255 are left out, malformed bytes become U+FFFD."""
    kept = F.filter(as_column(c), lambda x: x < 256)
    return F.decode(F.unhex(F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")
