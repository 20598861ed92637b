"""Hashes: content identity, keyed unit intervals, similarity fingerprints.

Each has a form that any SQL engine can restate (SHA-256); where results must agree with BLAKE2b, an Arrow function does it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .text import as_column, collapse

_WORD = re.compile(r"\w+")
SCALE_60 = float(1 << 60)


def content_hash(system: str, user: str, assistant: str) -> Column:
    """SHA-256 of the canonical JSON object of the three texts, white space collapsed; case counts, fields are kept apart."""
    return F.sha2(F.to_json(F.struct(collapse(assistant).alias("assistant"), collapse(system).alias("system"), collapse(user).alias("user"))), 256)


def text_hash(fingerprint: Column | str) -> Column:
    return F.sha2(as_column(fingerprint), 256)


def unit_interval(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only: the first 60 bits of SHA-256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), as_column(key)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").cast("double") / F.lit(SCALE_60)


def keyed_unit_interval(seed: int, person: bytes = b"corpus-split"):
    """The same by BLAKE2b, keyed with the seed and personalised; `person` must be the one that earlier splits used."""

    @F.arrow_udf(DoubleType())
    def unit(keys: pa.Array) -> pa.Array:
        one = lambda k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8, person=person, key=str(seed).encode()).digest(), "big") / float(2**64)
        return pa.array([None if k is None else one(k) for k in keys.to_pylist()], pa.float64())

    return unit


def row_hash(seed: int):
    """Unkeyed 64-bit BLAKE2b of seed, NUL and text, as two's-complement bigint."""

    @F.arrow_udf(LongType())
    def h(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else int.from_bytes(hashlib.blake2b(f"{seed}\0{t}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for t in texts.to_pylist()], pa.int64())

    return h


def _bits(word: str, family: str) -> int:
    if family == "blake2b":
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    return int(hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def simhash(family: str = "blake2b", fold: str = "casefold"):
    """SimHash of a text over its word occurrences: 64 bits by BLAKE2b, or the first 60 of SHA-256 ("sha256").

    Each occurrence votes on each bit; a bit is set when the votes for it are at least those against. No words: 0.
    As bigint, 64-bit values in two's complement; null counts as empty.
    """
    width = 64 if family == "blake2b" else 60

    @F.arrow_udf(LongType())
    def f(texts: pa.Array) -> pa.Array:
        votes: dict[str, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
        out = []
        for t in texts.to_pylist():
            ws = _WORD.findall(getattr(t or "", fold)())
            if not ws:
                out.append(0)
                continue
            total = np.zeros(width, np.int64)
            for w in ws:
                v = votes.get(w)
                if v is None:
                    if len(votes) > 300_000:
                        votes.clear()
                    b = _bits(w, family)
                    v = votes[w] = np.array([1 if b >> i & 1 else -1 for i in range(width)], np.int64)
                total += v
            x = int(weights[total >= 0].sum())
            out.append(x - (1 << 64) if x >> 63 else x)
        return pa.array(out, pa.int64())

    return f
