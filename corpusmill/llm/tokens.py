"""Problem 4: exact token counts by a compiled vocabulary, and their totals over cubes."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The byte tokenizer: one token per UTF-8 byte.
BYTE_VOCABULARY = {bytes([i]): i for i in range(256)}
#: Pre-token counts a worker remembers before it starts afresh.
KEEP_PRETOKENS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a public vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TokenAutomaton:
    """Counts the tokens of a byte-pair encoding in one left-to-right scan, without making the ids.

    An Aho-Corasick automaton over the vocabulary gives the tokens that end at each byte. The encoding of every
    prefix ends in exactly one token t such that t may follow the last token of the shorter prefix; whether two
    tokens may stand side by side (their bytes encode to just these two) is looked up in a table filled on demand.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall if pattern else lambda s: [s]
        self.machine = ahocorasick.Automaton()
        for token in ranks:
            self.machine.add_word(token.decode("latin-1"), token)
        self.machine.make_automaton()
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, int] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: the lowest rank first. Only for pairs of tokens, which are short."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        if (x := self.fits.get((a, b))) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            x = self.fits[a, b] = self.merge(a + b) == [a, b]
        return x

    def scan(self, data: bytes) -> int:
        last: list[bytes] = [b""] * (len(data) + 1)
        count = [0] * (len(data) + 1)
        ending: dict[int, list[bytes]] = {}
        for end, token in self.machine.iter(data.decode("latin-1")):
            ending.setdefault(end + 1, []).append(token)
        for i in range(1, len(data) + 1):
            for t in sorted(ending.get(i, ()), key=len, reverse=True):
                start = i - len(t)
                if start == 0 or count[start] and self.may_follow(last[start], t):
                    last[i], count[i] = t, count[start] + 1
                    break
            else:
                raise ValueError("the vocabulary has no token for some byte")
        return count[len(data)]

    def expression(self, text: str) -> Column | None:
        """The scan as an expression, where the automaton allows one: then every byte ends exactly one token.

        That is so if every byte is a token, no token is longer, texts aren't split, and the table lets any two tokens
        stand side by side. The count is then the UTF-8 length, which stays in the JVM.
        """
        whole = not self.pattern and len(self.ranks) == 256 and all(len(t) == 1 for t in self.ranks)
        if not whole or not all(self.may_follow(a, b) for a in self.ranks for b in self.ranks):
            return None
        return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

    def count(self, text: str | None) -> int:
        """Tokens of text; null and empty texts have none."""
        total = 0
        for piece in self.split(text or ""):
            if (n := self.known.get(piece)) is None:
                if len(self.known) > KEEP_PRETOKENS:
                    self.known.clear()
                n = self.scan(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    self.known[piece] = n
            total += n
        return total


def with_token_count(df: DataFrame, text: str, out: str, ranks: dict[bytes, int] | None = None, pattern: str | None = None) -> DataFrame:
    """df with the column `out`: exact tokens of the column `text` (null: 0). Narrow; the vocabulary is broadcast (fixed size)."""
    ranks = BYTE_VOCABULARY if ranks is None else ranks
    if (c := TokenAutomaton(ranks, pattern).expression(text)) is not None:
        return df.withColumn(out, c)
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    made: list[TokenAutomaton] = []

    @F.arrow_udf(LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(TokenAutomaton(sent.value, pattern))
        for texts in batches:
            yield pa.array([made[0].count(x) for x in texts.to_pylist()], pa.int64())

    return df.withColumn(out, count(F.col(text)))


def target_tokens(max_length: str) -> Column:
    """Expected target tokens: UTF-8 bytes of the trimmed answer and the end token, cut to max_length - 1."""
    return F.least(F.col("_bytes") + 1, F.col(max_length) - 1)


def _answer_bytes(chat: DataFrame) -> DataFrame:
    trimmed = chat.select("row_id", F.btrim(F.coalesce("assistant_text", F.lit("")), F.lit(" \t\r\n")).alias("_answer"))
    return with_token_count(trimmed, "_answer", "_bytes").select("row_id", "_bytes")


def checked_targets(encoded: DataFrame, chat: DataFrame) -> DataFrame:
    """encoded with `expected`, the right target_token_count. Only row ids and counts are shuffled.

    An encoding whose row_id is null or unknown has a null `expected`; a null max_length does not cut.
    """
    e = encoded.select("enc_id", "row_id", "shard_id", "task_family", "max_length", "target_token_count")
    return e.join(_answer_bytes(chat), "row_id", "left").withColumn("expected", F.when(F.col("_bytes").isNotNull(), target_tokens("max_length"))).drop("_bytes")


def wrong_targets(encoded: DataFrame, chat: DataFrame) -> DataFrame:
    """(enc_id) of encodings whose target_token_count is null or wrong."""
    return checked_targets(encoded, chat).where("target_token_count is null or target_token_count <> expected").select("enc_id")


def token_cube(df: DataFrame, tokens: str, *dims: str) -> DataFrame:
    """Totals of `tokens` for every combination of dims; `level` is the grouping id, so null values stay apart from totals."""
    return df.cube(*dims).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("examples"), F.sum(tokens).alias("tokens"))


def target_token_cube(encoded: DataFrame, chat: DataFrame) -> DataFrame:
    """Right target tokens by source, lang and task_family; an example encoded several times counts once (its smallest enc_id)."""
    one = checked_targets(encoded, chat).where("expected is not null").groupBy("row_id").agg(F.min_by("expected", "enc_id").alias("expected"))
    return token_cube(one.join(chat.select("row_id", "source", "lang", "task_family"), "row_id"), "expected", "source", "lang", "task_family")


def summary_differences(encoded: DataFrame, chat: DataFrame, summaries: DataFrame, split: Column) -> DataFrame:
    """Shard and split summaries beside the target tokens recomputed; rows in no usable split count under train."""
    one = checked_targets(encoded, chat).groupBy("shard_id", "row_id").agg(F.min_by("expected", "enc_id").alias("expected"))
    of = one.join(chat.select("row_id", F.coalesce(split, F.lit("train")).alias("split")), "row_id").groupBy("shard_id", "split").agg(F.sum("expected").alias("recomputed_tokens"))
    s = summaries.select("shard_id", "split", "target_tokens")
    return s.join(of, ["shard_id", "split"], "left").withColumn("agrees", F.col("target_tokens").eqNullSafe(F.col("recomputed_tokens")))


def bpe_budget(documents: DataFrame, spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Tokens of documents.text under a public byte-pair vocabulary, by source, lang and topic."""
    d = with_token_count(documents.select("text", "source", "lang", "topic"), "text", "n_tokens", load_ranks(path), pattern)
    return token_cube(d.drop("text"), "n_tokens", "source", "lang", "topic")
