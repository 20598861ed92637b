"""Problems 1 and 3: records whose word sets overlap, across splits and within a collection."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shuffle_width
from .components import components
from .tiles import BLOB_SCHEMA, DENSE, FLUSH_BYTES, POSTING, Buckets, candidates, filed, forest, grid, numbered, unpack, widths
from .wordsets import Order, Sets, Signer, classes

#: A word counts as frequent from this share of the records on. A record with w distinct words adds w to the sum
#: of all document frequencies, so at most (mean words a record) / FREQUENT_SHARE words are frequent, however
#: large the corpus is: the list that is broadcast has that proven bound (some 60,000 hashes for these records).
FREQUENT_SHARE = 0.001
#: Lists with more members than this on a side are cut into a grid of cells, each met by its own task.
LIST_BLOCK = 200_000
#: One record in so many is read to find coordinate values that may be hot; what is found is only spread differently.
HOT_LOOK = 64


def split_of(col: str) -> Column:
    """train, val or test after trimming and lower-casing; null for every other spelling."""
    s = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "validation", "valid", "dev"), "val").when(s.isin("test", "testing"), "test")


def _sides(chat: DataFrame) -> DataFrame:
    return chat.select("row_id", "user_text", "assistant_text", split_of("split").alias("_split")).where("_split is not null").select("row_id", "user_text", "assistant_text", F.when(F.col("_split") == "train", 1).otherwise(0).alias("side"))


def facts(records: DataFrame) -> DataFrame:
    """One table of what the steps need to know of records(row_id, user_text, assistant_text, side), from one reading.

    Rows with a class are records with at least one word: class is the 128-bit identity of the word set, n its size.
    Rows with a word tell in how many records of each side (df0, df1) it occurs, counted in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def counted(rows: list) -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([w for w, _ in rows]), return_inverse=True)
            df = np.zeros((len(words), 2), np.int64)
            np.add.at(df, at, np.concatenate([d for _, d in rows]))
            return words, df

        def out(words: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            none = lambda t: pa.nulls(len(words), t)
            return pa.RecordBatch.from_arrays([none(pa.binary()), none(pa.int64()), none(pa.int32()), none(pa.int32()), pa.array(words.view(np.int64)), pa.array(df[:, 0]), pa.array(df[:, 1])], _FACT_NAMES)

        for b in batches:
            s, side = Sets.of(b), np.array(b.column("side").to_pylist(), np.int32)
            side = side[s.rows]
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([classes(s.ids(), s.sketches()), b.column("row_id").cast(pa.int64()).take(pa.array(s.rows)), pa.array(side), pa.array(s.n.astype(np.int32)), none, none, none], _FACT_NAMES)
            for k in (0, 1):
                words, df = np.unique(s.words[np.repeat(side == k, s.n)], return_counts=True)
                seen.append((words, np.stack([df * (k == 0), df * (k == 1)], axis=1)))
                held += len(words)
            if held > 2_000_000:
                seen = [counted(seen)]
                held = len(seen[0][0])
                if held > 1_000_000:
                    yield out(*seen.pop())
                    held = 0
        if seen:
            yield out(*counted(seen))

    return records.select("row_id", "user_text", "assistant_text", "side").mapInArrow(run, "class binary, row_id long, side int, n int, word long, df0 long, df1 long")


_FACT_NAMES = ["class", "row_id", "side", "n", "word", "df0", "df1"]


def frequent_words(known: DataFrame, total: int) -> list[tuple[int, int, int]]:
    """(hash, df0, df1) of the frequent words, rarest first: a list of bounded length (see FREQUENT_SHARE)."""
    df = known.where("word is not null").groupBy("word").agg(F.sum("df0").alias("df0"), F.sum("df1").alias("df1"))
    rows = df.where(F.col("df0") + F.col("df1") >= max(2, int(total * FREQUENT_SHARE))).collect()
    return sorted(((r.word, r.df0, r.df1) for r in rows), key=lambda x: (x[1] + x[2], x[0]))


def _posting(n: int) -> np.ndarray:
    return np.zeros(n, POSTING)


def _prefix(n, num: int, den: int):
    """Words in the prefix of a set of n words (an array or a column): two sets that overlap by num/den share one of them."""
    return n - (num * n + den - 1) // den + 1


def prefix_postings(records: DataFrame, frequent: list[tuple[int, int, int]], threshold: Fraction, buckets: int) -> DataFrame:
    """Packed postings of each distinct word set under the words of its prefix, rarest first.

    Two sets of n and m words with overlap of at least t share at least ceil(t*n) words, so they share one of the
    n - ceil(t*n) + 1 rarest of either: the prefix. Rows without a word have no postings. A word of very many records
    is a grid of lists, cut on both sides.
    """
    order = Order([h for h, _, _ in frequent])
    hot = sorted((h, -(-a // LIST_BLOCK) or 1, -(-b // LIST_BLOCK) or 1) for h, a, b in frequent if max(a, b) > LIST_BLOCK)
    known, parts = np.array([h for h, _, _ in hot], np.uint64), np.array([x[1:] for x in hot], np.int64).reshape(-1, 2)
    num, den = threshold.numerator, threshold.denominator

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = Buckets(buckets), set()
        for b in batches:
            s = Sets.of(b, order)
            side = np.array(b.column("side").to_pylist(), np.uint8)[s.rows]
            ids, sk = s.ids(), s.sketches()
            new = _unseen(seen, list(zip(ids.tolist(), sk[:, 0].tolist(), side.tolist(), strict=True)))
            doc = np.repeat(np.arange(len(s)), s.n)
            pos = np.arange(len(doc)) - s.starts[doc]
            keep = (pos < _prefix(s.n, num, den)[doc]) & new[doc]
            word, pos, doc = s.words[keep], pos[keep], doc[keep]
            at, number, at_side = grid(word, ids[doc], side[doc], known, parts)
            pos, doc = pos[at], doc[at]
            p = _posting(len(doc))
            p["id"], p["s0"], p["s1"], p["n"], p["pos"], p["side"] = ids[doc], sk[doc, 0], sk[doc, 1], s.n[doc], np.minimum(pos, 65535), at_side
            out.add(filed(number, p, buckets), p)
            if out.bytes > FLUSH_BYTES:
                yield from out.flush()
        yield from out.flush()

    return records.select("user_text", "assistant_text", "side").mapInArrow(post, BLOB_SCHEMA)


def _unseen(seen: set, keys: list) -> np.ndarray:
    """Which keys are new to `seen`. That only spares work: a set that is posted twice meets as often."""
    new = np.array([not (k in seen or seen.add(k)) for k in keys], bool)
    if len(seen) > 1_000_000:
        seen.clear()
    return new


def _in_buckets(postings: DataFrame, tasks: int) -> DataFrame:
    return postings.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def _class_of(p: np.ndarray) -> pa.Array:
    return classes(p["id"], np.stack([p["s0"], p["s1"]], axis=1))


def prefix_pairs(postings: DataFrame, threshold: Fraction, tasks: int) -> DataFrame:
    """(a, b): classes of side 0 and side 1 that share a prefix word and pass the length, position and parity filters.

    Equal sets aren't told. A bucket is met at a time, and a pair comes once from each, at least.
    """
    num, den = threshold.numerator, threshold.denominator

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, p in unpack(batches):
            found, size, number = [np.zeros(0, np.int64)], 0, numbered(p)
            for i, j in candidates(p, num, den, True):
                x, y = np.where(p["side"][i] == 0, i, j), np.where(p["side"][i] == 0, j, i)
                n, m = p["n"][x].astype(np.int64), p["n"][y].astype(np.int64)
                left = np.minimum(n - p["pos"][x], m - p["pos"][y])
                ok = (left * (num + den) >= num * (n + m)) & (number[x] != number[y])
                found.append(number[x[ok]] * len(p) + number[y[ok]])
                size += len(found[-1])
                if size > 500_000:
                    yield _pairs(p, np.unique(np.concatenate(found)))
                    found, size = [], 0
            if size:
                yield _pairs(p, np.unique(np.concatenate(found)))

    return _in_buckets(postings, tasks).mapInArrow(probe, "a binary, b binary")


def _pairs(p: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Pairs of classes from the numbers of their first postings."""
    return pa.RecordBatch.from_arrays([_class_of(p[key // len(p)]), _class_of(p[key % len(p)])], ["a", "b"])


def verified(pairs: DataFrame, reps: DataFrame, records: DataFrame, threshold: Fraction, tasks: int, signer: Signer | None = None, collisions: int = 0) -> DataFrame:
    """pairs(a, b, ...) of classes whose word sets truly overlap by the threshold, with rep_a and rep_b.

    reps(class, rep): the row that stands for a class. Only the texts of rows in some pair are taken up, and their word
    sets pass one exchange, which both joins read. signer: pairs that are marked dense must also collide in so many
    coordinates, as the others did when they were counted.
    """
    num, den = threshold.numerator, threshold.denominator
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = ids.join(reps, "class").select("class", F.col("rep").alias("row_id"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets.of(b)
            at = pa.array(s.rows)
            sign = signer(s.words, s.starts) if signer else np.zeros((len(s), 0), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("class").take(at), b.column("row_id").take(at), _lists(s.words, s.n), _lists(sign.ravel(), np.full(len(s), sign.shape[1]))], ["class", "rep", "words", "sign"])

    texts = records.select("row_id", "user_text", "assistant_text").join(wanted, "row_id").select("class", "row_id", "user_text", "assistant_text")
    sets = texts.mapInArrow(words, "class binary, rep long, words array<long>, sign array<long>").repartition(tasks, "class")
    x = pairs
    for k in "ab":
        x = x.join(sets.select(F.col("class").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("words").alias(f"w{k}"), F.col("sign").alias(f"s{k}")), k)
    both = F.size(F.array_intersect("wa", "wb")).cast("long")
    x = x.withColumn("both", both).where(F.col("both") * den >= (F.size("wa") + F.size("wb") - F.col("both")) * num)
    if signer:
        same = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda e: e))
        x = x.where(~F.col("dense") | (same >= collisions))
    return x.select("a", "b", "rep_a", "rep_b")


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def cross_split_overlaps(chat: DataFrame, threshold: Fraction = Fraction(7, 10)) -> tuple[DataFrame, DataFrame]:
    """Problem 1. (links(e, t), members(class, row_id, side)) over classes of equal word sets.

    links: classes e with a member in val or test and t with one in train whose overlap reaches the threshold,
    e = t included. An exact prefix-filter join: the evaluation side's and the training side's prefixes on their
    rarest words meet in inverted lists, pass length, position and parity filters, and are verified on the texts.
    A row in no split, or with null or empty texts and thus no word, is in no class. Repeated rows are members of
    one class, so copies never multiply the join; row_id may be of any integer width and must be unique.
    """
    records, num, den = _sides(chat), threshold.numerator, threshold.denominator
    least = shuffle_width(chat.sparkSession)
    known = cut(facts(records))
    m = known.where("class is not null").select("class", "row_id", "side")
    one = known.where("class is not null").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n - ceil(n * {num} / {den}) + 1")).alias("postings")).first()
    tasks, buckets = widths(int(one.postings or 0), least)
    postings = prefix_postings(records, frequent_words(known, one.rows), threshold, buckets)
    pairs = cut(prefix_pairs(postings, threshold, tasks)).distinct()
    good = verified(pairs, m.groupBy("class").agg(F.min("row_id").alias("rep")), records, threshold, least)
    own = m.groupBy("class").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x <> y")
    return good.select(F.col("a").alias("e"), F.col("b").alias("t")).union(own.select(F.col("class").alias("e"), F.col("class").alias("t"))), m


def cross_split_pairs(chat: DataFrame, threshold: Fraction = Fraction(7, 10)) -> DataFrame:
    """(row_lo, row_hi) of every overlapping pair of rows, one in train, the other in val or test."""
    links, m = cross_split_overlaps(chat, threshold)
    e, t = m.where("side = 0").select(F.col("class").alias("e"), F.col("row_id").alias("r0")), m.where("side = 1").select(F.col("class").alias("t"), F.col("row_id").alias("r1"))
    return links.join(e, "e").join(t, "t").select(F.least("r0", "r1").alias("row_lo"), F.greatest("r0", "r1").alias("row_hi"))


COORDINATES, COORDINATE_WIDTH, COLLISIONS = 20, 3, 2
#: Words of a side of a dense list that one task compares; longer ones are cut into a grid.
DENSE_WORDS = 2_000_000
#: Of all rows' values at most COORDINATES / HOT_SHARE have this share of rows, which bounds the list of hot ones.
HOT_SHARE = 0.00001


def members(records: DataFrame) -> DataFrame:
    """(class, row_id) of every record with at least one word."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets.of(b)
            yield pa.RecordBatch.from_arrays([classes(s.ids(), s.sketches()), b.column("row_id").cast(pa.int64()).take(pa.array(s.rows))], ["class", "row_id"])

    return records.select("row_id", "user_text", "assistant_text").mapInArrow(name, "class binary, row_id long")


def hot_values(records: DataFrame, rows: int, signer: Signer, posted: int) -> list[tuple[int, int]]:
    """(value, blocks) of coordinate values that more than LIST_BLOCK records seem to have, from one record in HOT_LOOK."""
    if rows <= LIST_BLOCK:
        return []

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets.of(b)
            v, n = np.unique(signer(s.words, s.starts)[:, :posted], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["value", "n"])

    look = records.where(F.pmod(F.xxhash64("row_id"), F.lit(HOT_LOOK)) == 0).select("user_text", "assistant_text")
    found = look.mapInArrow(values, "value long, n long").groupBy("value").agg((F.sum("n") * HOT_LOOK).alias("n")).where(F.col("n") > max(LIST_BLOCK, int(rows * HOT_SHARE))).collect()
    return sorted((r.value & (2**64 - 1), -(-r.n // LIST_BLOCK)) for r in found)


def signature_postings(records: DataFrame, hot: list[tuple[int, int]], signer: Signer, posted: int, buckets: int) -> DataFrame:
    """Packed postings of each distinct word set under its first `posted` coordinate values.

    Two signatures that agree in c coordinates agree in one of the first coordinates - c + 1, so the rest is skipped;
    the first skipped value's hash rides along.
    """
    known, parts = np.array([v for v, _ in hot], np.uint64), np.array([(k, k) for _, k in hot], np.int64).reshape(-1, 2)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = Buckets(buckets), set()
        for b in batches:
            s = Sets.of(b)
            ids, sk = s.ids(), s.sketches()
            new = np.flatnonzero(_unseen(seen, list(zip(ids.tolist(), sk[:, 0].tolist(), strict=True))))
            keep = np.zeros(len(s), bool)
            keep[new] = True
            n = s.n[new]
            v = signer(s.words[np.repeat(keep, s.n)], np.cumsum(n) - n)
            at, number, side = grid(v[:, :posted].ravel(), np.repeat(ids[new], posted), None, known, parts)
            doc, pos = new[at // posted], at % posted
            p = _posting(len(at))
            p["id"], p["s0"], p["s1"], p["n"], p["pos"], p["side"] = ids[doc], sk[doc, 0], sk[doc, 1], s.n[doc], pos, side
            p["skip"] = v[at // posted, posted].astype(np.uint16) if posted < signer.coordinates else 0
            out.add(filed(number, p, buckets), p)
            if out.bytes > FLUSH_BYTES:
                yield from out.flush()
        yield from out.flush()

    return records.select("user_text", "assistant_text").mapInArrow(post, BLOB_SCHEMA)


_MET = "a binary, b binary, hits int, skip int, dense boolean, list long, blob binary"


def _met(p: np.ndarray, x: np.ndarray, y: np.ndarray, dense: bool) -> pa.RecordBatch:
    x, y = np.where(p["id"][x] < p["id"][y], x, y), np.where(p["id"][x] < p["id"][y], y, x)
    skip, n = p["skip"][x] == p["skip"][y], len(x)
    return pa.RecordBatch.from_arrays([_class_of(p[x]), _class_of(p[y]), pa.array(np.ones(n, np.int32)), pa.array(skip.astype(np.int32)), pa.array(np.full(n, dense)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _MET_NAMES)


_MET_NAMES = ["a", "b", "hits", "skip", "dense", "list", "blob"]


def signature_pairs(postings: DataFrame, threshold: Fraction, tasks: int) -> DataFrame:
    """Pairs (a, b) of classes that collide in one posted coordinate and pass the size and parity filters, once a collision.

    skip: whether they agree in the skipped coordinate as well. Of a dense list come its members' pairs with a few
    leaders, marked dense, and the list itself, in `blob`.
    """
    num, den, most = threshold.numerator, threshold.denominator, DENSE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, p in unpack(batches):
            dense: list[tuple[int, int]] = []
            number, told = numbered(p), 0
            for i, j in candidates(p, num, den, dense=dense, most=most):
                ok = (number[i] != number[j]) & (p["pos"][i] == p["pos"][j])
                yield _met(p, i[ok], j[ok], bool(dense) and len(i) > 0 and dense[-1][0] <= i[0] < dense[-1][1])
                for a, b in dense[told:]:
                    none = pa.nulls(1, pa.binary())
                    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([True]), pa.array([bucket << 32 | int(p["key"][a])], pa.int64()), pa.array([p[a:b].tobytes()], pa.binary())], _MET_NAMES)
                told = len(dense)

    return _in_buckets(postings, tasks).mapInArrow(count, _MET)


def dense_links(lists: DataFrame, labels: DataFrame, records: DataFrame, threshold: Fraction, tasks: int, signer: Signer, collisions: int) -> DataFrame:
    """(rep_a, rep_b): links between members of dense lists(list, blob) that have different labels so far.

    labels(class, rep, label). Lists of one label are settled and dropped before any text is read. The others get
    their members' words and are compared in place (tiles.forest), cell by cell of at most DENSE_WORDS words a side.
    """
    num, den, most_words = threshold.numerator, threshold.denominator, DENSE_WORDS
    fields = [n for n in POSTING.names if n != "key"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, blob in zip(b.column("list").to_pylist(), b.column("blob").to_pylist(), strict=True):
                p = np.frombuffer(blob, POSTING)
                two = bool(p["side"].any())
                blocks = [max(1, -(-int(p["n"][p["side"] == s].sum()) // most_words)) for s in (0, 1)]
                name = np.full(len(p), k, np.int64).view(np.uint64)
                at, number, side = grid(name, p["id"], p["side"] if two else None, name[:1], np.array([blocks]))
                q = p[at]
                q["side"] = side
                for i in range(0, len(q), 100_000):
                    r = q[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(number[i : i + 100_000].view(np.int64)), _class_of(r), *[pa.array(np.ascontiguousarray(r[n]).astype(np.uint64).view(np.int64)) for n in fields]], ["list", "class", *fields])

    rows = lists.mapInArrow(spread, "list long, class binary, " + ", ".join(f"`{n}` long" for n in fields)).join(labels, "class")
    open_lists = rows.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("list")
    rows = cut(rows.join(open_lists, "list"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets.of(b)
            yield pa.RecordBatch.from_arrays([b.column("row_id").take(pa.array(s.rows)), _lists(s.words, s.n)], ["rep", "words"])

    wanted = rows.select(F.col("rep").alias("row_id")).distinct()
    sets = records.select("row_id", "user_text", "assistant_text").join(wanted, "row_id").mapInArrow(words, "rep long, words array<long>")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_list(batches):
            p = np.zeros(len(part), POSTING)
            for n in fields:
                p[n] = part.column(n).to_numpy().view(np.uint64).astype(POSTING[n])
            at = np.lexsort((p["n"], p["side"]))
            p, part = p[at], part.take(pa.array(at))
            flat = part.column("words").combine_chunks().flatten().to_numpy().view(np.uint64)
            rep, label, n = part.column("rep").to_numpy(), part.column("label").to_numpy(), p["n"].astype(np.int64)
            sign = signer(flat, np.cumsum(n) - n)
            agree = lambda i, j, sign=sign: (sign[i] == sign[j]).sum(1) >= collisions
            for x, y in forest(p, label, flat, agree, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[y])], ["rep_a", "rep_b"])

    full = rows.join(sets, "rep").select("list", "rep", "label", "words", *fields)
    return full.repartition(tasks, "list").sortWithinPartitions("list").mapInArrow(link, "rep_a long, rep_b long")


def _by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one list after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column("list").to_numpy()
        at = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for i, j in zip(at, at[1:], strict=False):
            if held and i < j and held[-1].column("list")[0].as_py() != k[i]:
                yield pa.Table.from_batches(held)
                held = []
            if i < j:
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def near_duplicate_groups(chat: DataFrame, threshold: Fraction = Fraction(7, 10), coordinates: int = COORDINATES, width: int = COORDINATE_WIDTH, collisions: int = COLLISIONS) -> DataFrame:
    """Problem 3. (group_id, row_id) of every record in a group of two or more, group_id the group's smallest row_id.

    Records whose word sets overlap by the threshold are linked, directly or through others. Signature-coordinate
    inverted join: each distinct word set has `coordinates` values of `width` joined min-hashes and is posted under
    them; pairs with at least `collisions` equal coordinates are kept, then verified exactly on their texts. A pair
    of overlap J is missed with the probability that Binomial(coordinates, J**width) < collisions: 0.3 % at 0.70,
    0.03 % at 0.75, under 0.001 % at 0.80; nothing below the threshold is ever linked. Equal word sets are one
    class and cost one posting. In lists where most members may be linked to most others (a text with very many near
    copies) members are first linked to a few leaders; then pairs of different components are compared in place, by
    the same rule, so no list gives all its pairs and none is lost. Values that very many records share are grids of
    lists. Records without words (null or empty texts) are in no group.
    """
    if collisions not in (1, 2):
        raise ValueError("collisions must be 1 or 2")
    records = chat.select("row_id", "user_text", "assistant_text")
    least, signer, posted = shuffle_width(chat.sparkSession), Signer(coordinates, width), coordinates - collisions + 1
    m = cut(members(records))
    first = m.groupBy("class").agg(F.min("row_id").alias("rep"), F.count("*").alias("n"))
    rows = m.count()
    tasks, buckets = widths(rows * posted, least)
    postings = signature_postings(records, hot_values(records, rows, signer, posted), signer, posted, buckets)
    raw = cut(signature_pairs(postings, threshold, tasks))
    counts = raw.where("list is null").groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("skip").alias("skip"), F.bool_or("dense").alias("dense"))
    pairs = counts.where(F.col("dense") | (F.col("hits") + (F.col("skip") if collisions > 1 else 0) >= collisions)).select("a", "b", "dense")
    lists = raw.where("list is not null").select("list", "blob")
    reps = first.select("class", "rep")
    if lists.isEmpty():
        root = components(verified(pairs, reps, records, threshold, least).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    else:
        links = cut(verified(pairs, reps, records, threshold, least, signer, collisions).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        root = components(links)
        labels = reps.join(root, reps["rep"] == root["node"], "left").select("class", "rep", F.coalesce("root", "rep").alias("label"))
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(dense_links(lists, labels, records, threshold, tasks, signer, collisions)))
    known = first.join(root, first["rep"] == root["node"], "left").where("root is not null or n > 1").select("class", F.coalesce("root", "rep").alias("group_id"))
    return m.join(known, "class").select("group_id", "row_id")
