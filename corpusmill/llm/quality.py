"""Problem 9: text statistics of each document, their robust distance from prose, and the kind of what isn't prose."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .language import Guess
from .wordsets import WORD

#: The statistics, in the order of the distance's coordinates.
STATISTICS = ("log_words", "mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", "digit_ratio", "distinct_ratio", "sentence_ends_per_word", "entry_share")
#: Least standard deviation of each statistic: prose that never varies in one would make its distance infinite.
FLOORS = np.array([0.35, 0.30, 0.012, 0.10, 0.05, 0.012, 0.03, 0.025, 0.10])
#: Documents of other languages whose pooled moments stand beside a language's own.
SHRINK_MEAN, SHRINK_COV = 20.0, 60.0
#: Squared distance beyond which a document isn't prose: the 0.999 quantile of chi-square with 9 degrees of freedom.
CUT = 27.88
#: Concentration steps of the robust estimate, and the part of a language's documents the first one keeps.
STEPS = 4

# ---- fixed values: shapes of lines ---------------------------------------------------------------------------------
_ENDS, _CLOSERS = ".!?…。", "\"'”’»)*_`] \t\r"
_MARK = re.compile(r"^\s*(?:[-*•+–—·▪◦‣]|\d{1,3}[.):]|\(\d{1,3}\)|\(?[a-zA-Z][.)]|\([ivx]+\)|\[[ xX]?\]|[☐☑✓✗])\s+\S")
#: Marks of an entry; a dash that opens a line of dialogue is none.
_ENTRY = re.compile(r"^\s*(?:[-*•+·▪◦‣]|\d{1,3}[.):]|\(\d{1,3}\)|\(?[a-zA-Z][.)]|\([ivx]+\)|\[[ xX]?\]|[☐☑✓✗])\s+(?=\S)")
_STOP = re.compile(r"[.!?…。]+[\"'”’»)]*(?=\s|$)")
_KEY = re.compile(r"^\s*[^\s:=]{1,32}(?: [^\s:=]{1,24}){0,2}\s*(?::|=|=>|->)\s+\S")
_DASHED = re.compile(r"^\s*\S{1,32}(?: \S{1,24})? [–—-] \S")
_LOG = re.compile(r"^\s*\[\w{2,}\]\s.*\d|^\W*(?:\d{4}-\d\d-\d\d|\d\d:\d\d|\d{9,}|(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b)|\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b")
_CODE = re.compile(r"[0-9a-fA-F]{16,}|[A-Za-z0-9+/=_-]{40,}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-")
_BROKEN = re.compile(r"�|Ã[\x80-\xff]|â€|ï¿½|Ð[^\s\w]?|Ñ[^\s\w]?|Â[\x80-\xff]|Ã.")
_GAP = re.compile(r"\S(?:\s{2,}|\t)\S")
# -------------------------------------------------------------------------------------------------------------------


def ended(line: str) -> bool:
    return (line.rstrip(_CLOSERS)[-1:] or "x") in _ENDS


def logical_lines(text: str) -> list[str]:
    """Lines, with hard-wrapped ones put together: a long line without an end goes on in a line that is no list entry."""
    out: list[str] = []
    wrapped = False
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            wrapped = False
            continue
        if wrapped and not _MARK.match(s):
            out[-1] += " " + s
        else:
            out.append(s)
        wrapped = len(s) >= 36 and not ended(s)
    return out


def entry_share(lines: list[str]) -> float:
    """Share of logical lines that are entries: a mark and no more than one sentence. One entry alone is none."""
    n = sum(bool(m) and len(_STOP.findall(x, m.end())) <= 1 for x in lines for m in [_ENTRY.match(x)])
    return n / len(lines) if n > 1 else 0.0


def statistics(text: str | None, lang: str | None, guess: Guess) -> tuple[str, int, list[float], str | None]:
    """(language, word count, STATISTICS, shape) of one document, over its whole text; null counts as empty."""
    text = text or ""
    words = WORD.findall(text.lower())
    n = len(words)
    lines = logical_lines(text)
    solid = sum(map(len, text.split())) or 1
    alnum = sum(map(len, words))
    spoken = guess.of(words) or (lang if lang in guess.words else None) or "none"
    common = guess.words.get(spoken, frozenset())
    distinct = len(set(words))
    ends = sum(text.count(c) for c in ".!?…")
    entries = entry_share(lines)
    return (
        spoken,
        n,
        [
            math.log1p(n),
            min(alnum / n, 40.0) if n else 0.0,
            max(0.0, 1 - alnum / solid),
            sum(map(ended, lines)) / len(lines) if lines else 0.0,
            sum(w in common for w in words) / n if n else 0.0,
            sum(map(text.count, "0123456789")) / solid,
            math.log1p(distinct) / math.log1p(n) if n else 0.0,
            min(ends / n, 1.0) if n else 0.0,
            entries,
        ],
        kind_of(text, words) or ("list" if entries >= 0.5 else None),
    )


def _columns(lines: list[str]) -> float:
    """Share of lines that are rows of cells in the same columns, for the best separator."""
    best = 0.0
    for sep in ("\t", ";", "|", "│", "¦", ","):
        if not any(sep in line for line in lines[:8]) and not any(sep in line for line in lines):
            continue
        counts = Counter(line.count(sep) for line in lines)
        m, rows = max(((c, k) for c, k in counts.items() if c > 0), key=lambda x: x[1], default=(0, 0))
        if rows < 3 or m < (2 if sep == "," else 1):
            continue
        cells = [x for line in lines if line.count(sep) == m for x in line.split(sep)]
        if sum(len(x.split()) for x in cells) <= 3.2 * len(cells):
            best = max(best, rows / len(lines))
    gaps = sum(("  " in line or "\t" in line) and bool(_GAP.search(line)) for line in lines)
    if gaps >= 3 and gaps * 2 >= len(lines) and sum(len(WORD.findall(x)) for line in lines for x in re.split(r"\s{2,}|\t", line)) <= 3.2 * sum(len(re.split(r"\s{2,}|\t", line)) for line in lines):
        best = max(best, gaps / len(lines))
    return best


def kind_of(text: str | None, words: list[str]) -> str | None:
    """list, table, junk or None (prose), from the shape of the lines and the words found in text."""
    text = text or ""
    lines = [x.rstrip() for x in text.split("\n") if WORD.search(x)]
    if len(words) < 5 or not lines:
        return "junk"
    broken = 0 if text.isascii() else len(_BROKEN.findall(text))
    if broken >= 3 and broken * 6 >= len(words):
        return "junk"
    coded = sum(len(m.group()) for x in text.split() if len(x) >= 16 for m in _CODE.finditer(x))
    if coded * 2 > len(text.strip()):
        return "junk"
    if len(words) >= 12 and 2 * len(set(words)) < len(words):
        # a long list of few values has few pairs too, but doesn't repeat longer runs
        pairs = len(set(zip(words, words[1:], strict=False)))
        if pairs <= 0.25 * (len(words) - 1) and 2 * len(set(zip(*(words[i:] for i in range(8)), strict=False))) <= len(words) - 7:
            return "junk"
    n = len(lines)
    if n >= 2 and sum(bool(_LOG.search(x)) for x in lines) * 2 > n:
        return "junk"
    if n <= 2:
        marks = sum(map(bool, map(_MARK.match, lines)))
        return "list" if marks == n == 2 else None
    marked = [bool(_MARK.match(x)) for x in lines]
    if n >= 2 and sum(marked) * 2 >= n and sum(marked) >= 2:
        return "list"
    if n >= 3 and _columns(lines) >= 0.6:
        return "table"
    if n >= 3:
        entries = sum(m or bool(_KEY.match(x) or _DASHED.match(x)) and not ended(x) and len(x.split()) <= 14 for x, m in zip(lines, marked, strict=True))
        if entries * 2 >= n:
            return "list"
        short = [m or (len(x.split()) <= 8 and len(x) < 60 and not ended(x)) for x, m in zip(lines, marked, strict=True)]
        if sum(short) >= 0.7 * n and len(set(lines)) > 0.5 * n:
            return "list"
    return None


def measured(documents: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, spoken, word_count, stats, shape) of every document: one narrow pass over whole texts."""
    guess = Guess.of_table(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [statistics(t, g, guess) for t, g in zip(texts, b.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.float64())), pa.array([g[3] for g in got], pa.string())],
                ["doc_id", "spoken", "word_count", "stats", "shape"],
            )

    return documents.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, spoken string, word_count long, stats array<double>, shape string")


class Prose:
    """Mean and inverse covariance of prose by language."""

    def __init__(self, moments: dict[str, tuple[float, np.ndarray, np.ndarray]]):
        k = len(STATISTICS)
        pooled = (sum(m[0] for m in moments.values()), sum((m[1] for m in moments.values()), np.zeros(k)), sum((m[2] for m in moments.values()), np.zeros((k, k))))
        within = sum((m[2] - np.outer(m[1], m[1]) / m[0] for m in moments.values() if m[0]), np.zeros((k, k))) / max(pooled[0], 1.0)
        middle = pooled[1] / max(pooled[0], 1.0)
        self.by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, (n, s, ss) in [*moments.items(), ("", pooled)]:
            mean = (s + SHRINK_MEAN * middle) / (n + SHRINK_MEAN)
            own = ss - np.outer(s, s) / n if n else np.zeros((k, k))
            cov = (own + SHRINK_COV * within) / (n + SHRINK_COV)
            self.by[lang] = (mean, np.linalg.inv(cov + np.diag(FLOORS**2)))

    def parts(self, langs: list[str], x: np.ndarray) -> np.ndarray:
        """Each statistic's contribution to the squared distance; a row sums to it."""
        out = np.zeros_like(x)
        for lang in set(langs):
            at = [i for i, v in enumerate(langs) if v == lang]
            mean, inverse = self.by.get(lang, self.by[""])
            d = x[at] - mean
            out[at] = d * (d @ inverse)
        return out


def _moments(stats: DataFrame, inside) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products by language of the documents that `inside` keeps, added up before the shuffle."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("spoken").to_pylist()
            x = np.array(b.column("stats").to_pylist(), dtype=float).reshape(-1, k)
            keep = inside(langs, x)
            for lang in set(langs):
                y = x[[i for i, v in enumerate(langs) if v == lang and keep[i]]]
                if len(y):
                    acc[lang] = acc.get(lang, 0) + np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
        langs = list(acc)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([acc[x].tolist() for x in langs], pa.list_(pa.float64()))], ["spoken", "m"])

    rows = stats.select("spoken", "stats").mapInArrow(run, "spoken string, m array<double>").groupBy("spoken").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(1 + k + k * k)]).collect()
    return {r[0]: (r[1], np.array(r[2 : 2 + k]), np.array(r[2 + k :]).reshape(k, k)) for r in rows}


def fit_prose(stats: DataFrame) -> Prose:
    """Robust mean and covariance of prose in each language, from all documents.

    Concentration: start from the documents within three robust deviations of the medians of the half richest in
    common words, then keep those within the cut-off of the last estimate, STEPS times. What reaches the driver
    are moments by language, of fixed size.
    """
    k = len(STATISTICS)
    half = stats.where("stats[4] > 0.15 and stats[3] >= 0.5 and word_count >= 12")
    mid = half.agg(*[F.percentile_approx(F.col("stats")[i], F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{i}") for i in range(k)]).first()
    if mid is None or mid[0] is None:
        return Prose({})
    q = np.array([mid[i] for i in range(k)])
    middle, scale = q[:, 1], np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOORS)

    def near(langs: list[str], x: np.ndarray) -> np.ndarray:
        return (np.abs(x - middle)[:, [1, 2, 3, 5, 6, 7, 8]] <= 3 * scale[[1, 2, 3, 5, 6, 7, 8]]).all(1) & (x[:, 4] > 0.08)

    prose = Prose(_moments(stats, near))
    for _ in range(STEPS - 1):
        prose = Prose(_moments(stats, lambda langs, x, p=prose: p.parts(langs, x).sum(1) <= CUT))
    return prose


def scored(documents: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, spoken, word_count, the statistics, distance2, contributions by statistic, outlier, kind).

    The distance is Mahalanobis' from the mean and covariance of prose in the document's language, which is read
    off the text (lang is used where the text doesn't tell; a null or wrong lang does no harm). kind is null for
    prose; an outlier gets the kind its lines show, junk if they show none. Empty and null texts are junk.
    """
    stats = cut(measured(documents, common))
    prose = fit_prose(stats)
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), dtype=float).reshape(-1, k)
            parts = prose.parts(b.column("spoken").to_pylist(), x)
            d2 = parts.sum(1)
            out = d2 > CUT
            shape = b.column("shape").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("spoken"), b.column("word_count"), b.column("stats"), b.column("shape"), pa.array(d2), pa.array(parts.tolist(), pa.list_(pa.float64())), pa.array(out), pa.array([judged(s, o) for s, o in zip(shape, out, strict=True)], pa.string())],
                ["doc_id", "spoken", "word_count", "stats", "shape", "distance2", "contributions", "outlier", "kind"],
            )

    return stats.mapInArrow(run, "doc_id long, spoken string, word_count long, stats array<double>, shape string, distance2 double, contributions array<double>, outlier boolean, kind string")


def judged(shape: str | None, outlier: bool) -> str | None:
    """The kind of an outlier; one whose lines show neither list nor table is junk."""
    if not outlier:
        return None
    if shape:
        return shape
    return "junk"
