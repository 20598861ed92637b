"""Language of a text from its frequent words and script."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: fixed values: letters that occur in one of the languages only
LETTERS = {"de": "äöüß", "fr": "éèêëçàâîôûùœ", "es": "ñáíóú"}


class Guess:
    """Counts of each language's frequent words decide; Cyrillic letters decide for Russian."""

    def __init__(self, words: dict[str, frozenset[str]]):
        self.words = words
        self.langs = sorted(words)
        self.of_word: dict[str, tuple[str, ...]] = {}
        for lang in self.langs:
            for w in words[lang]:
                self.of_word[w] = (*self.of_word.get(w, ()), lang)
        self.weights = [(lang, {w: 1.0 / len(self.of_word[w]) for w in words[lang]}.get) for lang in self.langs]
        self.letters = {c: lang for lang, cs in LETTERS.items() for c in cs}

    @classmethod
    def of_table(cls, common: DataFrame) -> Guess:
        """From common(lang, word), a fixed reference table (212 rows); rows with a null are left out."""
        words: dict[str, set[str]] = {}
        for r in common.select("lang", "word").where("lang is not null and word is not null").collect():
            words.setdefault(r.lang, set()).add(r.word)
        return cls({k: frozenset(v) for k, v in words.items()})

    def scores(self, words: list[str]) -> dict[str, float]:
        out = {lang: sum(filter(None, map(get, words))) for lang, get in self.weights}
        odd = [w for w in words if not w.isascii()]
        cyrillic = 0
        for w in odd:
            if "Ѐ" <= w[0] <= "ӿ":
                cyrillic += 1
            elif w not in self.of_word:
                for c in w:
                    if (lang := self.letters.get(c)) in out:
                        out[lang] += 0.5
                        break
        if "ru" in out:
            out["ru"] = float(cyrillic)
        return out

    def of(self, words: list[str]) -> str | None:
        s = self.scores(words)
        if not s:
            return None
        best = max(s, key=s.get)
        return best if s[best] >= 1 and all(s[best] > v for k, v in s.items() if k != best) else None

    def clear(self, words: list[str], said: str, asked: str) -> bool:
        """Whether words are in `said` rather than in `asked` beyond doubt."""
        s = self.scores(words)
        return s[said] >= 1.5 and s[said] >= 3 * s.get(asked, 0.0) and s[said] >= 0.08 * len(words)
