"""Problem 2: prompt and response pairs whose answer is defective, with the type of defect."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .language import Guess
from .wordsets import WORD

# ---- fixed values: marks for "no answer", and the phrases of refusals by language -------------------------------
NO_ANSWER = {"", "na", "n a", "none", "null", "nil", "nan", "todo", "tbd", "empty", "no answer", "no response", "undefined", "missing", "blank"}
#: Who speaks (None: nobody need) and what declines after it.
REFUSALS = [
    (r"\b(i|we|this|that|answering|it)\b", r"\b(cannot|can not|can t|could not|unable|not able|won t|will not|decline|refuse|not allowed|not permitted|don t have the ability|do not have the ability|outside what i|cannot do|not something i)\b"),
    (r"\b(ich|mir)\b", r"\b((kann|könnte|darf|möchte|will|werde|bin|ist)\b.*\bnicht|nicht\b.*\b(kann|könnte|darf|möchte|will|werde|bin|ist|möglich|beantworten|helfen)|unmöglich|ablehnen|verweigern)\b"),
    (r"\b(kann|darf|muss) (ich|das)\b", r"\b(nicht|ablehnen)\b"),
    (r"\b(je|m|il)\b", r"\b(ne peux|ne puis|impossible|dois refuser|dois décliner|ne suis pas (en mesure|capable|autorisé\w*|habilité\w*)|pas en mesure)\b"),
    (None, r"\b(no puedo|no me es posible|no soy capaz|debo rechazar|tengo que rechazar|no estoy en condiciones|debo negarme)\b"),
    (None, r"\b(я не могу|не могу|вынужден|вынуждена|нельзя|не в состоянии|не имею возможности|не смогу|отказаться)\b"),
]
#: Apologies, thanks and what the speaker is; polite at any length and place.
COURTESY = r"^(i m (so |very |truly )?sorry|i am (so |very |truly )?sorry|sorry|i apologize|apologies|thanks|thank you|i appreciate|i understand|as an ai|as a language model|i am (only |just )?(an ai|a language model)|es tut mir leid|tut mir leid|entschuldigung|danke|vielen dank|ich verstehe|als sprachmodell|ich bin (nur )?ein sprachmodell|je suis désolée?|désolée?|pardon|merci|je comprends|en tant que modèle|lo siento|perdón|disculpa|gracias|entiendo|como modelo|извините|простите|прошу прощения|спасибо|я понимаю|как языковая модель)\b"
#: Turns from declining to an answer.
GIVES = r"\b(here is|here s|here are|here comes|the answer is|the result is|hier ist|hier sind|die antwort (ist|lautet)|voici|la réponse est|aquí está|aquí tienes|la respuesta es|вот|ответ такой)\b"
OPENERS = r"^(i m sorry|i am sorry|sorry|i apologize|apologies|unfortunately|regrettably|as a language model|as an ai|thanks for asking|thank you for asking|i have to|i must|i am|i can|i won|i don|this is something|answering|es tut mir leid|tut mir leid|leider|entschuldigung|als sprachmodell|ich|je suis désolé|désolé|pardon|malheureusement|en tant que|je|il m est|lo siento|lamentablemente|perdón|disculpa|como modelo|no puedo|no me es|debo|к сожалению|извините|простите|прошу прощения|как языковая модель|я|мне)\b"
CLOSERS = r"hope you understand|anything else|another topic|somebody qualified|someone else|another question|let me know|jemand anderen|verständnis|noch etwas|anderes thema|andere frage|sonst noch|compréhension|autre chose|autre question|autre sujet|quelqu un d autre|algo más|otra cosa|otra pregunta|otro tema|comprensión|otra persona|consulta|другой вопрос|другую тему|понимание|что нибудь ещё|что то ещё|помощь|кому нибудь|специалист"
#: Words that put the question, and those that stand before a question that is given back.
ASKING = frozenset("what which who whom whose where when why how was welche welcher welches wer wen wem wo wann warum wie que quel quelle quels quelles qui où quand pourquoi comment combien qué cuál cuáles quién dónde cuándo cómo cuánto что какой какая какое какие кто где когда почему как сколько".split())
LABELS = frozenset({"q", "question", "prompt", "frage", "pregunta", "вопрос"})
OTHER_LANGUAGE = r"\b(in|into|to|auf|ins|en|al|a|на|по)\s+(the\s+)?(english|german|french|spanish|russian|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|russisch\w*|anglais|allemand|français|espagnol|russe|inglés|alemán|francés|español|ruso|английск\w*|немецк\w*|французск\w*|испанск\w*|русск\w*|английски|немецки|французски|испански|русски)\b"
# -------------------------------------------------------------------------------------------------------------------
_MARK_WORDS = max(len(x.split()) for x in NO_ANSWER)
_REFUSE = [(who and re.compile(who), re.compile(what)) for who, what in REFUSALS]
_OPEN, _CLOSE, _OTHER = re.compile(OPENERS), re.compile(CLOSERS), re.compile(OTHER_LANGUAGE, re.IGNORECASE)
_COURTESY, _GIVES = re.compile(COURTESY), re.compile(GIVES)
_SENTENCE_END = re.compile(r"[.!?…。]+|```|\n\s*\n|\n(?=[ \t]*(?:[-*•+–]|\d+[.)])\s)")
_STRUCTURE = re.compile(r"""```|`|\\.|[()\[\]{}«»„“”"]|\*\*+|</?[a-zA-Z][\w-]*(?:\s[^<>\n]*)?/?>|\n[ \t]*\n|\n(?=[ \t]*(?:[-*•+–]|\d+[.)])\s)""")
_CLOSING = {")": "(", "]": "[", "}": "{"}
#: Marks that close each mark; „…“, “…”, «…», »…« and ”…” are all in use.
_QUOTES = {"„": "“”\"", "“": "”\"", "«": "»", "»": "«»", "”": "”\"", '"': "”“"}
#: Tags that HTML wants closed. Others count if the text itself closes one of that name.
_TAGS = frozenset("a abbr article b blockquote button code details div em footer form h1 h2 h3 h4 h5 h6 header i kbd main mark nav ol pre s script section select small span strong style sub summary sup table textarea u ul".split())
_CUT_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)?(?:\s[^<>\n]*)?$")
_BLANK = " \t\r\n\v\f\u00a0\u200b\u200c\u200d\u2009\u2028\u2060\ufeff"
_ITEM = re.compile(r"^\s*(?:[-*•+–]|\d+[.)]|\[[ x]\])\s*")


def is_empty(answer: str) -> bool:
    """No words, or those of one mark for no answer, however much stands around them; no word after the longest mark's is read."""
    return " ".join(m.group() for m in islice(WORD.finditer(answer.lower()), _MARK_WORDS + 1)) in NO_ANSWER


def sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE_END.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def declines(sentence: str) -> bool:
    return bool(_OPEN.search(sentence)) and any((m := who.search(sentence) if who else True) and what.search(sentence, m.end() if who else 0) for who, what in _REFUSE)


def is_refusal(answer: str) -> bool:
    """Every sentence declines, apologises or closes politely, at whatever length, and at least one declines.

    The first sentence that gives something ends the reading.
    """
    declined = False
    for s in sentences(answer):
        if not (s := " ".join(WORD.findall(s.lower()))):
            continue
        if _GIVES.search(s):
            return False
        if declines(s):
            declined = True
        elif not (_COURTESY.search(s) or _CLOSE.search(s)):
            return False
    return declined


def tiles(a: list[str], b: list[str], least: int = 2) -> int:
    """Greedy string tiling: words of a covered by disjoint common runs of at least `least` words with b.

    Lengths shrink from the longest power of two to `least`: windows of one length get equal numbers if they are equal
    (from the numbers of their halves), and each window of a that is free takes the first free one of b and grows as far
    as both go on. Tiles are never shorter than the window, so a window is free if its ends are; places of b that
    are taken are never looked at again. The time is that of sorting, however repetitive the texts are.
    """
    used_a, used_b, covered = bytearray(len(a)), bytearray(len(b)), 0
    names: dict = {}
    ids = [[names.setdefault(w, len(names)) for w in x] for x in (a, b)]
    levels, s = [(1, ids)], 1
    while 2 * s <= min(len(a), len(b)):
        names = {}
        ids = [[names.setdefault((x[i], x[i + s]), len(names)) for i in range(len(x) - 2 * s + 1)] for x in ids]
        s *= 2
        levels.append((s, ids))
    todo = [(s, ids) for s, ids in reversed(levels) if s >= least]
    if least not in (1, *(s for s, _ in todo)) and least <= min(len(a), len(b)):
        todo.append((least, [[tuple(x[i : i + least]) for i in range(len(x) - least + 1)] for x in (a, b)]))
    for s, (in_a, in_b) in todo:
        at: dict = {}
        for j in range(len(in_b) - 1, -1, -1):
            at.setdefault(in_b[j], []).append(j)
        i = 0
        while i < len(in_a):
            if used_a[i] or used_a[i + s - 1] or not (places := at.get(in_a[i])):
                i += 1
                continue
            while places and (used_b[places[-1]] or used_b[places[-1] + s - 1]):
                places.pop()
            if not places:
                i += 1
                continue
            j, k = places.pop(), s
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                k += 1
            used_a[i : i + k] = used_b[j : j + k] = b"\1" * k
            covered += k
            i += k
    return covered


def slightly_altered(prompt: list[str], answer: list[str]) -> bool:
    """One word left out, doubled, exchanged with its neighbour or altered; a question word that is replaced is answered."""
    i, n, m = 0, len(prompt), len(answer)
    if abs(n - m) > 1:
        return False
    while i < min(n, m) and prompt[i] == answer[i]:
        i += 1
    j = 0
    while j < min(n, m) - i and prompt[n - 1 - j] == answer[m - 1 - j]:
        j += 1
    x, y = prompt[i : n - j], answer[i : m - j]
    if len(x) == len(y) == 1:
        return x[0] not in ASKING or y[0][:1] == x[0][:1]
    if not x and len(y) == 1:
        return y[0] in prompt[max(0, i - 1) : i + 1]
    return not y or len(x) == 2 and x == y[::-1]


def is_copied(prompt: list[str], answer: list[str], share: float = 0.88) -> bool:
    """The answer's words are the whole prompt's, in runs, and nothing else, once or several times over.

    An exact copy counts at any length. One word may be altered from four words on, where it is a small part.
    """
    if not prompt or not answer:
        return False
    if answer[0] in LABELS and prompt[0] != answer[0]:
        answer = answer[1:]
    n, times = len(prompt), max(1, round(len(answer) / len(prompt)))
    if len(answer) == times * n and answer == prompt * times:
        return True
    if n < 4 or not min(share * n, n - 1) <= len(answer) / times <= max(n / share, n + 1):
        return False
    asked, most = Counter(prompt), max(times * n, len(answer))
    common = sum(min(n, times * asked[w]) for w, n in Counter(answer).items())
    if common < min(share * most, most - times):
        return False
    cut = [round(i * len(answer) / times) for i in range(times + 1)]
    return all(prompt == x or slightly_altered(prompt, x) or tiles(prompt, x) >= share * max(n, len(x)) for x in (answer[i:j] for i, j in zip(cut, cut[1:], strict=False)))


def open_structure(text: str) -> list[str]:
    """What a pushdown parser over fences, brackets, quotations, ** emphasis, inline code and tags has left open at the end.

    Inside code only what ends it and brackets count. Emphasis and inline code end with their paragraph or list entry,
    open or not. A quotation mark repeated at the start of a paragraph goes on with the quotation; a straight one after
    a digit is a unit. Single * and _, and single quotation marks, aren't parsed: they are bullets, names, apostrophes.
    """
    stack: list[str] = []
    opened: Counter[str] = Counter()
    closed: set[str] | None = None

    def push(mark: str) -> None:
        stack.append(mark)
        opened[mark] += 1

    def close(mark: str) -> None:
        while opened[mark]:
            opened[x := stack.pop()] -= 1
            if x == mark:
                return

    for m in _STRUCTURE.finditer(text):
        t, i, j = m.group(), m.start(), m.end()
        before, after = text[i - 1 : i], text[j : j + 1]
        if t == "```":
            if opened[t]:
                close(t)
            else:
                push(t)
        elif t[0] == "\n":
            for mark in ("`", "**"):
                if opened[mark] and not opened["```"]:
                    stack.remove(mark)
                    opened[mark] -= 1
        elif t == "`" and not opened["```"]:
            if opened[t]:
                close(t)
            elif not before.isalnum() and after.strip():
                push(t)
        elif opened["`"] and not opened["```"] or t[0] == "\\":
            continue
        elif t in _CLOSING:
            close(_CLOSING[t])
        elif t in "([{":
            push(t)
        elif opened["```"]:
            continue
        elif t == '"' and opened[t]:
            if not (before == "\n" and after.isalnum()):
                close(t)
        elif t in "«»„“”\"":
            ending = t != '"' or before.strip() and not after.isalnum()
            if ending and any(opened[q] for q in _QUOTES if t in _QUOTES[q]) and (t != "“" or opened["„"] or before.strip() and not after.isalnum()):
                close(next(q for q in reversed(stack) if t in _QUOTES.get(q, "")))
            elif t == '"':
                if not before.isalnum() and before not in ('"', ".", "!", "?", "…", "%", "′") and not (after.isspace() and before.strip()):
                    push(t)
            elif not opened[t] and (t in "«„“" or after.isalnum() and not before.isalnum()):
                push(t)
        elif t[:2] == "**":
            if opened["**"] and before.strip():
                close("**")
            elif len(t) <= 3 and not before.isalnum() and after.strip():
                push("**")
        elif t[0] == "<" and not t.endswith("/>"):
            name = re.match(r"</?([\w-]+)", t).group(1).lower()
            if t[1] == "/":
                close(f"<{name}")
            else:
                if closed is None:
                    closed = {x.lower() for x in re.findall(r"</([a-zA-Z][\w-]*)", text)}
                if name in _TAGS or name in closed:
                    push(f"<{name}")
    return stack


def is_truncated(prompt: str, answer: str, form: str | None) -> bool:
    text = answer.strip(_BLANK)
    left = open_structure(text)
    if left:
        return True
    if (m := _CUT_TAG.search(text[text.rfind("<") :] if "<" in text else "")) and (m.group(1) or (m.group(2) or "").lower() in _TAGS):
        return True
    if text.endswith("```") and "```" in text[:-3]:
        return False
    if text.startswith("{"):
        return not text.endswith("}")
    end = text.rstrip("*_`\"'”“’«»~" + _BLANK)
    if not end:
        return False
    last = end[-1]
    if last in ",;:-–—([{" or end.endswith((" and", " or")):
        return True
    if form in ("label", "number", "json"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    items = [_ITEM.sub("", x).strip("*_` ") for x in lines]
    if form == "list" or (len(lines) > 1 and sum(bool(_ITEM.match(x)) for x in lines) >= len(lines) / 2):
        if not items[-1]:
            return True
        ended = sum(x[-1:] in ".!?" for x in items[:-1] if x)
        if len(items) > 1 and ended * 2 > len(items) - 1:
            return items[-1][-1:].isalnum()
        if len(items) == 1:
            items = [x.strip() for x in re.split(r"[,;|/]", items[0]) if x.strip()]
        if len(items) >= 3 and all(len(x.split()) <= 3 for x in items):
            asked = {x.lower() for x in WORD.findall(prompt.lower())}
            known = [all(w in asked for w in WORD.findall(x.lower())) for x in items]
            if sum(known[:-1]) >= 0.8 * (len(items) - 1):
                wanted = [x for x in re.split(r"[,;\n]", prompt.rpartition(":")[2]) if WORD.search(x)]
                return not known[-1] or 3 <= len(items) < len(wanted) and all(len(x.split()) <= 4 for x in wanted)
        return False
    return last.isalnum() and len(WORD.findall(end)) >= 3


def defect(prompt: str | None, answer: str | None, lang: str | None, form: str | None, system: str | None, guess: Guess) -> str | None:
    """empty, refusal, copied_question, other_language, truncated or None; the first that applies."""
    prompt, answer = prompt or "", answer or ""
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    q, a = WORD.findall(prompt.lower()), WORD.findall(answer.lower())
    if is_copied(q, a):
        return "copied_question"
    if len(a) >= 3 and (said := guess.of(a)):
        asked = guess.of(q) or lang
        if asked and said != asked and guess.clear(a, said, asked) and not _OTHER.search(f"{prompt}\n{system or ''}"):
            return "other_language"
    if is_truncated(prompt, answer, form):
        return "truncated"
    return None


def defective_pairs(chat: DataFrame, common: DataFrame) -> DataFrame:
    """(row_id, defect) of each defective row of chat, one defect a row.

    common(lang, word): frequent words by language; a fixed table of a few hundred rows, sent to the tasks. One
    narrow pass, no shuffle. Null and blank answers are `empty`; a null prompt counts as an empty text; a null
    lang is guessed from the prompt; very long texts are read whole.
    """
    guess = Guess.of_table(common)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("user_text", "assistant_text", "lang", "answer_format", "system_text")]
            found = [defect(*x, guess) for x in zip(*cols, strict=True)]
            keep = [i for i, d in enumerate(found) if d]
            yield pa.RecordBatch.from_arrays([b.column("row_id").take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.string())], ["row_id", "defect"])

    return chat.select("row_id", "user_text", "assistant_text", "lang", "answer_format", "system_text").mapInArrow(flag, "row_id long, defect string")
