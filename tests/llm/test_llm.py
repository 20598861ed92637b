import glob
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import copies, leaks, overlaps, packing, pairs, quality, tiles, tokens, wordsets
from corpusmill.llm.components import components
from corpusmill.llm.language import Guess
from corpusmill.session import table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")
LEXICON = [a + b + c for a in ("ber", "tal", "mor", "vex") for b in "aeiou" for c in ("lin", "nor", "dix", "sun", "")]


def words(u, a):
    return frozenset(WORD.findall(f"{u or ''} {a or ''}".lower()))


def overlap(x, y):
    return Fraction(len(x & y), len(x | y)) if x | y else Fraction(0)


def noisy(rng, n, copies_of_one=0):
    """Records with near copies at every distance, exact copies, nulls, blanks and one very long text."""
    base = [[rng.choice(LEXICON) for _ in range(rng.randrange(4, 30))] for _ in range(n // 3)]
    out = []
    for b in base:
        for _ in range(3):
            w = list(b)
            for _ in range(rng.randrange(0, 1 + len(w) // 3)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(LEXICON)], [w[k], "extra"]])
                if not w:
                    w = ["one"]
            out.append((" ".join(w[: len(w) // 2]), ", ".join(w[len(w) // 2 :]).upper()))
    out += [("same prompt words here now", "the same answer")] * copies_of_one
    return [*out, (None, None), ("", " "), (None, "!!"), ("x " * 60_000 + " ".join(LEXICON), None)]


def splits(rng, rows):
    return [(i + 1, rng.choice(["train", " Training", "VAL", "dev", "test", "holdout", None, "train", "train"]), u, a) for i, (u, a) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_split_pairs_equal_brute_force(spark, chat, seed):
    rows = splits(random.Random(seed), noisy(random.Random(seed), 240, copies_of_one=40))
    side = {"train": 1, "training": 1, "val": 0, "validation": 0, "valid": 0, "dev": 0, "test": 0, "testing": 0}
    know = [(i, words(u, a), side.get((s or "").strip().lower())) for i, s, u, a in rows]
    want = {(min(i, j), max(i, j)) for i, x, s in know if s == 0 for j, y, t in know if t == 1 and overlap(x, y) >= Fraction(7, 10)}
    got = [tuple(r) for r in overlaps.cross_split_pairs(chat(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_hot_words_in_blocks_give_the_same_pairs(spark, chat, monkeypatch):
    rows = splits(random.Random(5), noisy(random.Random(5), 150))
    want = {tuple(r) for r in overlaps.cross_split_pairs(chat(rows)).collect()}
    monkeypatch.setattr(overlaps, "LIST_BLOCK", 7)
    assert {tuple(r) for r in overlaps.cross_split_pairs(chat(rows)).collect()} == want


def brute_groups(rows):
    know = [(i, words(u, a)) for i, _, u, a in rows]
    root = {i: i for i, _ in know}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(know):
        for j, y in know[:k]:
            if overlap(x, y) >= Fraction(7, 10):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    g = defaultdict(list)
    for i in root:
        g[find(i)].append(i)
    return {(min(v), x) for v in g.values() if len(v) > 1 for x in v}


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicate_groups_reach_brute_force(spark, chat, seed):
    rows = [(i + 1, None, u, a) for i, (u, a) in enumerate(noisy(random.Random(seed), 240, copies_of_one=90))]
    want = brute_groups(rows)
    got = {tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()}
    in_one = lambda groups: {r for _, r in groups}
    assert len(in_one(want) ^ in_one(got)) <= 0.01 * len(want)
    assert in_one(got) <= in_one(want)


def test_near_duplicates_in_a_hot_cluster(spark, chat):
    """A third of all rows are near copies of one text, each different."""
    rng = random.Random(9)
    hot = [LEXICON[:40] for _ in range(120)]
    hot = [w[:k] + [f"own{i}"] + w[k + 1 :] for i, w in enumerate(hot) for k in [rng.randrange(40)]]
    rest = [[f"w{rng.randrange(5000)}" for _ in range(20)] for _ in range(240)]
    rows = [(i + 1, None, " ".join(w), None) for i, w in enumerate(hot + rest)]
    got = [tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()]
    assert {r for g, r in got if g == 1} == set(range(1, 121))


def test_empty_tables_and_clashing_columns(spark, chat):
    none = chat([])
    assert overlaps.cross_split_pairs(none).count() == 0 and overlaps.near_duplicate_groups(none).count() == 0
    assert copies.formatting_copies(none).count() == 0
    rows = [(1, "train", "a b c d e f", "g"), (2, "val", "a b c d e f", "G!")]
    odd = chat(rows, side="x", words="x", key="x", n="x", **{"class": "x"})
    assert [tuple(r) for r in overlaps.cross_split_pairs(odd).collect()] == [(1, 2)]
    assert {tuple(r) for r in overlaps.near_duplicate_groups(odd).collect()} == {(1, 1), (1, 2)}
    assert {tuple(r) for r in copies.formatting_copies(odd).collect()} == {(1, 1), (1, 2)}


def test_kernel_loses_no_pair(spark):
    rng = np.random.default_rng(0)
    sets = [frozenset(rng.integers(0, 80, rng.integers(5, 40)).tolist()) for _ in range(300)]
    p = np.zeros(len(sets), tiles.POSTING)
    for i, s in enumerate(sets):
        lo, hi = 0, 0
        for w in s:
            b = w * 7919 % 128
            lo, hi = (lo ^ 1 << b, hi) if b < 64 else (lo, hi ^ 1 << (b - 64))
        p[i] = (1, i, lo, hi, len(s), 0, i % 2, 0)
    for sided in (True, False):
        q = p.copy()
        q["side"] = q["side"] if sided else 0
        q = tiles.arrange(q)
        got = {tuple(sorted((int(q["id"][a]), int(q["id"][b])))) for i, j in tiles.candidates(q, 5, 10, sided) for a, b in zip(i, j)}
        want = {(i, j) for j in range(300) for i in range(j) if (not sided or i % 2 != j % 2) and overlap(sets[i], sets[j]) >= Fraction(1, 2)}
        assert want <= got


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(x, 100) for x in range(100, 130)} | {(200, 200), (201, 200)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def guess(spark):
    return Guess.of_table(table(spark, SMALL, "common_words"))


EN = "The old worker follows the narrow path, and the whole crew was there before it."
DE = "Der alte Arbeiter folgt dem Weg, und die ganze Gruppe war nicht vor der Zeit da."


@pytest.mark.parametrize(
    "prompt,answer,form,want",
    [
        (EN, None, "text", "empty"), (EN, "  \n", "text", "empty"), (EN, "N/A", "text", "empty"), (EN, "…", "text", "empty"), (EN, "<empty>", "label", "empty"), (EN, "​", "text", "empty"),
        (EN, "I'm sorry, but I can't help with that request. I hope you understand.", "text", "refusal"), (EN, "Leider kann ich diese Frage nicht beantworten.", "text", "refusal"), (EN, "Lo siento, pero no puedo ayudar con eso.", "text", "refusal"),
        (EN, 'The note was short. He answered her: "I am sorry, but I cannot look at the kettle."', "text", None),
        (EN, EN, "text", "copied_question"), (EN, "Q: " + EN.upper(), "label", "copied_question"), ("Copy the words between the marks for them, nothing else. <<" + EN + ">>", EN, "exact", None),
        (EN, EN + " " + EN, "text", "copied_question"), (EN, "К сожалению, ответить на это мне нельзя.", "text", "refusal"),
        (EN, DE, "text", "other_language"), ("Translate into German: " + EN, DE, "text", None), (EN, "solanar", "label", None),
        (EN, "The cat was on the mat and then the", "text", "truncated"), (EN, "It was one thing. And the crew was there,", "text", "truncated"), (EN, '{"name": "x", "tag":', "json", "truncated"), (EN, '{"name": "x"}', "json", None),
        (EN, "It was so.\n```yaml\na: 1\n```", "text", None), (EN, "It was so.\n```yaml\na: 1", "text", "truncated"), (EN, "- one\n- two\n-", "list", "truncated"), (EN, "1. one\n2. two", "list", None), (EN, "451", "number", None),
        (EN, "It was so (and the crew was there.", "text", "truncated"), (None, "It was the crew.", "text", None), (None, None, None, "empty"),
    ],
)
def test_defects(guess, prompt, answer, form, want):
    assert pairs.defect(prompt, answer, "en", form, None, guess) == want


def test_padded_marks_are_empty():
    for x in ("N/A", "none", "No answer", "…", "TODO"):
        for pad in (" " * 80, "\n" * 100, "-" * 70, "\u200b" * 64):
            assert pairs.is_empty(x + pad) and pairs.is_empty(pad + x + pad)
    assert not pairs.is_empty("No answer is right here." + " " * 80) and not pairs.is_empty("none " * 20)


def test_refusals_of_any_length(guess):
    long = "I'm sorry, but after reading your request with care and thinking about it for quite a while I have to say that I cannot help you with that particular question at this time. "
    more = "Thank you so much for asking such a thoughtful question about the kettle, and for the patience that you have shown. If there is anything else that you would like to talk about today, please let me know and I will gladly do my best. "
    german = "Leider muss ich Ihnen nach langem Nachdenken über die Frage und über alles, was damit zusammenhängt, mitteilen, dass ich sie heute und auch in Zukunft nicht beantworten kann."
    assert len(long) < 400 < len(long + more + more)
    for x in (long, german, long + more, more + long, long + more * 50):
        assert pairs.defect(EN, x, "en", "text", None, guess) == "refusal"
    for x in (long + EN, long + more + "The kettle holds two litres.", long[:-2] + ", but here is what the note says about the kettle.", "I cannot list all\n- the crew\n- the path", "I cannot run it, but this does:\n```python\nprint(1)\n```"):
        assert pairs.defect(EN, x, "en", "text", None, guess) != "refusal"
    assert not pairs.is_refusal("ich " * 300_000)


@pytest.mark.parametrize(
    "prompt,answer,want",
    [
        ("Who are you?", "who are you", True), ("Why?", "Q: why", True), ("Who are you?", "Who are you? Who are you?", True), ("Who are you?", "Who are they?", False), ("Who?", "me", False), ("", "", False), ("Why?", "Q", False),
        ("Name the old red kettle", "Name the old blue kettle", True), ("Name the colour of the old red kettle", "Name the color of the old red kettle", True), ("Name the colour of the old red kettle", "Name the colour of the red kettle", True),
        ("Name the old kettle", "Name the the old kettle", True), ("Name the old kettle", "the Name old kettle", True), ("Name the old kettle", "Name an odd kettle", False),
        ("What is the capital of France?", "Paris is the capital of France.", False), ("What is the capital of France?", "Whats is the capital of France?", True), ("The capital of France is", "The capital of France is Paris", False),
    ],
)
def test_short_prompts_given_back(prompt, answer, want):
    words = lambda x: WORD.findall(x.lower())
    assert pairs.is_copied(words(prompt), words(answer)) == want


@pytest.mark.parametrize(
    "answer,form,want",
    [
        ("Er sagte: „Die Gruppe war da. Der Weg war alt.", "text", True), ("Er sagte: „Die Gruppe war da.“", "text", False), ("Il dit : « Le groupe est là.", "text", True), ("Il dit : « Le groupe est là. »", "text", False), ("Er sagte: »Die Gruppe war da.", "text", True), ("Er sagte: »Die Gruppe war da.«", "text", False),
        ("“It was so. And then.", "text", True), ("“It was so.\n\n“And then.”", "text", False), ("“red", "label", True), ("«4", "number", True), ('"x. y', "json", True), ('Sie sagte: „Es war so."', "text", False), ("Er sagte: »So.« Sie sagte: »Es war", "label", True), ('{"a": "x \\" y", "b": [1]}', "json", False), ('"It was so. And then.', "text", True), ('"It was so." He left.', "text", False),
        ('A 5" pipe and a 6" pipe.', "text", False), ('"It was so.\n"And then."', "text", False), ('He said "yes" and ("no").', "text", False), ("Run `ls -l. It is so.", "text", True), ("Run `ls (-l` first.", "text", False), ("It was **so old. And.", "text", True), ("It was **so** old, 2**3 = 8.", "text", False), ("- **a\n- b.\n- c.", "list", False),
        ("<b>It was so.", "text", True), ("<b>It was so.</b><br>", "text", False), ("Use <name> as the key.", "text", False), ("<item>It was so.</item><item>And then.", "text", True), ("It was <b>so</b> old.</", "text", True), ("It was <span class", "label", True), ("If a < b it was so.", "text", False), ("```\na `b \"c\n```", "text", False),
    ],
)
def test_breaks_off_inside_quotations_and_markup(answer, form, want):
    assert pairs.is_truncated(EN, answer, form) == want


def test_many_open_marks_cost_linear_time():
    assert len(pairs.open_structure("(" * 300_000)) == 300_000 and pairs.open_structure("(" * 200_000 + ")" * 200_000) == []


def test_defective_pairs_over_a_table(spark, chat):
    df = chat([(1, None, EN, None), (2, None, EN, "It was fine, and so was the crew. " * 20_000), (3, None, None, "ok")])
    got = {r.row_id: r.defect for r in pairs.defective_pairs(df, table(spark, SMALL, "common_words")).collect()}
    assert got == {1: "empty"}
    assert pairs.defective_pairs(df.where("false"), table(spark, SMALL, "common_words").where("false")).count() == 0


def test_tiling_counts_whole_runs():
    a, b = "a b c d e f g".split(), "x e f g a b c".split()
    assert pairs.tiles(a, b) == 6 and pairs.tiles(a, a) == 7 and pairs.tiles(a, ["z"]) == 0


def test_tiling_of_repetitive_texts():
    rng = random.Random(7)
    a, b = ([rng.choice("ab") for _ in range(5000)] for _ in "xy")
    began = time.time()
    assert pairs.tiles(a, b) > 4500 and pairs.tiles(a, a) == 5000
    assert time.time() - began < 2
    for _ in range(200):  # disjoint runs: never more than the words in common, all of them where texts are equal
        x, y = ([rng.choice("abcde") for _ in range(rng.randrange(0, 14))] for _ in "xy")
        n = pairs.tiles(x, y)
        assert n <= sum((Counter(x) & Counter(y)).values()) and n != 1 and pairs.tiles(x, x) in (len(x), 0 if len(x) < 2 else len(x))


def _tokenizers():
    P = pytest.importorskip("public_tokenizers")
    return P


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_automaton_counts_what_the_tokenizer_encodes(spark, name):
    P = _tokenizers()
    import tiktoken

    ranks = tokens.load_ranks(P.path(name))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = tokens.TokenAutomaton(ranks, P.PATTERN)
    texts = [r.text or "" for f in glob.glob(f"{SMALL}/documents.parquet") for r in spark.read.parquet(f).select("text").collect()]
    for t in [*texts, "", "aaaaaaaaaaaaaaaaaaa", "   \n\n\t x", "Straße 1234567 😀é中文", "=" * 300]:
        assert machine.count(t) == len(enc.encode_ordinary(t)), t[:50]


def test_byte_vocabulary_is_the_utf8_length(spark):
    machine = tokens.TokenAutomaton(tokens.BYTE_VOCABULARY)
    df = spark.createDataFrame([("é😀 x",), (None,), ("",)], "t string")
    assert [r.n for r in tokens.with_token_count(df, "t", "n").collect()] == [machine.count(t) for t in ("é😀 x", None, "")] == [8, 0, 0]


def test_wrong_targets(spark, chat):
    c = chat([(1, None, None, " \tabc\n"), (2, None, None, None), (3, None, None, "x" * 100)])
    e = spark.createDataFrame([(1, 1, 4, 512), (2, 1, 5, 512), (3, 2, 1, 512), (4, 3, 49, 50), (5, 3, None, 50), (6, 9, 7, 50), (7, None, None, 50), (8, 1, 4, None)], "enc_id bigint, row_id bigint, target_token_count bigint, max_length bigint").withColumn("shard_id", F.lit(0).cast("long")).withColumn("task_family", F.lit("x"))
    assert sorted(r.enc_id for r in tokens.wrong_targets(e, c).collect()) == [2, 5, 7]
    assert tokens.wrong_targets(e.where("false"), c.where("false")).count() == 0


def plain_copies(rows):
    g = defaultdict(list)
    for i, _, u, a in rows:
        k = sorted("".join(c for c in (t or "").upper().lower() if c.isalnum()) for t in (u, a))
        g[tuple(k)].append(i)
    return {(min(v), x) for v in g.values() for x in v}


def test_formatting_copies_equal_brute_force_with_a_hot_group(spark, chat):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        u, a = ("One Text, here", "and Answer") if i % 3 == 0 else (f"text {rng.randrange(90)}", rng.choice(["ja", "ß", None, "x" * 50_000]))
        u = "".join(c.upper() if rng.random() < 0.5 else c for c in u).replace(" ", rng.choice([" ", "  ", "\n", " -- "]))
        rows.append((rng.randrange(10**9), None, *((u, a) if rng.random() < 0.5 else (a, u))))
    rows += [(10**9 + 1, None, None, None), (10**9 + 2, None, "", "!?"), (10**9 + 3, None, "ab", "c"), (10**9 + 4, None, "a", "bc")]
    got = {tuple(r) for r in copies.formatting_copies(chat(rows).repartition(9)).collect()}
    assert got == plain_copies(rows)
    reps = {r.kept_id: r.copies for r in copies.representatives(chat(rows)).collect()}
    assert reps == Counter(k for k, _ in plain_copies(rows))


def test_packing_places_every_token_once(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 50, 700, 4095, 4096, 4097, 9000]) + rng.randrange(60) for _ in range(700)]
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)] + [(10_000, None), (10_001, "")], "doc_id bigint, text string").repartition(7)
    rows = packing.packed(docs).collect()
    fill, of = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r.container, r.container_piece] += r.tokens
        of[r.doc_id].append((r.start, r.tokens))
    assert max(fill.values()) <= 4096
    for i, n in enumerate(sizes):
        got = sorted(of.get(i, []))
        assert [s for s, _ in got] == [k * 4096 for k in range(len(got))] and sum(t for _, t in got) == n and len(got) == -(-n // 4096)
    s = packing.packing_summary(packing.packed(docs)).first()
    assert s.containers == len(fill) and s.unused_share < 0.06
    assert packing.packed(docs.where("false")).count() == 0 and packing.packing_summary(packing.packed(docs.where("false"))).first().containers == 0


@pytest.mark.parametrize("width", ["1", "8"])
def test_packing_merges_whatever_the_shuffle_width(spark, width):
    docs = spark.range(0, 400, 1, 40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        s = packing.packing_summary(packing.packed(docs)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert s.containers == 100 and s.unused_share < 0.03


def brute_leaks(docs, items, least=12):
    grams = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - least + 1):
            grams[tuple(w[k : k + least])].add(i)
    return {(d, i) for d, t in docs for w in [WORD.findall((t or "").lower())] for k in range(len(w) - least + 1) for i in grams.get(tuple(w[k : k + least]), ())}


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: [rng.choice(LEXICON[:12]) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "a " * 30)]
    docs = []
    for d in range(200):
        w = text(rng.randrange(0, 60))
        if d % 3 == 0:
            src = items[rng.randrange(30)][1].split()
            k = rng.randrange(len(src))
            w[3:3] = src[k : k + rng.randrange(8, 20)]
        docs.append((d, rng.choice([" ", ", ", "\n--\n", "_"]).join(w).title()))
    docs += [(900, None), (901, ""), (902, "A-" * 12), (903, "b a " * 20_000)]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(dd, ii).collect()} == want and (902, 92) in want
    monkeypatch.setattr(leaks, "SHARD_WORDS", 300)
    monkeypatch.setattr(leaks, "ITEM_BLOCK_CHARS", 900)
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(dd, ii).collect()} == want
    assert leaks.leaks(dd.where("false"), ii).count() == 0 and leaks.leaks(dd, ii.where("false")).count() == 0
    clean = leaks.without_leaks(dd, leaks.leaks(dd, ii))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_longest_match_is_reported(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(f"W{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(0, 13))
    (m,) = leaks.matches([(1, doc)], leaks.Items([(7, item)]))
    assert m == (1, 7, 25, 2)


def test_longest_matches_equal_brute_force():
    rng = random.Random(8)
    word = lambda: rng.choice("abc")
    for least in (2, 3, 5):
        docs = [(d, " ".join(word() for _ in range(rng.randrange(0, 40)))) for d in range(12)]
        items = [(i, " ".join(word() for _ in range(rng.randrange(0, 25)))) for i in range(9)] + [(50, "a " * 20), (51, None)]
        want = set()
        for d, t in docs:
            for i, u in items:
                x, y = WORD.findall(t), WORD.findall(u or "")
                run = {(p, q): next((k for k in range(len(y)) if p + k >= len(x) or q + k >= len(y) or x[p + k] != y[q + k]), len(y)) for p in range(len(x)) for q in range(len(y))}
                if run and max(run.values()) >= least:
                    want.add((d, i, max(run.values()), min(p for (p, _), k in run.items() if k == max(run.values()))))
        assert set(leaks.matches(docs, leaks.Items(items), least)) == want and want


def test_matches_in_repeated_passages_cost_no_squares():
    began = time.time()
    assert leaks.matches([(5, "b " + "a " * 30_000)], leaks.Items([(1, "a " * 30_000)])) == [(5, 1, 30_000, 1)]
    assert time.time() - began < 5


PROSE = "The worker was there before the crew. It was not only the path, but also the whole trip that they had to make! "


@pytest.mark.parametrize(
    "text,want",
    [
        ("", "junk"), (None, "junk"), ("???", "junk"), ("spare noun. " * 60, "junk"), ("\n".join(f"{i * 2654435761 % 2**64:032x}" for i in range(1, 9)), "junk"), ('[train] {"step": 0, "loss": 4.6}\n[train] {"step": 10, "loss": 0.6}', "junk"),
        ("a;b;c\n1;2;3\n4;5;6\n7;8;9", "table"), ("who   note    rate\nJo    plain   1.2\nKa    dense   3.4\nLu    spare   5.6", "table"), ("| a | b |\n|---|---|\n| c | d |\n| e | f |", "table"),
        ("- reads the old book\n- opens the red door\n- closes it", "list"), ("Changes:\nalpha: 1\nbeta: true\ngamma: 3", "list"), ("red door\nold book\nnew path\nlong trip\nshort way", "list"), (PROSE * 3, None),
    ],
)
def test_shapes(text, want):
    assert quality.kind_of(text, WORD.findall((text or "").lower())) == want


def test_long_log_lines_and_long_repeated_blocks_are_junk():
    kind = lambda x: quality.kind_of(x, WORD.findall(x.lower()))
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(LEXICON) + rng.choice(LEXICON) for _ in range(n))
    assert kind("\n".join(f'{{"note": "{say(40)}", "level": "ERROR"}}' for _ in range(12))) == "junk"
    assert kind("\n".join(f"[train] {say(60)} step {i}" for i in range(12))) == "junk"
    for block in (say(300), "\n".join(f"- {say(3)}" for _ in range(120))):
        assert len(set(zip(block.split(), block.split()[1:]))) > 200 and kind("\n".join([block] * 9)) == "junk"
    few = [f"w{chr(97 + i)}" for i in range(26)]
    assert kind("\n".join(f"{rng.choice(few)}: {rng.choice(few)}" for _ in range(4000))) == "list"


def test_marked_sentences_are_entries_and_dialogue_is_not():
    bullets = ["• The whole crew was there.", "• It was not only the path, but the loss fell to 1.23.", "• They had to make the trip!"]
    assert quality.entry_share(bullets) == 1.0 and quality.entry_share(bullets[:1]) == 0.0 and quality.entry_share([]) == 0.0
    assert quality.entry_share(["1. One thing.", "2) Another thing", "Prose that ends."]) == pytest.approx(2 / 3)
    assert quality.entry_share(["— They left. It was late.", "— So they said."]) == 0.0
    assert quality.entry_share(["- They left. It was late. The crew stayed.", "- So it went on. And on."]) == 0.0


def test_quality_tells_prose_from_the_rest(spark):
    rng = random.Random(6)
    vocab = LEXICON + "path crew door book trip road house river".split()
    common = [r.word for r in table(spark, SMALL, "common_words").where("lang = 'en'").collect()]
    sentence = lambda: " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice(vocab) for _ in range(rng.randrange(8, 16))).capitalize() + "."
    docs = [(i, " ".join(sentence() for _ in range(rng.randrange(4, 20))), rng.choice(["en", None])) for i in range(300)]
    docs += [(1000 + i, "\n".join(f"- {rng.choice(vocab)} {rng.choice(vocab)} {rng.choice(vocab)}" for _ in range(12)), "en") for i in range(20)]
    docs += [(2000 + i, "\n".join(";".join(rng.choice(vocab) for _ in range(4)) for _ in range(9)), "en") for i in range(20)]
    docs += [(3000 + i, " ".join(str(rng.randrange(256)) for _ in range(90)), None) for i in range(20)] + [(4000, None, None), (4001, "", "xx")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.kind for r in quality.scored(df, table(spark, SMALL, "common_words")).collect()}
    assert sum(got[i] is not None for i in range(300)) <= 3
    assert all(got[1000 + i] == "list" and got[2000 + i] == "table" and got[3000 + i] == "junk" for i in range(20)) and got[4000] == got[4001] == "junk"
    r = quality.scored(df, table(spark, SMALL, "common_words")).where("doc_id = 3000").first()
    assert abs(sum(r.contributions) - r.distance2) < 1e-6 * r.distance2
    assert quality.scored(df.where("false"), table(spark, SMALL, "common_words")).count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    c = table(spark, SMALL, "chat_examples")
    for f in (overlaps.cross_split_pairs, overlaps.near_duplicate_groups, copies.formatting_copies):
        assert sorted(map(tuple, f(c.repartition(1)).collect())) == sorted(map(tuple, f(c.repartition(6)).collect()))


def test_dense_lists_are_linked_without_all_pairs(spark, chat, monkeypatch):
    """Lists with most pairs near: leaders, then labels, give the components that all pairs give."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    rows, i = [], 0
    for c in range(3):  # three clusters of near copies, of which each shares half its words with the others
        base = words[:20] + [f"c{c}x{k}" for k in range(20)]
        for _ in range(90):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(40)] = f"own{i}y{rng.randrange(9)}"
            i += 1
            rows.append((i, None, " ".join(w), None))
    want = brute_groups(rows)
    assert {tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()} == want
    monkeypatch.setattr(overlaps, "DENSE", 2)
    assert {tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()} == want
    monkeypatch.setattr(overlaps, "DENSE_WORDS", 700)  # lists of a few thousand words are grids of cells
    assert {tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()} == want


def test_hot_coordinate_values_are_cut_into_cells(spark, chat, monkeypatch):
    rows = [(i + 1, None, u, a) for i, (u, a) in enumerate(noisy(random.Random(6), 150))]
    want = {tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()}
    monkeypatch.setattr(overlaps, "LIST_BLOCK", 2)
    monkeypatch.setattr(overlaps, "HOT_LOOK", 1)
    assert {tuple(r) for r in overlaps.near_duplicate_groups(chat(rows)).collect()} == want and want


@pytest.mark.parametrize("sided", [True, False])
def test_grids_meet_every_pair_once(sided):
    n = 60
    side = (np.arange(n) % 3 == 0).astype(np.uint8) if sided else None
    h = np.where(np.arange(n) < 50, 7, 9).astype(np.uint64)
    at, number, s = tiles.grid(h, np.arange(n, dtype=np.uint64), side, np.array([7], np.uint64), np.array([[4, 3]]))
    seen = Counter()
    for k in set(number.tolist()):
        cell = [(int(a), int(b)) for a, b, c in zip(at, s, number, strict=True) if c == k]
        two = any(b for _, b in cell)
        seen.update(tuple(sorted((a, c))) for x, (a, b) in enumerate(cell) for c, e in cell[:x] if (b != e if two else not sided))
    pairs = {(i, j) for j in range(n) for i in range(j) if h[i] == h[j] and (not sided or side[i] != side[j])}
    assert set(seen) == pairs and set(seen.values()) == {1}


def test_dense_lists_keep_few_pairs():
    p = np.zeros(200, tiles.POSTING)
    p["n"], p["id"] = 10, np.arange(200)
    dense = []
    assert sum(len(x) for x, _ in tiles.candidates(p, 7, 10, False, dense)) <= 200 and dense == [(0, 200)]
    sets = [np.arange(10 * (i % 2), 10 * (i % 2) + 10, dtype=np.uint64) for i in range(200)]  # two groups of equal sets
    links = [(i, j) for x, y in tiles.forest(p, np.arange(200), np.concatenate(sets), lambda i, j: np.ones(len(i), bool), 7, 10) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(links) == 198 and all(i % 2 == j % 2 for i, j in links)
    assert not list(tiles.forest(p, np.arange(200) % 2, np.concatenate(sets), lambda i, j: np.ones(len(i), bool), 7, 10))


def test_word_sets_of_odd_texts(monkeypatch):
    texts = ["", "A b\u00df \u0130x A", "x_y z9", "\u0444\u044b\u0432\u0430 \u4e2d\u6587 \u00b2 \u2167", "w " * 3000 + "long" * 900, None]
    for chars in (1 << 20, 64):
        monkeypatch.setattr(wordsets, "SLICE_CHARS", chars)
        s = wordsets.Sets(texts, [None, "q", "", None, "end", None])
        want = [words(t, a) for t, a in zip(texts, [None, "q", "", None, "end", None], strict=True)]
        assert s.rows.tolist() == [i for i, w in enumerate(want) if w] and s.n.tolist() == [len(w) for w in want if w]
        alone = [wordsets.Sets([t], [a]).ids().tolist() for t, a in zip(texts, [None, "q", "", None, "end", None], strict=True)]
        assert s.ids().tolist() == [x[0] for x in alone if x]
