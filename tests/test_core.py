import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hashing, text
from corpusmill.operators import audit, compiled, dedup, encode, grids, metrics, records, runs, stats, tasks, validate
from corpusmill.sources import conversations as C


def rows(spark, data, schema="line bigint, id string, split string, task_family string, difficulty string, system string, user string, assistant string, answer_format string, eval_type string, metadata_json string"):
    return spark.createDataFrame(data, schema)


def conv(spark, items):
    """(line, id, split, system, user, assistant, metadata)"""
    return rows(spark, [(ln, i, s, "", "", sy, u, a, "", "", m) for ln, i, s, sy, u, a, m in items])


def test_content_hash_golden(spark):
    r = conv(spark, [(2, "", "", "Be exact", "prompt 0", "answer 0", "")]).select(hashing.content_hash("system", "user", "assistant")).first()[0]
    assert r == "5d048dd00f1db60366f645d802f22dc88b814265954532d79ce4d37975183810"


@pytest.mark.parametrize("t,fp,h", [("hello world", 18426460281723402111, "b94d27b9934d3e08"), ("Hello,   WORLD!", 18426460281723402111, "b94d27b9934d3e08"), ("the quick brown fox", 2229993738864163511, "9ecb36561341d18e"), ("straße ß", 18155979804286351333, None), ("!!!", 0, "e3b0c44298fc1c14"), ("", 0, "e3b0c44298fc1c14"), (None, 0, "e3b0c44298fc1c14")])
def test_fingerprint_goldens(spark, t, fp, h):
    r = spark.createDataFrame([(t,)], "t string").select(hashing.simhash()("t"), hashing.text_hash(text.fingerprint_text("t"))).first()
    assert r[0] % 2**64 == fp
    assert h is None or r[1].startswith(h)


def test_row_hash_golden(spark):
    assert spark.range(1).select(hashing.row_hash(1337)(F.lit("A cat sits on a mat."))).first()[0] == 2425650015550877427


def test_text_primitives_on_nulls_and_spaces(spark):
    df = spark.createDataFrame([("\x1c a\t b  ",), (None,), ("",)], "t string")
    got = df.select(text.strip("t"), text.collapse("t"), text.words("t"), text.utf8_bytes("t")).collect()
    assert got[0][0] == "a\t b" and got[0][1] == "a b" and got[0][2] == ["a", "b"]
    assert got[1] == ("", "", [], []) and got[2] == ("", "", [], [])
    big = "é" * 200_000
    n = spark.createDataFrame([(big,)], "t string").select(F.size(text.utf8_bytes("t")), text.bytes_text(text.utf8_bytes("t")) == F.col("t")).first()
    assert n == (400_000, True)


def test_audit_of_three_rows(spark):
    r = conv(spark, [(2, "a", "train", "", "hi", "yes", ""), (3, "a", "val", "", "more", "text", "{}"), (4, "b", "", "", "", "text", "[1]")])
    s = audit.summary(r).first()
    assert (s.total_rows, s.accepted_rows, s.rejected_rows, s.duplicate_ids, s.empty_user_rows, s.invalid_metadata_rows) == (3, 1, 2, 1, 1, 1)
    got = {x.line: x.reasons for x in validate.with_reasons(r).collect()}
    assert got == {2: [], 3: ["duplicate_id"], 4: ["empty_user", "invalid_metadata_json"]}
    with pytest.raises(Exception, match="line 4"):
        C.fail_fast(r).collect()


def test_audit_of_nothing(spark):
    s = audit.summary(conv(spark, [])).first()
    assert s.total_rows == s.accepted_rows == s.cross_split_duplicate_rows == 0
    assert [w.warning for w in audit.warnings(audit.summary(conv(spark, []))).collect()] == ["No row was accepted."]
    assert audit.counters(audit.with_split(conv(spark, []))).count() == 0


def test_split_is_kept_by_groups_and_fractions_are_checked(spark):
    r = conv(spark, [(i, str(i), "", "", f"u{i}", "a", json.dumps({"group_id": i % 5})) for i in range(50)])
    s = audit.with_split(r, train=0.5, val=0.25, test=0.25)
    assert s.groupBy("group_key").agg(F.count_distinct("assigned_split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        audit.with_split(r, train=0.5, val=0.1, test=0.1)
    unit = spark.range(1).select(hashing.keyed_unit_interval(1, b"p")(F.lit("x"))).first()[0]
    assert 0 <= unit < 1


def test_exact_and_near_duplicates_against_a_sequential_index(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(12)) for _ in range(40)]
    texts = [b if rng.random() < 0.5 else b + rng.choice([" alpha", "!", " x", ""]) for b in base for _ in range(3)] + ["", "", "?!"]
    rng.shuffle(texts)
    r = conv(spark, [(i, "", "", "", t, "", "") for i, t in enumerate(texts)])
    got = {x.line: (x.exact_of, x.near_of) for x in dedup.near_duplicates(r, 3, text=F.col("user")).collect()}
    fps = {x.line: x.fp for x in r.select("line", hashing.simhash()("user").alias("fp")).collect()}
    seen, index = {}, []
    for i, t in enumerate(texts):
        key = " ".join(__import__("re").findall(r"\w+", t.lower()))
        if key in seen:
            assert got[i] == (seen[key], None)
            continue
        seen[key] = i
        near = [j for j in index if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3]
        assert got[i] == (None, min(near, default=None)), t
        index.append(i)
    far = dedup.near_duplicates(r, 6, text=F.col("user"))
    assert far.count() == len(texts)


def test_near_duplicates_do_not_depend_on_partitioning(spark):
    r = conv(spark, [(i, "", "", "", f"word{i % 7} same text again and again", "", "") for i in range(60)])
    a = sorted(map(tuple, dedup.near_duplicates(r.repartition(1)).select("line", "exact_of", "near_of").collect()), key=str)
    b = sorted(map(tuple, dedup.near_duplicates(r.repartition(7)).select("line", "exact_of", "near_of").collect()), key=str)
    assert a == b


def test_leakage_status(spark):
    scan = spark.createDataFrame([(1, "h", "dev"), (2, "h", "public_eval"), (3, "h", "dev"), (4, "g", "dev")], "line bigint, hash string, split string")
    assert {r.line: r.status for r in dedup.leakage_status(scan).collect()} == {1: "new", 2: "cross_split_duplicate", 3: "known_same_split", 4: "new"}
    known = spark.createDataFrame([("g", "train")], "hash string, split string")
    assert {r.line: r.status for r in dedup.leakage_status(scan, known).collect()}[4] == "cross_split_duplicate"


def chat_row(spark, system, user, assistant):
    return conv(spark, [(1, "", "", system, user, assistant, "")])


def test_encoding_goldens(spark):
    e = encode.encode_chat(chat_row(spark, "rule", "question", "answer"), 128).first()
    assert (len(e.input_ids), e.target_token_count, e.truncated) == (25, 7, False)
    e = encode.encode_chat(chat_row(spark, "long" * 20, "question", "answer"), 4).first()
    assert (e.input_ids, e.labels, e.target_token_count, e.truncated) == ([260, 97, 110, 115], [-100, 97, 110, 115], 3, True)
    p = encode.encode_prompt(chat_row(spark, "rule", "hello", "x")).first().prompt_ids
    assert p[0] == 256 and p[-1] == 260 and p.count(257) == 2


def _encode_plain(system, user, assistant, most):
    b = lambda s: list(s.encode())
    p = [256] + ([258, *b(system), 257] if system else []) + [259, *b(user), 257]
    t = [*b(assistant), 257]
    if len(t) + 1 >= most:
        return [260, *t[: most - 1]], 1
    room = most - len(t) - 1
    if len(p) > room:
        p = [256] + (p[-(room - 1) :] if room > 1 else [])
    return [*p, 260, *t], len(p) + 1


@pytest.mark.parametrize("most", [2, 5, 9, 12, 13, 14, 20, 40])
def test_encoding_against_plain(spark, most):
    for s, u, a in (("s", "user", "answer"), ("", "ü", "é"), ("system", "u" * 30, "a" * 10)):
        e = encode.encode_chat(chat_row(spark, s, u, a), most).first()
        ids, first = _encode_plain(s, u, a, most)
        assert e.input_ids == ids and e.labels == [-100] * first + ids[first:]


def test_next_fit_golden_and_too_long(spark):
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate([5, 4, 3, 8, 2, 2])], "line bigint, n int, batch_id bigint")
    assert [r.bin for r in encode.next_fit(df, 8).orderBy("line").collect()] == [0, 1, 1, 2, 3, 3]
    with pytest.raises(Exception, match="longer"):
        encode.next_fit(df, 7).collect()


def test_packed_rows_have_one_mask_a_segment(spark):
    r = conv(spark, [(i, "", "", "", "u" * (i + 1), "a" * (3 + i), "") for i in range(5)])
    e = encode.encode_chat(r)
    placed = encode.next_fit(encode.in_batches(e.select("line", F.size("input_ids").alias("n")), 8), 40)
    for x in encode.packed_rows(e, placed, 40).collect():
        assert {len(x[c]) for c in ("input_ids", "labels", "segment_ids", "position_ids")} == {40}
        for i, s in enumerate(x.segment_ids):
            if s >= 0 and (i == 0 or x.segment_ids[i - 1] != s):
                assert x.labels[i] == -100 and x.position_ids[i] == 0


@pytest.mark.parametrize("epoch,order", [(0, [3, 0, 11, 8, 5, 2, 13, 10, 7, 4, 1, 12, 9, 6]), (1, [9, 4, 13, 8, 3, 12, 7, 2, 11, 6, 1, 10, 5, 0]), (2, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 0])])
def test_affine_order_golden(spark, epoch, order):
    df = spark.range(14).withColumnRenamed("id", "ordinal")
    got = encode.affine_order(df, 14, 99, epoch).orderBy("cursor").collect()
    assert [r.ordinal for r in got] == order


def test_ordinals_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "line bigint").repartition(6)
    assert sorted((r.line, r.ordinal) for r in encode.with_ordinal(df).collect()) == [(i, i) for i in range(101)]


def test_compiled_round_trip_and_corruption(spark, tmp_path):
    items = [(i, str(i), s, "Be exact", f"prompt {i}", f"answer {i}", "") for i, s in enumerate(["train"] * 14 + ["val"] * 3 + ["test"] * 3)]
    good = audit.with_split(conv(spark, items), respect_declared=True)
    path = str(tmp_path / "set")
    m = compiled.write_compiled(good, path)
    assert [m["splits"][s]["examples"] for s in ("train", "val", "test")] == [14, 3, 3]
    assert compiled.verify(spark, path) == []
    assert compiled.example_at(spark, path, "train", -1)["pos"] == 13
    with pytest.raises(IndexError):
        compiled.example_at(spark, path, "val", 3)
    with pytest.raises(FileExistsError):
        compiled.write_compiled(good, path)
    train = spark.read.parquet(f"{path}/shards").where("split = 'train'")
    all_at_once = [r.pos for r in compiled.resume(train, 14, 99, 0, 0, 14).orderBy("cursor").collect()]
    in_parts = [r.pos for a in (0, 5, 10) for r in compiled.resume(train, 14, 99, 0, a, 5).orderBy("cursor").collect()]
    assert all_at_once == in_parts == [3, 0, 11, 8, 5, 2, 13, 10, 7, 4, 1, 12, 9, 6]
    next((tmp_path / "set" / "shards").rglob("*.parquet")).unlink()
    assert compiled.verify(spark, path)


def test_language_metric_golden(spark):
    df = spark.createDataFrame([(0.9813453336, 117, 255)], "nll double, n int, raw_bytes int")
    r = metrics.language_metrics(df).first()
    assert abs(r.bits_per_token - 1.4157820462) < 1e-9 and abs(r.bits_per_byte - 0.6495941153) < 1e-9 and abs(r.perplexity - 2.6680432368) < 1e-8


def test_statistics_goldens(spark):
    df = spark.createDataFrame([(0.8, 0.7), (0.9, 0.85), (1.0, 0.95)], "a double, b double")
    r = stats.paired_comparison(df, "a", "b").first()
    assert (r.wins, r.losses, r.ties) == (3, 0, 0) and r.mean_difference > 0 and abs(r.sign_test_p - 0.25) < 1e-12
    s = stats.sample_summary(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v").first()
    assert (s["count"], s.mean) == (3, 2.0) and abs(s.ci_high - 2 - 4.303 / 3**0.5) < 1e-9
    one = stats.sample_summary(spark.createDataFrame([(5.0,)], "v double"), "v").first()
    assert (one.ci_low, one.ci_high, one.standard_deviation) == (5.0, 5.0, 0.0)
    big = spark.range(1).select(stats.sign_test(F.lit(5000).cast("long"), F.lit(5000).cast("long"))).first()[0]
    assert big == 1.0


def test_gates_do_not_compensate(spark):
    df = spark.createDataFrame([(1, 0.9, 3, 0, True), (2, 0.9, 3, 1, True), (3, 0.9, 3, 0, None), (4, None, 3, 0, True), (5, 0.1, 3, 0, True)], "k int, v double, s int, f int, r boolean")
    got = {r.k: r.decision for r in stats.gates(df, "v", "s", "f", 3, 0.8, 0.2, {"noise": "r"}).collect()}
    assert got == {1: "keep", 2: "kill", 3: "re_test", 4: "re_test", 5: "kill"}
    with pytest.raises(ValueError):
        stats.threshold_decision(F.lit(1.0), 0.1, 0.9)


def test_logit_filters_keep_ties_and_the_best(spark):
    s = spark.createDataFrame([(1, t, x) for t, x in enumerate([3.0, 2.0, 2.0, 0.0])], "k int, token int, score double")
    assert sorted(r.token for r in metrics.top_k(s, "k", 2).collect()) == [0, 1, 2]
    assert [r.token for r in metrics.top_p(s, "k", 0.01).collect()] == [0]
    assert {r.token for r in metrics.min_p(s, "k", 0.3).collect()} == {0, 1, 2}
    seen = spark.createDataFrame([(1, 0)], "k int, token int")
    assert metrics.argmax_penalised(s, seen, "k", 2.0).first().token == 1


def test_generation_diagnostics_on_empty_sequences(spark):
    df = spark.createDataFrame([(["a", "a", "b", "b", "b"],), ([],)], "t array<string>")
    r = metrics.generation_diagnostics(df, "t", "b").first()
    assert (r.sequences, r.tokens, r.longest_repeated_run, r.eos_fraction) == (2, 5, 3, 0.5) and r.adjacent_repetition_fraction == 0.75


def test_registry_keeps_creation_and_last_write(spark):
    log = spark.createDataFrame([("r", "queued", 1.0, 1.0, None), ("r", "failed", 5.0, 9.0, "boom"), ("r", "running", 3.0, 4.0, None), (None, "x", 0.0, 0.0, None)], "run_id string, status string, created_at double, updated_at double, failure string")
    (r,) = runs.current(log).collect()
    assert (r.status, r.created_at, r.updated_at, r.failure) == ("failed", 1.0, 9.0, "boom")
    assert runs.current(log.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.listing(log, limit=0)


def test_sweep_order_ceiling_and_unknown_names(spark):
    base = {"a": {"b": 0}, "c": 1}
    got = runs.sweep(spark, "s", base, {"c": [1, 2], "a.b": [7, 8, 9]}).orderBy("trial").collect()
    assert [json.loads(r.parameters) for r in got][:2] == [{"a.b": 7, "c": 1}, {"a.b": 7, "c": 2}] and json.loads(got[5].config) == {"a": {"b": 9}, "c": 2}
    for grid, most in (({"x.y": [1]}, 9), ({"c": [1, 2]}, 1), ({}, 9)):
        with pytest.raises(ValueError):
            runs.sweep(spark, "s", base, grid, most)


def test_grids(spark):
    one = lambda g, f: spark.createDataFrame([(g,)], "g array<array<int>>").select(f("g")).first()[0]
    assert one([[0, 1], [2, 2]], grids.rotate90) == [[2, 0], [2, 1]]
    assert one([[1, 2, 3]], grids.mirror_y) == [[3, 2, 1]]
    assert one([[1, 1, 0], [0, 0, 0], [2, 0, 2]], grids.components) == [2, 1, 1]
    assert one([[1, 1, 1], [1, 0, 1], [1, 1, 1]], grids.filled) == [[1, 1, 1], [1, 1, 1], [1, 1, 1]]
    assert one([[3, 0, 3], [0, 0, 0]], grids.extended) == [[3, 3, 3], [0, 0, 0]]
    assert len(grids.programs(2)) == 133
    for name in ("rotate90", "rotate180", "rotate270", "mirror_x", "mirror_y"):
        g = [[1, 2, 3], [4, 5, 6]]
        assert one(g, getattr(grids, name)) == grids.STEPS[name](g)


def test_tasks(spark):
    df = spark.createDataFrame([([1, 7, 0, 8, 1, 9],)], "v array<int>")
    assert df.select(tasks.answer("selective_copy", "v")).first()[0] == [7, 9]
    df = spark.createDataFrame([([3, 30, 5, 50, 5],)], "v array<int>")
    assert df.select(tasks.answer("associative_recall", "v")).first()[0] == [50]
    for b, ok in (([24, 25], 1), ([25, 24], 0), ([24, 24, 25], 0), ([], 1)):
        assert spark.createDataFrame([(b,)], "v array<int>").select(tasks.answer("bracket_balance", "v")).first()[0] == [ok]
    a, b = (tasks.generate(spark, "sorting", 20, 6, 1).collect() for _ in range(2))
    assert a == b and all(r.answer == sorted(r.prompt) for r in a)


def test_csv_source(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text('﻿Prompt,Response,metadata,extra\n" hi ""you"" ","line\nbreak","{}",1\nq,a,,2\n', encoding="utf-8")
    r = C.read_csv(spark, str(f)).orderBy("line").collect()
    assert [(x.line, x.user, x.assistant, x.id) for x in r] == [(2, 'hi "you"', "line\nbreak", ""), (3, "q", "a", "")]
    for bad in (["user", "prompt", "assistant"], ["user"]):
        with pytest.raises(ValueError):
            C.canonical_header(bad)
    g = tmp_path / "t.csv"
    g.write_text("text\na, b, c\nplain\n")
    assert [x.cells for x in C.read_overflow_csv(spark, str(g)).orderBy("line").collect()] == [["a, b, c"], ["plain"]]


def test_streams(spark, tmp_path):
    from corpusmill.streaming import events

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a")], "n int, t string").write.json(src)
    schema = "n int, t string"
    events.append_to(events.tail(spark, src, schema), out, ck).awaitTermination(60)
    spark.createDataFrame([(2, "b")], "n int, t string").write.mode("append").json(src)
    events.append_to(events.tail(spark, src, schema), out, ck).awaitTermination(60)
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2]
    events.guard(spark, str(tmp_path / "g"), "x")
    events.guard(spark, str(tmp_path / "g"), "x")
    with pytest.raises(ValueError):
        events.guard(spark, str(tmp_path / "g"), "y")


HEAD = 'i,train,f,d,s,user,asst,t,e,'


@pytest.mark.parametrize(
    "line,reason",
    [
        (HEAD, None), (HEAD + '"{""a"": 1}"', None), ('"a ""q""\nb",,,,,u,a,,,', None), (None, "column_count"), ("", "column_count"), (HEAD + ",", "column_count"),
        ('a"b' + "," * 9, "quoting"), ('"a"b' + "," * 9, "quoting"), ('"a' + "," * 9, "quoting"), ('a, "b",,,,u,a,,,', "quoting"), (",,,,, ,a,,,", "empty_user"), (",,,,,u,\t,,,", "empty_assistant"),
        (",Holdout,,,,u,a,,,", "unknown_split"), (", DEV ,,,,u,a,,,", None), (HEAD + "[1]", "invalid_metadata"), (HEAD + '"{""a"": NaN}"', "invalid_metadata"), (HEAD + "  ", None), (HEAD + "{}", None), (",nope,,,,,,,,x", "empty_user"),
        (HEAD + '"' + "[" * 100000 + '"', "invalid_metadata"), (HEAD + '"{""a"": ' + '""' + "x" * 300000 + '""' + '}"', None),
    ],
)
def test_record_reasons(line, reason):
    fields, why = records.diagnose(line)
    assert why == reason and (fields is None) == (reason is not None)


def test_rejected_and_loaded_share_out_all_records(spark):
    raw = spark.createDataFrame([(1, HEAD, "x"), (2, "bad", "x"), (3, HEAD, None), (4, None, None)], "raw_id bigint, raw_line string, reason string")
    loaded = records.strict_load(raw)
    bad = records.rejected(raw, loaded)
    assert {r.raw_id for r in loaded.collect()} == {1, 3} and {(r.raw_id, r.reason) for r in bad.collect()} == {(2, "column_count"), (4, "column_count")}
    none = raw.where("false")
    assert records.rejected(none, records.strict_load(none)).count() == 0


def test_every_query_is_registered_with_sql_or_reason():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_missing_splits_and_bootstrap_take_the_whole(spark, tmp_path):
    from corpusmill.plans import metric_queries as Q

    rows = [(1, "train", "a"), (2, "Val", None), (3, "train", None)]
    spark.createDataFrame(rows, "row_id bigint, split string, source string").write.parquet(f"{tmp_path}/chat_examples.parquet")
    assert [r.split for r in Q.compiled_missing_splits_all(spark, str(tmp_path)).collect()] == ["test"]
    d = "/root/testdata/sf0.001"
    p = Q._pairs(spark, d).selectExpr("user_id % 2 as part", "a - b as value")
    want = Q.stats.bootstrap_interval(p, "value", "part", samples=4000, seed=7)
    assert sorted(map(tuple, Q.stats_bootstrap(spark, d).collect())) == sorted(map(tuple, want.collect()))
