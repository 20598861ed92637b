"""Rules that must hold as they are defined elsewhere: columns, envelopes, keys, checks, order of programs, streams, manifests."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.operators import audit, batches, bpe, compiled, corpus, dedup, grids, metrics, tasks, validate
from corpusmill.sources import conversations as C
from corpusmill.sources import documents as D

CONV = "line bigint, id string, split string, task_family string, difficulty string, system string, user string, assistant string, answer_format string, eval_type string, metadata_json string"


def conv(spark, items):
    """(line, id, split, system, user, assistant, metadata)"""
    return spark.createDataFrame([(n, i, s, "", "", sy, u, a, "", "", m) for n, i, s, sy, u, a, m in items], CONV)


@pytest.mark.parametrize(
    "header,text,target,want",
    [
        (["x", "Text", "label"], None, None, ("Text", None)), (["x"], None, None, ("x", None)), (["sample", "content"], None, None, ("content", None)),
        (["id", "Question", "Answer"], None, None, ("Question", "Answer")), (["system", "user", "assistant"], None, None, ("user", "assistant")),
        (["prompt", "user", "target", "response"], None, None, ("user", "response")), (["source", "other"], None, None, ("source", None)), (["text", "target"], None, None, ("text", "target")),
        (["user", "assistant"], "text", None, ("user", "assistant")), (["user", "assistant", "note"], "note", None, ("note", None)), (["user", "assistant", "n"], None, "n", ("user", "n")),
    ],
)
def test_columns_of_the_older_formats(header, text, target, want):
    assert C.detect_columns(header, text, target) == want


def test_unknown_columns_are_errors():
    for header, text, target in ((["user", "assistant"], "texts", None), (["a", "b"], "text", None), (["a"], None, "b")):
        with pytest.raises(ValueError):
            C.detect_columns(header, text, target)


def test_headers_and_overflow_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\ufeff text \na, b,, c\nplain\n", encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text('text,n\n"q, r",1\n')
    assert C.sniff_header(spark, str(tmp_path / "in" / "a.csv")) == ["text"]
    with pytest.raises(ValueError):
        (tmp_path / "e.csv").write_text("")
        C.sniff_header(spark, str(tmp_path / "e.csv"))
    want = [["a, b, c"], ["plain"], ["q, r", "1"]]
    for path in (f"{tmp_path}/in/*.csv", f"file://{tmp_path}/in", f"{tmp_path}/in"):
        assert sorted(x.cells for x in C.read_overflow_csv(spark, path).collect()) == want


def test_envelopes(spark):
    df = spark.createDataFrame([("", "be brief", " hi ", "yes"), (None, None, "", "only"), ("s", "t", "u", None), ("s", "t", "", " ")], "System string, developer string, question string, answer string")
    got = [r.rendered for r in corpus.rendered(df, "question", "answer").collect()]
    assert got == ["SYSTEM:\nbe brief\n\nUSER:\nhi\n\nASSISTANT:\nyes", "ASSISTANT:\nonly", "SYSTEM:\ns\n\nUSER:\nu", "SYSTEM:\ns"]
    assert [r.rendered for r in corpus.rendered(df.where("question <> ''"), "question", "System").collect()] == ["hi", "u\ns"]


def test_group_keys_by_type(spark):
    metas = ['{"group_id": " g 1 "}', '{"group_id": 1.5, "source_id": 7}', '{"group_id": 1.0}', '{"group_id": true}', '{"group_id": [1], "parent_id": "p"}', '{"group_id": " "}', '{"group_id": {"a": 1}}', '{"group_id": -3}', '{"group_id": null}', "", '{"source_id": 123456789012345678901234}']
    r = conv(spark, [(i, f"i{i}", "", "", "u", "a", m) for i, m in enumerate(metas)]).withColumn("k", validate.group_key(F.lit("h")))
    want = ["metadata:group_id: g 1 ", "metadata:source_id:7", "id:i2", "metadata:group_id:True", "metadata:parent_id:p", "id:i5", "id:i6", "metadata:group_id:-3", "id:i8", "id:i9", "metadata:source_id:123456789012345678901234"]
    assert [x.k for x in r.orderBy("line").collect()] == want


@pytest.mark.parametrize("system,user,assistant,meta,message", [("", "", "a", "", "user field is empty"), ("", "u", "", "", "assistant field is empty"), ("s" * 11, "u", "a", "", "system exceeds"), ("", "u", "a" * 11, "", "assistant exceeds"), ("", "u", "a", "[1]", "invalid metadata"), ("", "", "a", "{", "invalid metadata")])
def test_rows_that_fail_fast(spark, system, user, assistant, meta, message):
    with pytest.raises(Exception, match=f"line 7: {message}"):
        C.fail_fast(conv(spark, [(7, "", "", system, user, assistant, meta)]), 10).collect()
    assert C.fail_fast(conv(spark, [(7, "", "", "s" * 10, "u", "a", "{}")]), 10).count() == 1


def test_texts_are_not_shuffled_by_id(spark):
    rows = conv(spark, [(i, "same" if i % 3 else f"i{i}", "", "", "u", "a", "") for i in range(60)] + [(99, "", "", "", "", "", "")])
    got = {r.line: r.reasons for r in validate.with_reasons(rows).collect()}
    assert sum("duplicate_id" in x for x in got.values()) == 39 and got[1] == [] and got[99] == ["empty_user", "empty_assistant"]
    plan = validate.with_reasons(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "BroadcastHashJoin" in plan


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_hot_buckets_as_grids_lose_nothing(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = spark.createDataFrame([(i, " ".join(words[: 20 + rng.randrange(10)] + [f"x{rng.randrange(6)}"])) for i in range(150)] + [(500, None), (501, "")], "line bigint, t string")
    near = lambda: {tuple(r) for r in dedup.near_duplicates(rows, 3, "sha256", "lower", F.col("t")).select("line", "exact_of", "near_of").collect()}
    want = near()
    monkeypatch.setattr(dedup, "BUCKET_BLOCK", 3)
    assert near() == want and sum(n is not None for _, _, n in want) > 20
    fps = {r.line: r.fp for r in dedup.near_duplicates(rows, 3, "sha256", "lower", F.col("t")).where("exact_of is null").collect()}
    brute = {a: min((b for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 3), default=None) for a in fps}
    assert {a: n for a, e, n in want if e is None} == brute


def test_telemetry_of_a_hot_run(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b", None]), i, rng.randrange(9), rng.choice([None, 0.5, 1.0]), rng.choice([None, 1.0, 2.0, 0.25])) for i in range(300)]
    got = {r.step: (r.total_tokens, r.total_seconds, r.best_loss) for r in metrics.telemetry(spark.createDataFrame(rows, "run string, step int, n long, s double, loss double"), "run", ["step"], "n", "s", "loss").collect()}
    state = {}
    for run, step, n, s, loss in rows:
        t, u, b = state.get(run, (0, None, None))
        state[run] = (t + n, u if s is None else (u or 0) + s, loss if b is None else b if loss is None else min(b, loss))
        assert got[step] == state[run]


def test_entropy_and_padding(spark):
    s = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 100.0), (2, 1, -100.0)], "k long, token int, score double")
    r = metrics.router_entropy(s, "k").first()
    assert r.rows == 2 and abs(r.router_entropy - 0.34657359) < 1e-6
    b = spark.createDataFrame([(1, 3, 5), (1, 5, 5)], "batch int, n int, w int")
    assert metrics.padding_fraction(b, F.col("n"), F.col("w"), "batch").first().padding_fraction == pytest.approx(0.2)
    assert metrics.router_entropy(s.where("false"), "k").first().rows == 0


def test_order_of_programs(spark):
    names = ["rotate90", "rotate180", "rotate270", "mirror_x", "mirror_y", "crop_nonzero", "pad", "extend_line", "fill_enclosed", "scale_object", "tile_pattern"]
    assert list(grids.STEPS) == names and grids.programs(1) == [(), *((n,) for n in names)]
    pair = "array<struct<input:array<array<int>>,output:array<array<int>>>>"
    line = [[3, 0, 3], [0, 0, 0], [0, 0, 0]]
    cases = [
        (1, [{"input": [[1]], "output": [[1]]}], [], "identity"),
        (2, [{"input": [[1, 1]], "output": [[1, 1], [1, 1]]}], [], None),
        (3, [{"input": line, "output": [[3, 3, 3], [0, 0, 0], [0, 0, 0]]}], [{"input": line, "output": None}], "extend_line"),
        (4, [{"input": [[5]], "output": [[5, 5], [5, 5]]}], [{"input": [[1, 2]], "output": None}], "scale_object"),  # tile_pattern solves it as well
        (5, [{"input": [], "output": [[1]]}], [], None), (6, [{"input": [[1]], "output": None}], [], None),
    ]
    got = {r.task_id: r for r in grids.search(spark.createDataFrame([c[:3] for c in cases], f"task_id long, train {pair}, test {pair}")).collect()}
    assert {k: r.program for k, r in got.items() if k != 2} == {c[0]: c[3] for c in cases if c[0] != 2}
    assert got[4].predictions == [[[1, 1, 2, 2], [1, 1, 2, 2]]] and got[3].predictions == [[[3, 3, 3], [0, 0, 0], [0, 0, 0]]] and got[5].tested == 133
    t = corpus.holdout_tasks(spark, 10, 3)
    r = grids.search(t).join(t.select("task_id", "rule", F.get("test", F.lit(0))["output"].alias("want")), "task_id").collect()
    assert all(x.solved and (x.program != x.rule or x.predictions == [x.want]) for x in r)


def test_placeholders_of_grids(spark):
    df = spark.createDataFrame([([[1, 2]], [[1, 2]]), ([[1, 2]], [[0, 2]])], "a array<array<int>>, b array<array<int>>")
    assert [tuple(r) for r in df.select(grids.union("a", "b"), grids.intersection("a", "b")).collect()] == [([[1, 2]], [[1, 2]]), ([[1, 2]], [[0, 0]])]


def test_collated_examples(spark):
    e = spark.createDataFrame([(1, [7, 8], [9]), (2, [7], [8]), (3, [5], [])], "example long, prompt array<int>, answer array<int>")
    got = {r.example: (r.input_ids, r.labels, r.attention_mask) for r in tasks.collated(e, 3, 2).collect()}
    assert got == {1: ([7, 8, 9], [-100, -100, 9], [True] * 3), 2: ([7, 8, 0], [-100, 8, -100], [True, True, False]), 3: ([5], [-100], [True])}
    with pytest.raises(Exception, match="requires 3 positions of 2"):
        tasks.collated(e, 2, 2).collect()


def simulate(split_of, split, size, repeat, drop_last, n):
    """The next n batches, one row at a time."""
    lines = [i for i, s in enumerate(split_of) if s == split]
    out, epoch, at = [], 0, 0
    for b in range(n):
        rows = []
        while len(rows) < size:
            if at == len(lines):
                if not repeat:
                    break
                epoch, at = epoch + 1, 0
            rows.append((b, len(rows), epoch, lines[at]))
            at += 1
        if not rows or (drop_last and len(rows) < size):
            break
        out += rows
    return out


@pytest.mark.parametrize("repeat,drop_last", [(True, False), (False, False), (False, True)])
def test_batches_resume_exactly(spark, repeat, drop_last):
    rng = random.Random(3)
    split_of = [rng.choice(["train", "val", None]) for _ in range(40)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(split_of)], "line bigint, assigned_split string")
    make = lambda: batches.Batches(rows, "val", 4, "src", repeat=repeat, drop_last=drop_last, max_length=8)
    want = simulate(split_of, "val", 4, repeat, drop_last, 9)
    take = lambda b, n: [(r.batch, r.slot, r.epoch, r.line) for r in b.take(n).orderBy("batch", "slot").collect()]
    one, two, whole = make(), make(), make()
    head = take(one, 2)
    two.load(one.saved())
    assert head + take(two, 7) == want == take(whole, 9)
    assert two.state == whole.state and whole.state.examples_emitted == len(want)
    if not repeat:
        assert take(two, 3) == []


def test_states_of_other_streams_are_refused(spark):
    rows = spark.createDataFrame([(i, "val") for i in range(5)], "line bigint, assigned_split string")
    b = batches.Batches(rows, "val", 2, "src")
    b.take(1)
    good = b.saved()
    for change in ({"source_sha256": "x"}, {"batch_size": 3}, {"format_version": 4}, {"repeat": False}, {"state": {"epoch": -1}}, {"state": {"more": 1}}, {"state": None}):
        with pytest.raises(ValueError):
            b.load(good | change)
    b.load({k: v for k, v in good.items() if k not in ("repeat", "drop_last")} | {"format_version": 1})
    assert b.state.examples_emitted == 2
    with pytest.raises(RuntimeError, match="no rows for split"):
        batches.Batches(rows, "test", 2, "src").take(1)
    with pytest.raises(RuntimeError, match="no readable rows"):
        batches.Batches(rows.where("false"), "test", 2, "src").take(1)


def test_manifests(spark, tmp_path):
    good = audit.with_split(conv(spark, [(i, f"i{i}", "", "", f"u{i}", "yes", "") for i in range(2, 42)]))
    src = tmp_path / "source.csv"
    src.write_text("user,assistant\n")
    m = compiled.write_compiled(good, f"{tmp_path}/c", source=str(src), audit={"accepted_rows": 40, "rejected_rows": 0})
    assert compiled.verify(spark, f"{tmp_path}/c") == [] and sum(s["examples"] for s in m["splits"].values()) == 40
    rows = spark.read.parquet(f"{tmp_path}/c/shards").collect()
    for s in m["splits"]:
        assert sorted(r.pos for r in rows if r.split == s) == list(range(m["splits"][s]["examples"]))
        assert [r.line for r in sorted((r for r in rows if r.split == s), key=lambda r: r.pos)] == sorted(r.line for r in rows if r.split == s)
    src.write_text("user,assistant\nq,a\n")
    assert compiled.verify(spark, f"{tmp_path}/c") == ["source digest"]
    for change in ({"format": 9}, {"max_length": 1}, {"splits": {}}, {"source_sha256": "x"}, {"audit": {"accepted_rows": 39}}, {"audit": {"accepted_rows": 40, "rejected_rows": 1}}, {"splits": m["splits"] | {"train": m["splits"]["train"] | {"examples": 0}}}, {"splits": m["splits"] | {"val": m["splits"]["val"] | {"input_tokens": -1}}}, {"splits": m["splits"] | {"val": m["splits"]["test"]}}):
        with pytest.raises(ValueError):
            compiled.check_manifest(m | change)


def test_reports():
    gate = {"name": "g", "status": "pass", "explanation": "a | b", "observed": 1.0}
    r = {"identity": {"run_id": "r1", "command": ["x", "y"], "config_hash": "h"}, "limitations": ["small"], "metrics": {"loss": 1.5}, "gates": [gate], "decision": "keep"}
    text = D.report_markdown(*D.research_sections(r))
    assert "# Research report r1" in text and "a \\| b" in text and "- small" in text and '{"loss":1.5}' in text
    for change in ({"limitations": []}, {"metrics": {}}, {"gates": []}, {"metrics": {"a": [float("nan")]}}, {"gates": [gate | {"status": "fail"}]}, {"gates": [gate | {"explanation": " "}]}, {"schema_version": "0"}, {"identity": None}):
        with pytest.raises(ValueError):
            D.check_report(r | change)
    assert "- Seed: 3" in D.report_markdown(*D.old_sections({"name": "n", "seed": 3, "unknown": 1})) and "<script>" not in D.report_html(*D.old_sections({"name": "<script>"}))


def test_training_reports(spark):
    t = spark.createDataFrame([("banana bandana",), ("banana",)], "text string")
    merges, why = bpe.train(t, bpe.FIRST + 3)
    r = bpe.training_report(merges, why, {"vocab_size": bpe.FIRST + 3}, t)
    assert r["summary"]["merges"] == 3 and r["summary"]["training_bytes"] == 20 and r["summary"]["sha256"] == bpe.artifact(merges)["sha256"]
