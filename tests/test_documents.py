import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import bpe, corpus, grids
from corpusmill.plans import corpus_queries
from corpusmill.sources import documents as D


def test_manifests_carry_their_hash(tmp_path):
    p = tmp_path / "m.json"
    D.write_manifest(p, {"b": 1, "a": ["é", 2.5]})
    assert D.read_manifest(p) == {"b": 1, "a": ["é", 2.5]}
    p.write_text(p.read_text().replace("2.5", "2.6"))
    with pytest.raises(ValueError):
        D.read_manifest(p)
    with pytest.raises(ValueError):
        D.write_manifest(tmp_path / "n.json", {"x": float("nan")})
    assert not (tmp_path / "n.json").exists()
    assert D.all_finite({"a": [1.0, {"b": 2}]}) and not D.all_finite([{"a": float("inf")}])


@pytest.mark.parametrize("text,want", [("---\ntask: copy\nexamples: 3\n---\nbody", {"task": "copy", "examples": 3}), ("x\n```yaml\ntask: parity\n```\n", {"task": "parity"}), ("# t\n- task: reverse\n- note: prose\nexamples: 4\n", {"task": "reverse", "examples": 4})])
def test_plans(tmp_path, text, want):
    pytest.importorskip("yaml")
    p = tmp_path / "p.md"
    p.write_text(text)
    assert D.read_plan(p, {"task", "examples"}) == want
    p.write_text("---\nother: 1\n---\n")
    with pytest.raises(ValueError):
        D.read_plan(p, {"task"})
    p.write_text("nothing here")
    with pytest.raises(ValueError):
        D.read_plan(p, {"task"})


def test_reports(spark, tmp_path):
    s = {"numbers": {"a": 1}, "rows": [{"x": "<b>", "y": "p|q"}], "notes": ["one"]}
    assert "| <b> | p\\|q |" in D.report_markdown("T", s) and "&lt;b&gt;" in D.report_html("T", s)
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"run_id": "r1", "created_at": 2.0, "metrics": {"loss": 1.5}}, indent=1))
    (tmp_path / "r" / "b.json").write_text("not json")
    D.register_reports(spark, str(tmp_path / "r"), str(tmp_path / "log"))
    (r,) = spark.read.parquet(str(tmp_path / "log")).collect()
    assert (r.run_id, r.status, r.updated_at, json.loads(r.metrics_json)) == ("r1", "completed", 2.0, {"loss": 1.5})


def test_bpe_goldens(spark):
    texts = ["banana bandana", "banana", "bandana", "banana"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    merges, why = bpe.train(df, 280)
    assert merges == [(97, 110), (98, 261), (261, 97), (262, 263), (100, 263), (262, 265)] and why == "min_frequency_not_met"
    ids = {r.text: r.ids for r in bpe.encode(df, "text", merges).collect()}
    assert [len(ids[t]) for t in texts] == [3, 1, 1, 1]
    back = bpe.decode(bpe.encode(df, "text", merges), "ids", merges, "back").collect()
    assert all(r.back == r.text for r in back)
    assert bpe.load_artifact(bpe.artifact(merges)) == merges
    with pytest.raises(ValueError):
        bpe.load_artifact(bpe.artifact(merges) | {"merges": [[1, 2]]})
    with pytest.raises(ValueError):
        bpe.vocabulary([(97, 900)])


def test_bpe_in_tasks_trains_the_same(spark, monkeypatch):
    rng = random.Random(0)
    df = spark.createDataFrame([("".join(rng.choice("abc ") for _ in range(20)),) for _ in range(60)] + [("",)], "text string")
    want = bpe.train(df, 270)
    monkeypatch.setattr(bpe, "DRIVER_TEXTS", 5)
    assert bpe.train(df, 270) == want
    assert bpe.train(df.where("false"), 270) == ([], "no_pairs")


def test_bpe_in_flat_arrays_equals_the_plain_loop(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab é") for _ in range(rng.randrange(0, 40))) for _ in range(80)] + ["aaaaa", "aaaa", "aaaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line int, text string").repartition(3)
    seqs, want = [list(t.encode()) for t in texts], []
    while len(want) < 19:
        n = Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
        want.append(min(n, key=lambda p: (-n[p], p)))
        seqs = [bpe._merge(s, want[-1], bpe.FIRST + len(want) - 1) for s in seqs]
    assert bpe.train(df, bpe.FIRST + 19)[0] == want
    monkeypatch.setattr(bpe, "DRIVER_TEXTS", 5)
    assert bpe.train(df, bpe.FIRST + 19)[0] == want
    assert {r.line: r.ids for r in bpe.encode(df, "text", want).collect()} == dict(enumerate(seqs))
    monkeypatch.setattr(bpe, "BATCH_MERGES", 0)
    assert {r.line: r.ids for r in bpe.encode(df, "text", want).collect()} == dict(enumerate(seqs))


def test_bpe_queries_take_all_texts(spark):
    d = "/root/testdata/sf0.001"
    texts = [r.text for r in bpe.corpus(corpus_queries.rows_of(spark, d)).collect()]
    assert len(texts) > spark.read.parquet(f"{d}/chat_examples.parquet").count() * 2
    first = Counter(p for t in texts for p in zip(t.encode(), t.encode()[1:], strict=False))
    r = corpus_queries.bpe_merges(spark, d).orderBy("rank").first()
    assert (r.a, r.b) == min(first, key=lambda p: (-first[p], p))
    got = corpus_queries.bpe_round_trip(spark, d).collect()
    assert len(got) == len(texts) and all(r.same for r in got)


@pytest.mark.parametrize("text", ["abc", "abcabc", "aaaaa", "zabcaaabc", "", "bcbcbc"])
def test_encode_by_rank(text):
    merges = [(97, 98), (261, 99), (97, 97), (263, 97), (98, 99)]
    seq = list(text.encode())
    for i, m in enumerate(merges):
        seq = bpe._merge(seq, m, 261 + i)
    got = bpe.encode_ids(text, {m: i for i, m in enumerate(merges)})
    v = bpe.vocabulary(merges)
    assert bpe.decode_ids(got, v) == text and got == seq


def test_one_text_audit(spark):
    df = spark.createDataFrame([("repeat me",), ("repeat me ",), ("a",), ("b",), ("c",), (" ",), (None,)], "text string")
    r = corpus.audit(corpus.rendered(df, "text")).first()
    assert (r.nonempty_rows, r.duplicate_rows, r.declared_unknown) == (5, 1, 5)
    assert corpus.audit(corpus.rendered(df.where("false"), "text")).first().duplicate_rate == 0.0


def test_buffered_shuffle_loses_nothing(spark):
    got = list(corpus.buffered(iter(range(50)), 8, random.Random(1)))
    assert sorted(got) == list(range(50)) and got != list(range(50))
    df = spark.range(100)
    a, b = ([r.id for r in corpus.buffer_shuffled(df, 16, 3, e).collect()] for e in (0, 0))
    assert a == b and sorted(a) == list(range(100))


def test_generated_tasks_are_solved(spark):
    t = corpus.holdout_tasks(spark, 20, 4)
    assert grids.pass_rate(grids.search(t)).first().pass_at_1 == 1.0
    n = corpus.needle_cases(spark, 20, 16, 1).where(F.element_at("prompt", F.array_position("prompt", F.element_at("prompt", -1)).cast("int") + 1) != F.col("answer"))
    assert n.count() == 0


def test_task_stream_resumes_from_its_offset(spark, tmp_path):
    from corpusmill.operators.tasks import answer
    from corpusmill.streaming import events

    def run(most):
        s = events.task_stream(spark, task="sorting", length="5", seed="3", step="10", most=str(most)).withColumn("answer", answer("sorting", "prompt"))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(120):
                done = spark.read.schema("example bigint, task string, prompt array<int>, answer array<int>").parquet(str(tmp_path / "o")).count() if (tmp_path / "o" / "_spark_metadata").exists() else 0
                if done >= most:
                    break
                __import__("time").sleep(0.5)
        finally:
            q.stop()
        return spark.read.parquet(str(tmp_path / "o")).collect()

    assert sorted(r.example for r in run(20)) == list(range(20))
    rows = run(35)
    assert sorted(r.example for r in rows) == list(range(35)) and all(r.answer == sorted(r.prompt) for r in rows)


def test_windows_stream_as_in_batch(spark, tmp_path):
    from corpusmill.streaming import events

    rows = spark.sql("select timestamp_seconds(1700000000 + id * 97) as ts, id % 3 as k, cast(id as double) as v from range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.windowed(stream, "ts", "v", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = events.windowed(rows, "ts", "v", "k")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
