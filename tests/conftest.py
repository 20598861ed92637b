import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import build_session

    s = build_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def chat(spark):
    """Makes chat_examples from (row_id, split, user, assistant[, more columns as a dict])."""

    def make(rows, **extra):
        cols = ["id", "split", "task_family", "difficulty", "system_text", "user_text", "assistant_text", "answer_format", "eval_type", "metadata_json", "source", "lang"]
        schema = "row_id bigint, " + ", ".join(f"{c} string" for c in cols) + "".join(f", {k} string" for k in extra)
        out = []
        for r in rows:
            more = r[4] if len(r) > 4 else {}
            d = {"split": r[1], "user_text": r[2], "assistant_text": r[3]} | more
            out.append((r[0], *[d.get(c) for c in cols], *extra.values()))
        return spark.createDataFrame(out, schema)

    return make
