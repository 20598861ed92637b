"""Structured Streaming: event tails, resumable batches, windows and generated streams."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators.tasks import draw_input


def tail(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream over JSON-lines event logs, new files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def windowed(events: DataFrame, at: str, value: str, *by: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts and sums by tumbling window; events more than `late` behind are dropped and state is bounded by it."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, *by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by session: events of a key that lie less than `gap` apart."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, appended to Parquet exactly once; run it again to go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def guard(spark: SparkSession, path: str, fingerprint: str) -> None:
    """Refuses to go on from a state that another configuration or source wrote; notes the fingerprint the first time."""
    try:
        old = spark.read.text(path).first()
    except Exception:  # no such path yet
        old = None
    if old is None:
        spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.text(path)
    elif old.value != fingerprint:
        raise ValueError("the saved state belongs to another configuration or source")


class _Tasks(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.task, self.length, self.seed, self.step, self.most = options.get("task", "copy"), int(options.get("length", 8)), options.get("seed", "0"), int(options.get("step", 100)), int(options.get("most", 1000))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def _rows(self, a: int, b: int) -> Iterator[tuple]:
        return iter([(i, self.task, draw_input(self.task, self.length, random.Random(f"{self.seed}:{self.task}:{i}"))) for i in range(a, b)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        a = start["next"]
        b = min(a + self.step, self.most)
        return self._rows(a, b), {"next": b}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["next"], end["next"])

    def commit(self, end: dict) -> None:
        pass


class TaskStream(DataSource):
    """`task_stream`: an endless stream of seeded examples; its offset is the next example, so it resumes exactly."""

    @classmethod
    def name(cls) -> str:
        return "task_stream"

    def schema(self) -> str:
        return "example bigint, task string, prompt array<int>"

    def simpleStreamReader(self, schema) -> _Tasks:
        return _Tasks(dict(self.options))


def task_stream(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(TaskStream)
    return spark.readStream.format("task_stream").options(**options).load()
