"""Session helpers: configuration, table loading and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "corpusmill") -> SparkSession:
    """A session with AQE and UTC time; on a cluster the submitter's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: A single file of this size is read by one task or two, since its rows are few row groups.
ONE_FILE = range(1 << 20, 128 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, a folder of files or a single one.

    A folder's files are spread over tasks as they are. A single file of some MB would occupy one task with all that
    follows, so its rows are dealt out over the cores; nothing larger ever is.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    if status.isFile() and status.getLen() in ONE_FILE and spark.sparkContext.defaultParallelism > 2:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: the context's checkpoint folder or spark.checkpoint.dir.

    Only on a local master, where one machine is all there is, a temporary folder is made if none is set; on a cluster
    that is an error, as executors would write to disks of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="corpusmill-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read the columns they use, know its size and have no lineage.

    Files there survive the loss of any executor.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def data_root() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
