"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "packetloom", **conf: str) -> SparkSession:
    """A small local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # 30 features make long generated methods; beyond this size the JVM
        # would interpret them, so Spark shall split them instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_RECORDS: list[list[str]] = []


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """The scratch paths that are given out inside the block."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not paths]


def remove_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that no later step reads, in whatever store they lie."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Without the
    setting a session on one machine gets a temporary folder; on a cluster no
    folder could be guessed that all executors see, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="packetloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = os.path.join(root, "packetloom", f"{name}-{uuid.uuid4().hex}")
    for record in _RECORDS:
        record.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder.

    Used where several jobs pass over the same costly rows: a lost executor
    then costs a re-read, not the whole plan before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
