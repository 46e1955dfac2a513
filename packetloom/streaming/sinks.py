"""Where streams end."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.session import remove_scratch, scratch_path


def on_batch(
    stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
):
    """A writer that hands every micro-batch to ``fn``; start it yourself.

    After a failure the last batch comes again under the same number, so
    ``fn`` must replace, not add, what it wrote for that number.
    """
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(fn)
    )


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A repeatable batch function: one folder per batch number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def alert_table(alerts: DataFrame, path: str, checkpoint: str):
    """A writer that appends alerts to a Parquet table; readers take the newest
    rows from it."""
    return (
        alerts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def write_by_day(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Store rows by day (``day``). The days they hold are replaced, so a repeated run
    changes nothing; rows without a time stay together in a folder of their own."""
    out = rows.withColumn("day", F.to_date(ts)).repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: date | None = None) -> DataFrame:
    """The stored rows from day ``first`` on; folders of other days are not opened."""
    rows = spark.read.parquet(path)
    return rows if first is None else rows.filter(F.col("day") >= F.lit(first))


def drop_days(spark: SparkSession, path: str, before: date) -> list[str]:
    """Delete the folders of days before ``before`` and return their days.

    No row is read or written anew: the work follows the number of days. Days that
    are gone already, and rows without a time, are passed over.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [f.getPath().getName() for f in files]
    days = sorted(n.removeprefix("day=") for n in names if n.startswith("day=2") or n.startswith("day=1"))
    gone = [d for d in days if d < before.isoformat()]
    remove_scratch(spark, [f"{path}/day={d}" for d in gone])
    return gone


def finish(query: StreamingQuery) -> None:
    """Wait for the end of a query that stops by itself."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def drain(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Process what is there now and return it as a table."""
    path = scratch_path(spark, name)
    writer = alert_table(stream, f"{path}/rows", f"{path}/checkpoint")
    finish(writer.trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drain_totals(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Process what is there now; the last complete result as a table."""
    path = scratch_path(spark, name)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    writer = on_batch(stream, replace, f"{path}/checkpoint", mode="complete")
    finish(writer.trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
