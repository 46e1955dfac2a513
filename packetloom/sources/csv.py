"""Flow tables as CSV."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.features import strip_headers
from packetloom.operators.ordering import sample_n


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (error.getCondition() or "")


def read_flows_csv(
    spark: SparkSession, path: str, sample_size: int = 0, seed: int = 42
) -> DataFrame:
    """All columns as text, header blanks removed. ``sample_size`` takes that
    many rows (0: all), chosen by a hash of the row.

    Splitting the input is Spark's business (``spark.sql.files.maxPartitionBytes``).
    Files of one folder must share the header of the first.
    """
    try:
        raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"CSV not found: {path}") from error
        raise
    if not raw.columns:
        raise ValueError(f"CSV is empty or has no header row: {path}")
    rows = strip_headers(raw)
    if not sample_size:
        return rows
    named = rows.withColumn("_row", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    return sample_n(named, "_row", sample_size, seed).drop("_row")


def write_flows_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A flat table as CSV with header."""
    df.write.mode(mode).csv(path, header=True)


def text_schema(spark: SparkSession, path: str) -> T.StructType:
    """The header of existing files as a schema of text columns."""
    names = read_flows_csv(spark, path).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_flow_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """New CSV files of a folder as a stream of text rows.

    Without a schema the header of a file already present is taken. Spark fills
    columns by position; every file's header is compared with the schema, and a
    file with other columns, or another order, fails the query.
    """
    schema = schema or text_schema(spark, path)
    reader = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(path)


def arrived_since(stream: DataFrame, start: datetime) -> DataFrame:
    """Rows of files written at or after ``start`` only."""
    return stream.filter(F.col("_metadata.file_modification_time") >= F.lit(start))
