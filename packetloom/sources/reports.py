"""Reports as JSON rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def report_path(folder: str, when: datetime | None = None) -> str:
    """A time-stamped place for one report."""
    when = when or datetime.now(timezone.utc)
    return f"{folder}/flow-performance-{when:%Y-%m-%d_%H-%M-%S}.json"


def write_report(report: DataFrame, path: str, output_format: str = "json") -> str:
    """Save a one-row report; JSON is the only format."""
    if output_format != "json":
        raise ValueError(f"unsupported report format: {output_format}")
    report.coalesce(1).write.mode("errorifexists").json(path)
    return path


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All reports of a folder."""
    return spark.read.option("recursiveFileLookup", True).json(folder)
