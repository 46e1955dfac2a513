"""A training corpus in five stages, from documents to token files.

Every stage takes what its predecessor kept, as a written table. The scratch tables
of a stage are removed when the next one begins: its rows stand by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.decontaminate import decontaminate
from packetloom.llm.mixing import mixed_documents
from packetloom.llm.near_texts import keep_one_similar
from packetloom.llm.quality_rules import keep_good
from packetloom.llm.queries import END_ID, tokenizer_path
from packetloom.llm.token_files import read_token_files, write_token_files
from packetloom.session import recorded_scratch, remove_scratch, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: scratch paths of the stage before, by application
_LEFT: dict[str, list[str]] = {}


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        remove_scratch(spark, _LEFT.pop(application, []))
        with recorded_scratch() as paths:
            out = function(spark, docs, sf_dir)
        _LEFT[application] = paths
        return out

    return staged


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word Jaccard of 0.8 or more."""
    return keep_one_similar(docs)


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weights, repeated as the mix demands."""
    return mixed_documents(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token files, read back from them."""
    files = write_token_files(docs, tokenizer_path(), END_ID, scratch_path(spark, "token-files"))
    return read_token_files(spark, files, keep_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokens),
]

#: SQL has no counterpart for the robust estimates, links and token ids; the
#: stages are tested against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and reread, and
    removed when the next stage's stand."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove_scratch(spark, before)
        before = [path]
    return docs
