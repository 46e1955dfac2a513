"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import line_crf
from packetloom.llm.chat_tools import CALLS, link_calls
from packetloom.llm.collocations import collocations
from packetloom.llm.conversation_repair import repair
from packetloom.llm.decontaminate import mark_windows, n_hit
from packetloom.llm.embedding_dedup import near_vectors
from packetloom.llm.licenses import scan_licenses
from packetloom.llm.line_dedup import with_removed_lines
from packetloom.llm.mixing import mix, word_count
from packetloom.llm.pii import BASE_KINDS, with_pii
from packetloom.llm.quality_rules import judge
from packetloom.llm.simhash import cluster
from packetloom.llm.sql import SQL
from packetloom.llm.token_files import read_token_files, write_token_files
from packetloom.session import scratch_path

__all__ = ["QUERIES", "SQL"]

WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def tokenizer_path() -> str:
    """The tokenizer of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(WORD_TOKENIZER)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    return scan_licenses(_texts(spark, sf_dir)).select(
        "row.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        "labels",
        "score",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, a digest of the base spans, all spans."""

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(keep):
        one = F.transform(
            F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
        )
        return F.array_join(one, ",")

    return with_pii(_texts(spark, sf_dir)).select(
        "row.doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(lambda s: s["kind"].isin(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(lambda s: F.lit(True)).alias("spans"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids, written in ranked variable-length blocks and
    read back."""
    path = scratch_path(spark, "token-files")
    files = write_token_files(_texts(spark, sf_dir), tokenizer_path(), END_ID, path)
    return read_token_files(spark, files, keep_ids=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    marked = mark_windows(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return marked.select(
        "row.doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from the marginals of a line model."""
    docs = _texts(spark, sf_dir)
    model = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    scored = line_crf.score(docs, model)
    return scored.select(
        "row.doc_id",
        (line_crf.fold_of(F.col("row.doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash."""
    return cluster(_texts(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights 1, 2, 3."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("h")
    )
    mixed = mix(docs, F.col("n"), F.array("source"), ["doc_id", "h"])
    credit = F.col("credit")[0]
    return mixed.select(
        "row.doc_id",
        "size",
        credit["source_size"].alias("source_size"),
        credit["target"].alias("target"),
        F.col("taken").cast("long").alias("taken"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed quality rules and robust outliers per language and source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # the written rows need no text
    return judge(docs, keep=("doc_id", "lang", "source")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line but for two edits."""
    # the rows need no text once its lines are hashed
    return with_removed_lines(_texts(spark, sf_dir), keep=("doc_id",)).select(
        "row.doc_id", F.size("removed").cast("long").alias("n_removed"), "n_links", "removed"
    )


REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "words"],
    "additionalProperties": False,
    "properties": {
        "prompt": {"type": "string", "minLength": 1},
        "words": {"type": "integer", "minimum": 1, "maximum": 60},
    },
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """Tool calls derived from plain conversations: every user turn calls
    ``reply`` from the call two turns before, and the turn after it answers."""

    def name_of(turn):
        return F.concat(F.lit("call-"), turn.cast("string"))

    turn, user = F.col("turn"), F.col("role") == "user"
    arguments = F.to_json(
        F.struct(word_count(F.col("text")).alias("words"), F.col("text").alias("prompt"))
    )
    call = F.struct(
        name_of(turn).alias("id"),
        F.lit("reply").alias("name"),
        arguments.alias("arguments"),
        F.when(turn >= 2, name_of(turn - 2)).alias("parent"),
    )
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(user, F.array(call)).cast(CALLS).alias("calls"),
        F.when(F.col("role") == "assistant", name_of(turn - 1)).alias("result_of"),
    )


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with linked, checked and ordered calls as canonical JSON."""
    messages = with_calls(_table(spark, sf_dir, "conversations"))
    return link_calls(messages, {"reply": REPLY_SCHEMA})


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row,
    1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the
    user's. NULLs are one space."""
    one = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat_ws(":", conv, turn)) % 20
    text = F.coalesce(F.col("text"), one)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), one))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return conversations.filter(kind != 0).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and cheapest repairs."""
    turns = _table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label within a cosine of 0.93, as links, classes and survivors."""
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_pii,
        op3_token_files,
        op4_decontaminate,
        op5_line_quality,
        op6_simhash,
        op7_mixing,
        op8_quality_rules,
        op9_line_dedup,
        op10_tool_calls,
        op11_conversation_repair,
        op12_embedding_dedup,
        op13_collocations,
    )
}
