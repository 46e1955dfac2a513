"""Token ids in files: frequency-ranked, byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0: the most frequent). A block
holds the ranks of consecutive documents as two byte strings: ``control`` has two
bits per id, four ids a byte, giving its length of 1 to 4 bytes; ``data`` has the
low bytes of the ranks. So control bytes can be decoded by a table lookup.

A data set is a folder with ``blocks`` (in ascending ``doc_id``), ``vocabulary``
(rank and id) and ``documents`` (where each document lies). Spark writes all
three: its commit protocol keeps them whole when executors are lost, and they
can lie in any store that Spark reads.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.session import scratch_path

#: ids of one block at most, but for longer documents
BLOCK_IDS = 1 << 18
#: stems that an encoder remembers, twice over (some 200 bytes each)
_CACHED_STEMS = 250_000
_LONGEST_WORD = 64
#: bytes of text that are encoded at once, but for longer documents
_CHUNK = 1 << 22
#: these follow a word of letters as one piece; no apostrophe, which may begin a suffix
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class CachedEncoder:
    """Ids of texts as little-endian 16- or 32-bit integers.

    Sound for tokenizers that drop white space, fold case, cut words of letters
    from all other characters and mark the ends of words by ``</w>``: pieces
    between blanks are then independent, so each is encoded once and remembered.
    Letters and the marks behind them are two pieces, and an ASCII piece is that of
    its lower case, unless it holds an added token in any case: these are matched
    before case is folded. Only such stems and marks are kept.

    A column is cut into pieces, and the ids put together, by Arrow; Python sees
    the different pieces of a chunk alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # for words that are lower-case ASCII letters: nothing to normalise or to cut
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.lower() for t in added]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _each(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _together(self, words: list[str], plain: bool) -> list[bytes]:
        """Words of letters, encoded as one text and cut at the ends of words."""
        tokenizer = self.plain if plain else self.tokenizer
        whole = tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(whole[0].ids, dtype=self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        raw, at = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _learn(self, new: set[str]) -> None:
        known, older = self.known, self.older
        again = {w for w in new if w in older}
        known.update((w, older[w]) for w in again)
        missing = new - again
        words, plain, others = [], [], []
        for w in missing:
            kind = others if not w.isalpha() else plain if w.isascii() and w.islower() else words
            kind.append(w)
        for kind in (words, plain):
            for i in range(0, len(kind), 1000):
                part = kind[i : i + 1000]
                known.update(zip(part, self._together(part, kind is plain)))
        if others:
            known.update(zip(others, self._each(others)))

    def _ids(self, stems: list[str]) -> list[bytes]:
        if len(self.known) > _CACHED_STEMS:  # what is in use comes back from older
            self.known, self.older = {"": b""}, self.known
        known = self.known
        found = list(map(known.get, stems))
        new = {stems[i] for i, ids in enumerate(found) if ids is None}
        if new:
            self._learn(new)
            found = [known[s] if ids is None else ids for s, ids in zip(stems, found)]
            for word in new:
                if len(word) > _LONGEST_WORD:  # rare and large: not kept
                    del known[word]
        return found

    def _looked_up(self, column: pa.Array) -> pa.Array:
        each = column.dictionary_encode()
        # to_numpy makes the strings in one pass, to_pylist a scalar first for each
        stems = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        return pa.array(self._ids(stems), pa.large_binary()).take(each.indices)

    def _piece_ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces, each as its stem, folded where that is sound, and
        the marks behind it."""
        special = pa.array(np.zeros(len(pieces), dtype=bool))
        for token in self.added:
            special = pc.or_(special, pc.match_substring(pieces, token, ignore_case=True))
        cut = pc.ascii_rtrim(pieces, _MARKS)
        letters = pc.and_not(pc.utf8_is_alpha(cut), special)
        stems = pc.if_else(letters, cut, pieces)
        folded = pc.and_not(pc.string_is_ascii(stems), special)
        ids = self._looked_up(pc.if_else(folded, pc.ascii_lower(stems), stems))
        # marks are ASCII: as many characters as bytes
        sizes = pc.binary_length(pieces).to_numpy() - pc.binary_length(stems).to_numpy()
        marked = np.flatnonzero(sizes)
        if not len(marked):
            return ids
        ends = pieces.take(pa.array(marked)).to_numpy(zero_copy_only=False).tolist()
        marks = pa.array([p[-n:] for p, n in zip(ends, sizes[marked].tolist())], pa.string())
        at = np.zeros(len(pieces), dtype=np.int32)
        at[marked] = 1 + np.arange(len(marked), dtype=np.int32)
        behind = pa.concat_arrays([pa.array([b""], pa.large_binary()), self._looked_up(marks)])
        return pc.binary_join_element_wise(ids, behind.take(pa.array(at)), pa.scalar(b"", pa.large_binary()))

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of every text of a string column, with ``end`` behind them."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        found = pa.concat_arrays([self._piece_ids(coded.dictionary), pa.array([end], pa.large_binary())])
        bounds = pieces.offsets.to_numpy()
        bounds = bounds - bounds[0]
        at = np.insert(coded.indices.to_numpy(), bounds[1:], len(found) - 1)
        ids = found.take(pa.array(at))
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[bounds + np.arange(len(bounds))]
        return pa.Array.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2]]
        ).cast(pa.binary())

    def forget(self) -> None:
        """Drop what was learnt: an idle worker shall not hold it while others work."""
        self.known, self.older = {"": b""}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()


def _worker_encoder(path: str) -> CachedEncoder:
    """The encoder of this worker process, which Spark uses for many tasks. Functions
    travel by value, so it is kept under a module name of its own."""
    kept = sys.modules.setdefault("packetloom_worker", types.ModuleType("packetloom_worker"))
    if getattr(kept, "encoder_path", None) != path:
        kept.encoder, kept.encoder_path = CachedEncoder(path), path
    return kept.encoder


def _text_groups(texts: pa.Array, limit: int = _CHUNK):
    """Slices of about ``limit`` bytes of text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield texts.slice(begin, end - begin)
        begin = end


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` (packed integers, ``end_id`` last) of every row.

    ``tokenizer`` is the path of a tokenizer file. A NULL text is empty; its only
    id is ``end_id``.
    """

    def encode(batches):
        encoder = _worker_encoder(tokenizer)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        for batch in batches:
            begin = 0
            for texts in _text_groups(batch.column(1).fill_null("")):
                ids = encoder.encode_column(texts, end)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(ids)), ids], ["doc_id", "ids"]
                )
                begin += len(ids)
        encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """``id`` and ``n`` over all packed ids; each task sums its own first."""
    kind = f"<u{width}"

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), dtype=kind))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    parts = tokens.select("ids").mapInArrow(count, "id long, n long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


# --- coding -----------------------------------------------------------------

_SHIFTS = np.array([0, 2, 4, 6], dtype=np.uint8)
#: byte lengths of the four ids of each control byte
_LENGTHS = ((np.arange(256)[:, None] >> _SHIFTS) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative 32-bit numbers."""
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = codes
    control = (padded.reshape(-1, 4) << _SHIFTS).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= codes[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[used]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a block."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    begins = ends - lengths
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[begins].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[begins[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class TokenFiles:
    """The folder of a written data set."""

    path: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vocabulary")


_BLOCK = (
    "part int, first long, n_ids long, doc_ids array<long>, sizes array<long>, "
    "control binary, data binary"
)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, path: str, partitions: int | None = None
) -> TokenFiles:
    """Encode all documents and write them in ascending ``doc_id`` (NULL first).

    Rows of one ``doc_id`` are ordered by their ids' bytes. Texts are encoded
    once; the packed ids are kept beside the data set until it is complete.
    The vocabulary table (at most the tokenizer's) is broadcast.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if size <= 1 << 16 else 4
    packed = scratch_path(spark, "token-ids")
    writer = tokenize(docs, tokenizer, end_id).write.option("compression", "zstd")
    writer.parquet(packed)
    tokens = spark.read.parquet(packed)
    counts = id_counts(tokens, width).orderBy(F.col("n").desc(), "id").collect()
    order = [r["id"] for r in counts]  # bounded by the tokenizer's vocabulary
    spark.createDataFrame(
        [(i, v, r["n"]) for i, (v, r) in enumerate(zip(order, counts))], "rank long, id long, n long"
    ).coalesce(1).write.parquet(f"{path}/vocabulary")
    ranks = np.zeros(max(order, default=0) + 1, dtype=np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)
    spread = spark.sparkContext.broadcast(ranks)
    kind = f"<u{width}"

    def pack(batches):
        table = spread.value
        first, doc_ids, parts, size, part = 0, [], [], 0, 0

        def flush():
            ids = np.frombuffer(b"".join(parts), dtype=kind)
            control, data = encode_ranks(table[ids])
            sizes = [len(p) // width for p in parts]
            rows = [[part], [first], [len(ids)], [doc_ids], [sizes], [control], [data]]
            kinds = (
                pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                pa.binary(), pa.binary(),
            )
            names = [c.split()[0] for c in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)

        for batch in batches:
            for doc, ids, where in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                part = where
                doc_ids.append(doc)
                parts.append(ids)
                size += len(ids) // width
                if size >= BLOCK_IDS:
                    yield flush()
                    first, doc_ids, parts, size = first + size, [], [], 0
        if parts:
            yield flush()

    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        tokens.repartitionByRange(n, "doc_id", F.xxhash64("ids"))
        .sortWithinPartitions("doc_id", "ids")
        .select("doc_id", "ids", F.spark_partition_id().alias("part"))
    )
    ordered.mapInArrow(pack, _BLOCK).write.option("compression", "uncompressed").parquet(
        f"{path}/blocks"
    )
    return TokenFiles(path)


def read_token_files(spark: SparkSession, files: TokenFiles, keep_ids: bool = True) -> DataFrame:
    """Decode a data set: per document ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` and, on request, ``ids``
    (packed 32-bit little-endian), in any row order.

    Only the number of ids of each written partition is summed up in one place.
    """
    blocks = files.blocks(spark)
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = [r["id"] for r in files.vocabulary(spark).orderBy("rank").collect()]
    spread = spark.sparkContext.broadcast(np.array(order, dtype="<u4"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def unpack(batches):
        table = spread.value
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                ids = table[decode_ranks(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(row["sizes"])
                begins = ends - row["sizes"]
                raw = [ids[a:b].tobytes() for a, b in zip(begins, ends)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["base"] + row["first"] + begins, pa.int64()),
                    pa.array(row["sizes"], pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array(raw, pa.binary()))
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    # one row per written partition: a size that does not follow the documents
    return blocks.join(F.broadcast(bases), "part").mapInArrow(unpack, schema)
