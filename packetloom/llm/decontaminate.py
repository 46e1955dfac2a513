"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The windows of all test items (``n`` consecutive words; a shorter item is one
window) are hashed. Every document's word windows are looked up in that set,
each hit is verified word by word, and the hit words are marked. Documents are
never shuffled.

The set is collected and broadcast in shards of a fixed size: a benchmark that
fits one shard takes one pass over the documents; a larger one takes a pass per
shard, whose marks are merged per document. So no broadcast grows with the
benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.words import FOLDED, Words, text_chunks
from packetloom.session import written

_FILTER_BITS = 22
_WINDOWS = "item_id long, length int, window binary"
_MARKS = "key long, n_words long, starts array<long>, stops array<long>, items array<long>"


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows of every item (``item_id``, ``text``), as words joined by
    blanks. Items without words, and NULL texts, have none."""

    def cut(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: set[tuple] = set()
            for row, texts in text_chunks(batch.column(1)):
                words = Words(texts.lower(), FOLDED)
                for i in range(len(texts)):
                    first, stop = int(words.rows[i]), int(words.rows[i + 1])
                    length = min(n, stop - first)
                    for at in range(first, stop - length + 1) if length else ():
                        out.add((ids[row + i], length, words.text(at, length)))
            columns = list(zip(*sorted(out, key=repr))) if out else [(), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "length", "window"]
            )

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return items.mapInArrow(cut, _WINDOWS).distinct()


class WindowSet:
    """Windows by hash: sorted hashes for the lookup, words for the check."""

    def __init__(self, rows: list[tuple[int | None, int, bytes]]):
        by_window: dict[tuple[int, bytes], list] = {}
        for item, length, window in rows:
            by_window.setdefault((length, bytes(window)), []).append(item)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, dict]] = {}
        for length in sorted({k[0] for k in by_window}):
            texts = [w for k, w in by_window if k == length]
            column = pa.array(texts, pa.large_binary())
            found: dict[int, list] = {}
            for row, part in text_chunks(column):
                words = Words(part, FOLDED)
                hashes = words.window_hashes(words.hashes(), length)
                for i in range(len(part)):
                    text = texts[row + i]
                    entry = (text, by_window[length, text])
                    found.setdefault(int(hashes[words.rows[i]]), []).append(entry)
            keys = np.array(sorted(found), dtype=np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.lengths[length] = (keys, bits, found)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list]]:
        """First word, length and items of every verified window."""
        hashes = words.hashes()
        for length, (keys, bits, found) in self.lengths.items():
            windows = words.window_hashes(hashes, length)
            near = np.flatnonzero(bits[windows >> np.uint64(64 - _FILTER_BITS)])
            if not len(near):
                continue
            place = np.minimum(np.searchsorted(keys, windows[near]), len(keys) - 1)
            near = near[keys[place] == windows[near]]
            whole = words.row_of(near) == words.row_of(near + length - 1)
            for first in near[whole].tolist():
                text = words.text(first, length)
                for known, items in found[int(windows[first])]:
                    if known == text:
                        yield first, length, items


def _marked(windows: WindowSet, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per row: key, words, the hit word ranges (disjoint, rising), the items."""
    n_words: list[int] = []
    starts: list[list[int]] = []
    stops: list[list[int]] = []
    items: list[list[int]] = []
    for _, texts in text_chunks(batch.column(1)):
        words = Words(texts.lower(), FOLDED)
        by_row: dict[int, list[tuple[int, int, list]]] = {}
        for first, length, found in windows.hits(words):
            by_row.setdefault(int(words.row_of(first)), []).append((first, length, found))
        n_words += words.counts().tolist()
        for i in range(len(texts)):
            low: list[int] = []
            high: list[int] = []
            seen: set = set()
            base = int(words.rows[i])
            for first, length, found in sorted(by_row.get(i, ()), key=lambda h: h[:2]):
                first -= base
                if high and first <= high[-1]:
                    high[-1] = max(high[-1], first + length)
                else:
                    low.append(first)
                    high.append(first + length)
                seen.update(found)
            starts.append(low)
            stops.append(high)
            items.append(sorted(seen - {None}))
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(n_words, pa.int64()),
            pa.array(starts, lists),
            pa.array(stops, lists),
            pa.array(items, lists),
        ],
        ["key", "n_words", "starts", "stops", "items"],
    )


def _shards(windows: DataFrame, shard_bytes: int) -> list[list[tuple]]:
    """The window rows, one list per shard of about ``shard_bytes``; lazily."""
    size = windows.agg(F.sum(F.length("window") + 24)).first()[0] or 0
    n = max(1, -(-int(size) // shard_bytes))
    for i in range(n):
        shard = windows.filter(F.pmod(F.xxhash64("length", "window"), F.lit(n)) == i)
        yield n, [tuple(r) for r in shard.collect()]


def mark_windows(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, shard_bytes: int = 32 << 20
) -> DataFrame:
    """Every row of ``docs`` with its hits.

    The result has the input row as the struct ``row`` (so clashing names do no
    harm) and ``n_words``, ``starts``, ``stops`` (hit word ranges, disjoint and
    rising, end exclusive) and ``items`` (ids with an occurring window, rising;
    a NULL id never shows). A NULL or empty text has no words and no hits.
    Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, n), "windows")
    shards = _shards(windows, shard_bytes)
    total, rows = next(shards)
    if total == 1:
        return _scan(docs.select(F.struct("*").alias("row"), F.col("text").alias("t")), rows)
    keyed = docs.select(
        F.struct("*").alias("row"), F.xxhash64("text").alias("key"), F.col("text").alias("t")
    )
    texts = keyed.select("key", F.col("t").cast("string"))
    parts = [written(_scan_keys(texts, rows), "marks")]
    parts += [written(_scan_keys(texts, rows), "marks") for _, rows in shards]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # equal texts have equal marks: one row a key and shard before the merge
    merged = every.distinct().groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = keyed.select("row", "key").join(merged, "key")
    return joined.select("row", "n_words", *_merge_ranges("ranges"), "items")


def _merge_ranges(name: str) -> list:
    """Overlapping and touching ranges joined, as ``starts`` and ``stops``."""
    step = (
        "aggregate(array_sort({0}), cast(array() as array<struct<starts:bigint,stops:bigint>>), "
        "(done, r) -> case when size(done) > 0 and r.starts <= done[size(done) - 1].stops "
        "then concat(slice(done, 1, size(done) - 1), array(named_struct("
        "'starts', done[size(done) - 1].starts, "
        "'stops', greatest(done[size(done) - 1].stops, r.stops)))) "
        "else concat(done, array(r)) end)"
    ).format(name)
    return [F.expr(f"{step}.{c}").alias(c) for c in ("starts", "stops")]


def _scan_keys(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    spread = texts.sparkSession.sparkContext.broadcast(rows)

    def scan(batches):
        windows = WindowSet(spread.value)
        for batch in batches:
            yield _marked(windows, batch)

    return texts.mapInArrow(scan, _MARKS)


def _scan(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(rows)
    kind = docs.schema["row"].dataType.simpleString()

    def scan(batches):
        windows = WindowSet(spread.value)
        for batch in batches:
            marks = _marked(windows, batch)
            names = ["row", *marks.schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *marks.columns[1:]], names)

    result = docs.select("row", F.col("t").cast("string").alias("t"))
    return result.mapInArrow(scan, f"row {kind}, {_MARKS.removeprefix('key long, ')}")


def n_hit(starts: str = "starts", stops: str = "stops"):
    """Words inside the ranges."""
    return F.expr(f"aggregate(zip_with({stops}, {starts}, (b, a) -> b - a), 0L, (s, x) -> s + x)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """The documents without what they share with the benchmark.

    ``mode="documents"`` removes every document with a hit; ``mode="spans"``
    removes the hit words (with what stands between them) from the text, and
    leaves all rows. Columns are those of ``docs``.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    marked = mark_windows(docs, benchmark, n)
    if mode == "documents":
        return marked.filter(F.size("starts") == 0).select("row.*")
    names = docs.columns
    cleaned = without_words(marked)
    return cleaned.select(
        *[F.col("text_left") if c == "text" else F.col(f"row.`{c}`") for c in names]
    ).toDF(*names)


def without_words(marked: DataFrame) -> DataFrame:
    """Add ``text_left``: the text without the bytes of the hit ranges. The cut
    goes from the first to the last hit word; white space around it stays."""
    kind = marked.schema["row"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            row, starts, stops = batch.columns
            column = row.field("text")
            out: list = column.to_pylist()
            low, high = starts.to_pylist(), stops.to_pylist()
            for at, texts in text_chunks(column):
                if not any(low[at : at + len(texts)]):
                    continue
                words = Words(texts.lower(), FOLDED)
                for i in range(len(texts)):
                    if not low[at + i]:
                        continue
                    kept, done, base = [], int(texts.bounds[i]), int(words.rows[i])
                    for a, b in zip(low[at + i], high[at + i]):
                        kept.append(texts.data[done : words.starts[base + a]].tobytes())
                        done = int(words.ends[base + b - 1])
                    kept.append(texts.data[done : texts.bounds[i + 1]].tobytes())
                    out[at + i] = b"".join(kept).decode()
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.string())], ["row", "text_left"])

    return marked.select("row", "starts", "stops").mapInArrow(cut, f"row {kind}, text_left string")
