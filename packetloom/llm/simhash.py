"""SimHash near-duplicates: exact comparison of fingerprint tiles.

Fingerprints at most ``RADIUS`` bits apart agree in one of ``RADIUS + 1`` bands of
their bits. Distinct fingerprints are brought together band by band; within one
band value they form tiles by population count, and tiles whose counts differ by
more than the radius are never compared. The rest is compared bit by bit with
numpy, every pair, so no link is lost.

A band value that too many fingerprints share is cut again by bands of the
remaining bits (two fingerprints that agree there still differ in at most
``RADIUS`` of the others), so groups shrink however the bits are distributed.
What is still large after the last cut goes out in pairs of tiles, a task each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.session import written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: fingerprints of one tile
TILE = 1024
#: band values with more fingerprints are cut again
GROUP = 4096
_CUTS = 3


def fingerprint_bytes(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()  # bytes: folds A-Z only, cuts at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[: len(words) - shingle + 1].tolist()
        ends = (ends - 1)[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, ends)]
    ones = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype=">u8")
    for at in range(0, len(every), 1 << 14):
        bits = np.unpackbits(every[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(every)).tobytes(), "big")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with ``fp``, the signed
    64-bit fingerprint; NULL and empty texts have 0."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            found = np.array([fingerprint_bytes(t.as_py()) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], ["row", "fp"]
            )

    return rows.mapInArrow(scan, f"row {kind}, fp long")


# --- links ------------------------------------------------------------------


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _mask(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _banded(prints: DataFrame, radius: int) -> DataFrame:
    """``fp`` once per band: ``mask`` (the bits that a group shares) and ``value``."""
    masks = [_mask(b) for b in _bands(list(range(64)), radius + 1)]
    return prints.select(
        "fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    ).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _cut_again(rows: DataFrame, radius: int) -> DataFrame:
    """The same rows, each once per band of the bits outside its mask."""
    masks: dict[int, list[int]] = {}
    for (mask,) in rows.select("mask").distinct().collect():  # (radius + 1) ** cuts at most
        left = [b for b in range(64) if not mask >> b & 1]
        masks[mask] = [mask | _mask(b) for b in _bands(left, radius + 1)]
    table = F.create_map(
        *[
            F.lit(x).cast("long") if isinstance(x, int) else x
            for mask, more in masks.items()
            for x in (mask, F.array(*[F.lit(m).cast("long") for m in more]))
        ]
    )
    again = rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
    return again.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _split(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows in groups of up to ``limit``, and those in larger ones."""
    sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > limit).select("mask", "value")
    keys = ["mask", "value"]
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Component label (smallest member) of ``n`` items under the given pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def link_forest(prints: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """Links (two rows) that join exactly what all pairs within ``radius`` join:
    at most one per fingerprint. Tiles follow the population count."""
    ones = np.bitwise_count(prints)
    order = np.argsort(ones, kind="stable")
    prints, ones = prints[order], ones[order].astype(np.int64)
    label = np.arange(len(prints))
    starts = range(0, len(prints), tile)
    for i in starts:
        a = prints[i : i + tile]
        for j in range(i, len(prints), tile):
            if ones[j] - ones[min(i + tile, len(prints)) - 1] > radius:
                break
            x, y = _near(a, prints[j : j + tile], radius)
            x, y = label[x + i], label[y + j]
            other = x != y
            if other.any():
                label = _forest(x[other], y[other], len(prints))[label]
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return np.stack([prints[moved], prints[label[moved]]])


def _links_of(groups: DataFrame, radius: int) -> DataFrame:
    """Links within groups of bounded size (``mask``, ``value``, ``fp``)."""
    dealt = groups.repartition("mask", "value").sortWithinPartitions("mask", "value")

    def compare(batches):
        rest = None
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy() for i in range(3)])
            part = part if rest is None else np.concatenate([rest, part], axis=1)
            change = (part[:2, 1:] != part[:2, :-1]).any(axis=0)
            edges = np.concatenate([[0], np.flatnonzero(change) + 1])
            rest = part[:, edges[-1] :]
            yield from _compared(part[2], edges, radius)
        if rest is not None and rest.shape[1]:
            yield from _compared(rest[2], np.array([0, rest.shape[1]]), radius)

    return dealt.select("mask", "value", "fp").mapInArrow(compare, "a long, b long")


def _compared(prints: np.ndarray, edges: np.ndarray, radius: int):
    """Links of consecutive groups; groups of two are compared all at once."""
    prints = prints.view(np.uint64) if prints.dtype == np.int64 else prints
    sizes = np.diff(edges)
    two = edges[:-1][sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius
    found = [np.stack([prints[two[near]], prints[two[near] + 1]])]
    for k in np.flatnonzero(sizes > 2).tolist():
        found.append(link_forest(prints[edges[k] : edges[k + 1]], radius))
    links = np.concatenate(found, axis=1).view(np.int64)
    if links.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])


def _links_of_tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Links within groups of any size: pairs of tiles, a task each.

    A tile holds one population count of a group; counts with more than ``tile``
    fingerprints are dealt to several by hash. A pair of tiles is one group of
    the shuffle, of 2 x ``tile`` fingerprints or little more.
    """
    keys = ["mask", "value"]
    counted = rows.withColumn("ones", F.bit_count("fp"))
    sizes = counted.groupBy(*keys, "ones").agg(F.count(F.lit(1)).alias("n"))
    slots = F.ceil(F.col("n") / tile).cast("int")
    tiles = sizes.select(*keys, "ones", slots.alias("slots"))
    placed = counted.join(tiles, [*keys, "ones"]).withColumn(
        "slot", F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
    )
    one = tiles.select(*keys, F.col("ones").alias("o1"), F.explode(F.expr("sequence(0, slots - 1)")).alias("s1"))
    # only the neighbouring counts of each tile, listed, not looked for
    near = one.select("*", F.explode(F.expr(f"sequence(o1, o1 + {radius})")).alias("o2"))
    pairs = near.join(
        tiles.select(*keys, F.col("ones").alias("o2"), F.col("slots").alias("m")), [*keys, "o2"]
    ).select(*keys, "o1", "s1", "o2", F.explode(F.expr("sequence(0, m - 1)")).alias("s2"))
    pairs = pairs.filter("o1 < o2 or s1 <= s2").withColumn("pair", F.xxhash64("o1", "s1", "o2", "s2"))
    ends = pairs.select(*keys, "pair", F.explode(F.array_distinct(F.array(
        F.struct(F.col("o1").alias("ones"), F.col("s1").alias("slot")),
        F.struct(F.col("o2").alias("ones"), F.col("s2").alias("slot")),
    ))).alias("end")).select(*keys, "pair", "end.ones", "end.slot")
    sent = placed.join(ends, [*keys, "ones", "slot"])
    return _links_of(
        sent.select(F.xxhash64("mask", "pair").alias("mask"), "value", "fp"), radius
    )


def fingerprint_links(
    prints: DataFrame, radius: int = RADIUS, group: int = GROUP, tile: int = TILE
) -> DataFrame:
    """``a``, ``b``: links joining exactly the distinct fingerprints (column
    ``fp``) that a chain of steps of ``radius`` bits or less joins."""
    rows = _banded(prints, radius)
    found = None
    for cut in range(_CUTS + 1):
        rows = written(rows, "bands")
        small, large = _split(rows, group)
        links = written(_links_of(small, radius), "links")
        found = links if found is None else found.unionByName(links)
        large = written(large, "bands")
        if large.isEmpty():
            return found
        rows = _cut_again(large, radius) if cut < _CUTS else large
    return found.unionByName(_links_of_tiles(rows, radius, tile))


def near_duplicates(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, ``root`` (a fingerprint naming the component) and ``component_id``
    of every fingerprint, from rows ``fp``, ``id``.

    ``component_id`` is the smallest id of any row whose fingerprint is reached
    by links; ids that are NULL count only where a component has no other.
    """
    by_print = written(fingerprints.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = written(components(fingerprint_links(by_print.select("fp"), radius)), "roots")
    joined = by_print.join(roots, by_print["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def cluster(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` per row.

    Repeated rows and equal texts share a component; NULL, empty and blank texts
    have fingerprint zero and are linked like any other.
    """
    prints = written(with_fingerprint(docs.select("doc_id", "text")).select("row.doc_id", "fp"), "fp")
    classes = near_duplicates(prints.select("fp", F.col("doc_id").alias("id")), radius)
    return prints.join(written(classes, "classes"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with
    the smallest ``doc_id`` (NULL last) stays, exactly one even among ties."""
    # numbered once, in the written table: a stable key for rows without one
    rows = written(
        with_fingerprint(docs).withColumn("n", F.monotonically_increasing_id()), "rows"
    )
    keys = rows.select("fp", F.col("row.doc_id").alias("doc_id"), "n")
    classes = near_duplicates(keys.select("fp", F.col("doc_id").alias("id")), radius)
    named = keys.join(written(classes, "classes"), "fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "n")
    first = named.groupBy("root").agg(F.min_by("n", order).alias("n"))
    return rows.join(first.select("n"), "n", "left_semi").select("row.*")
