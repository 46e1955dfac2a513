"""Near copies of whole texts: shared shingles, fingerprints, then the shingles themselves.

Texts are taken as sets of five-word shingles. In one fixed order of all shingles two
sets of a Jaccard similarity of 0.8 share one of the first n - ceil(0.8 n) + 1 of each,
so texts meet in the groups of these. Shingles that very many texts hold come last in
the order: they form groups only where a text has little else.

A first round takes each text in the group of its first shingle alone, where most
copies already meet; later rounds take what it joined as one.

Inside a group fingerprints of 256 bits are compared by exclusive-or and bit counts,
those first whose population counts allow it; groups larger than a tile go out as
pairs of tiles. Of the pairs within the radius a task passes on a spanning forest, the
nearest first; texts that are joined already cost no link of it.

What these links join is a block: all pairs within the radius lie inside one. A text
goes once to its block, with its shingles, or once to each pair of the block's tiles.
There pairs within the radius are verified by their shingles, those already joined
left out, and the verified links that join something are passed on: at most one a
text and task, however many texts are near each other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.words import SPACED, Words, text_chunks
from packetloom.session import written

SHINGLE = 5
SIMILAR = 0.8
LANES = 4
#: bits of 256: sets at 0.8 differ in 39 on the average (deviation 5.7), so three
#: deviations reach 99.8 % of pairs right at the limit; unlike sets differ in 128
RADIUS = 56
#: texts of one tile, and the hashes of one tile of a block
TILE = 2048
TILE_HASHES = 1 << 20
#: hashes that are verified at once
_VERIFIED = 1 << 18
#: bytes of a signature; each agrees with chance J + (1 - J) / 256 for a similarity of J,
#: so at 0.8 some 205 do (deviation 6.4)
SIGNATURE = 256
#: texts in which frequent shingles are looked for, and in how many of them those stand.
#: The order of shingles, not the result, follows from this.
SAMPLE = 20_000
FREQUENT = 40
_MOST_FREQUENT = 100_000
#: digests that a task remembers so as not to send the keys of copies again
_SEEN = 100_000
#: hashes that a task hands over at once
_SENT = 1 << 18
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64
)
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array):
    """Per text its sorted distinct shingle hashes and the bytes that it is compared by:
    its words, folded and joined by blanks. Texts of one to four words have one shingle."""
    for _, texts in text_chunks(column, 1 << 19):
        texts = texts.lower()
        words = Words(texts, SPACED)
        each = words.hashes()
        whole = words.window_hashes(each, SHINGLE)
        data = texts.data.tobytes()
        for i in range(len(texts)):
            a, b = int(words.rows[i]), int(words.rows[i + 1])
            if b - a >= SHINGLE:
                found = np.unique(whole[a : b - SHINGLE + 1])
            else:  # equal only to the same words, which one digest says already
                found = each[a : min(b, a + 1)]
            yield found, b" ".join(data[texts.bounds[i] : texts.bounds[i + 1]].split())


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of ``LANES`` times 64 bits."""
    ones = np.zeros(64 * LANES, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 12):
        lanes = hashes[at : at + (1 << 12), None] * _MULTIPLIERS
        lanes ^= lanes >> np.uint64(29)
        lanes *= _MULTIPLIERS[0]
        lanes ^= lanes >> np.uint64(32)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Of each of ``SIGNATURE`` hash functions the last byte of its least value."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 11):
        lanes = hashes[at : at + (1 << 11), None] * _SEEDS
        lanes ^= lanes >> np.uint64(32)
        lanes *= _MULTIPLIERS[0]
        lanes ^= lanes >> np.uint64(29)
        np.minimum(least, lanes.min(axis=0), out=least)
    return least.astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of ``SIMILAR``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both >= SIMILAR * (len(a) + len(b) - both)


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which any similar set shares."""
    n = len(hashes) - math.ceil(SIMILAR * len(hashes) - 1e-9) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = frequent[at] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    return hashes[:n]


def _texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("row.text").cast("string").alias("t"), *more)


def _scanned(docs: DataFrame) -> DataFrame:
    """``row``, ``n``, ``digest`` (of the words), ``size`` (distinct shingles) and ``fp``."""
    rows = docs.select(F.col("text").cast("string").alias("t"), F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            digests, sizes, prints = [], [], []
            for hashes, words in shingle_sets(batch.column(0)):
                digests.append(hashlib.md5(words).digest())
                sizes.append(len(hashes))
                prints.append(fingerprint(hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1), pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                ],
                ["row", "digest", "size", "fp"],
            )

    found = rows.mapInArrow(scan, f"row {kind}, digest binary, size long, fp binary")
    return found.withColumn("n", F.monotonically_increasing_id())


def _filled(sets, limit: int = _SENT):
    """Lists of consecutive sets with some ``limit`` hashes together."""
    held, size = [], 0
    for hashes in sets:
        held.append(hashes)
        size += len(hashes)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequent(rows: DataFrame, total: int) -> np.ndarray:
    """Hashes that many texts of a sample hold, sorted; at most ``_MOST_FREQUENT``."""
    part = F.pmod(F.xxhash64("digest"), F.lit(max(1, total // SAMPLE))) == 0

    def explode(batches):
        for batch in batches:
            for every in _filled(h for h, _ in shingle_sets(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(every).view(np.int64))], ["h"])

    counted = _texts(rows.filter(part)).mapInArrow(explode, "h long").groupBy("h").count()
    most = counted.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(_MOST_FREQUENT)
    return np.sort(np.array([r["h"] for r in most.collect()], dtype=np.int64).view(np.uint64))


def _shared(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``key``, ``digest``, ``lead`` (whether it is the text's first): the prefix shingles
    that more than one text holds."""
    often = rows.sparkSession.sparkContext.broadcast(frequent)

    def keys(batches):
        seen: set[bytes] = set()

        def new(batch, names):
            for (hashes, _), digest in zip(shingle_sets(batch.column(0)), batch.column(1).to_pylist()):
                if digest not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(digest)
                    names.append(digest)
                    yield prefix(hashes, often.value)

        for batch in batches:
            names: list[bytes] = []
            for found in _filled(new(batch, names)):
                every = np.concatenate(found)
                counts = np.array([len(f) for f in found])
                owner = pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), counts)))
                lead = np.zeros(len(every), dtype=bool)
                lead[np.cumsum(counts) - counts] = True
                columns = [pa.array(every.view(np.int64)), owner, pa.array(np.isin(every, often.value)), pa.array(lead)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "hot", "lead"])
                names.clear()

    def twice(batches):
        """Groups of two texts or more, without repeats; rows pass through."""
        last, first = None, None
        for batch in batches:
            key, digest, lead = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keep = []
            for k, d, at_lead in zip(key.tolist(), digest, lead):
                if last is None or last[0] != k:
                    last, first = (k, d), (k, d, at_lead)
                elif last[1] != d:
                    if first is not None:
                        keep.append(first)
                        first = None
                    keep.append((k, d, at_lead))
                    last = (k, d)
            columns = list(zip(*keep)) or [(), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "digest", "lead"]
            )

    held = "key long, digest binary, hot boolean, lead boolean"
    sent = written(_texts(rows.filter(F.col("size") > 1), "digest").mapInArrow(keys, held), "keys")
    rare = sent.filter("not hot").drop("hot").repartition("key").sortWithinPartitions("key", "digest")
    hot = sent.filter("hot").drop("hot").distinct()
    return rare.mapInArrow(twice, "key long, digest binary, lead boolean").unionByName(hot)


def _tile_pairs(slots: Column, slot: Column) -> Column:
    """Every pair (p <= q, in one number) that the slot is one of."""
    return F.transform(
        F.sequence(F.lit(0), slots - 1), lambda s: F.greatest(s, slot) * F.lit(1 << 32) + F.least(s, slot)
    )


def _grouped(shared: DataFrame, tile: int) -> DataFrame:
    """The rows (``key``, ``digest``, ...) with ``part``, the group that a task compares:
    those of a key, or of a pair of its tiles."""
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    large = written(
        sizes.filter(F.col("rows") > tile).select("key", F.ceil(F.col("rows") / tile).cast("int").alias("slots")), "large"
    )
    placed = shared.join(large, "key", "left")
    slot = F.pmod(F.xxhash64("digest"), F.col("slots")).cast("int")
    pair = _tile_pairs(F.col("slots"), slot)
    parts = F.when(F.col("slots").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pair)
    return placed.withColumn("part", F.explode(parts)).drop("slots")


def _distances(prints: np.ndarray, ones: np.ndarray, i: int, radius: int) -> tuple[int, np.ndarray]:
    """Bits between item ``i`` and those whose population counts allow the radius, by
    the first of these; ``ones`` ascend."""
    begin = int(np.searchsorted(ones, ones[i] - radius))
    end = int(np.searchsorted(ones, ones[i] + radius, side="right"))
    return begin, np.bitwise_count(prints[begin:end] ^ prints[i]).sum(axis=1, dtype=np.int64)


def near_forest(
    prints: np.ndarray, sizes: np.ndarray, radius: int, roots: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Pairs that span what pairs within the radius, of sizes that allow the similarity,
    join: to each text the nearest of those before it. Texts of one of the ``roots``
    are joined already, by no pair."""
    ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    prints, ones, sizes = prints[order], ones[order], sizes[order]
    roots = np.arange(len(ones)) if roots is None else roots[order]
    far = 64 * LANES + 1
    best, parent = np.full(len(ones), far), np.full(len(ones), -1)
    waiting = np.ones(len(ones), dtype=bool)
    out = []
    i = 0
    while True:
        waiting[i] = False
        if parent[i] >= 0:
            out.append((int(order[parent[i]]), int(order[i])))
        begin, bits = _distances(prints, ones, i, radius)
        reach = slice(begin, begin + len(bits))
        small, large = np.minimum(sizes[reach], sizes[i]), np.maximum(sizes[reach], sizes[i])
        closer = waiting[reach] & (bits <= radius) & (bits < best[reach]) & (small >= SIMILAR * large)
        best[reach][closer] = bits[closer]
        parent[reach][closer] = i
        joined = waiting & (roots == roots[i])
        best[joined], parent[joined] = -1, -1
        best[i] = far
        i = int(np.argmin(np.where(waiting, best, far + 1)))
        if not waiting[i]:
            return out


def similar_forest(
    prints: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, radius: int, slots: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Pairs that span what similar pairs within the radius join. ``hashes`` holds the
    sets one after the other, of ``sizes``; with ``slots`` only pairs of different ones count."""
    ones = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    prints, ones = prints[order], ones[order]
    names, ids = np.unique(hashes, return_inverse=True)
    begins = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    slots = None if slots is None else slots[order]
    roots = np.arange(len(ones))
    own = np.zeros(len(names), dtype=bool)
    out = []
    for i in range(len(ones)):
        begin, bits = _distances(prints, ones, i, radius)
        reach = slice(begin, begin + len(bits))
        small, large = np.minimum(sizes[reach], sizes[i]), np.maximum(sizes[reach], sizes[i])
        found = (bits <= radius) & (roots[reach] != roots[i]) & (small >= SIMILAR * large)
        if slots is not None:
            found &= slots[reach] != slots[i]
        found[: i + 1 - begin] = False
        at = np.flatnonzero(found)
        later = at[np.argsort(bits[at], kind="stable")] + begin
        held = ids[begins[i] : begins[i] + sizes[i]]
        own[held] = True
        step = 8
        while len(later):
            some, later = later[:step], later[step:]
            counts = sizes[some]
            edges = np.cumsum(counts) - counts
            each = np.repeat(begins[some] - edges, counts) + np.arange(counts.sum())
            both = np.add.reduceat(own[ids[each]], edges, dtype=np.int64)
            for j in some[(both > 0) & (both >= SIMILAR * (counts + sizes[i] - both))].tolist():
                if roots[j] != roots[i]:
                    out.append((int(order[i]), int(order[j])))
                    roots[roots == roots[j]] = roots[i]
            later = later[roots[later] != roots[i]]
            step = min(4 * step, max(8, _VERIFIED // max(1, int(sizes[i]))))
        own[held] = False
    return out


def _compared(groups: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b`` (a < b): a forest of links of ``node`` from rows ``key``, ``part``,
    ``node``, ``fp``, ``size``, ``root``."""
    dealt = groups.select("key", "part", "node", "size", "root", "fp")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node")

    def pairs(table, fps, a, b):
        if (table[4, a:b] == table[4, a]).all():
            return []
        node, prints = table[2, a:b], np.frombuffer(b"".join(fps[a:b]), dtype=np.uint64).reshape(b - a, LANES)
        return [(node[i], node[j]) for i, j in near_forest(prints, table[3, a:b], radius, table[4, a:b])]

    def compare(batches):
        rest, held = np.zeros((5, 0), dtype=np.int64), []
        sent: set[tuple[int, int]] = set()
        for batch in [*batches, None]:
            table, fps = rest, held
            if batch is not None:
                new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
                table = np.concatenate([rest, new], axis=1)
                fps = [*held, *batch.column(5).to_pylist()]
            change = (table[:2, 1:] != table[:2, :-1]).any(axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            rest, held = table[:, edges[-1] :], fps[edges[-1] :]
            if batch is None:
                edges.append(table.shape[1])
            out = []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    for p, q in pairs(table, fps, a, b):
                        pair = (int(min(p, q)), int(max(p, q)))
                        if pair not in sent:
                            if len(sent) >= _SEEN:
                                sent.clear()
                            sent.add(pair)
                            out.append(pair)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _blocks(rows: DataFrame, texts: DataFrame, links: DataFrame, tile: int) -> DataFrame:
    """``block``, ``part`` (pair of its tiles), ``slot`` (tile), ``node``, ``fp`` and ``hashes``
    of all texts in what the links join."""
    joined = written(components(links), "joined").toDF("node", "block")
    placed = joined.join(texts.select("node", "fp", "size"), "node")
    extent = placed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("held"))
    slots = F.ceil(F.greatest(F.col("rows") / tile, F.col("held") / TILE_HASHES)).cast("int")
    placed = placed.join(extent.select("block", slots.alias("slots")), "block")
    slot = F.pmod(F.xxhash64("node"), F.col("slots")).cast("int")
    placed = placed.select("block", "slots", slot.alias("slot"), "node", "fp")
    named = _texts(rows.select("n", "row").join(placed, F.col("n") == F.col("node")), *placed.columns)

    def hashed(batches):
        for batch in batches:
            found = [h.tobytes() for h, _ in shingle_sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.binary())], [*batch.schema.names[1:], "hashes"]
            )

    sets = named.mapInArrow(hashed, "block long, slots int, slot int, node long, fp binary, hashes binary")
    parts = F.explode(_tile_pairs(F.col("slots"), F.col("slot"))).alias("part")
    return sets.select("block", parts, "slot", "node", "fp", "hashes")


def _verified(blocks: DataFrame, radius: int) -> DataFrame:
    """``a``, ``b``: links that span what similar pairs within the radius join."""
    dealt = blocks.repartition("block", "part").sortWithinPartitions("block", "part", "node")

    def links(block, part, slots, nodes, prints, held):
        sets = [np.frombuffer(h, np.uint64) for h in held]
        sizes = np.array([len(h) for h in sets], dtype=np.int64)
        prints = np.frombuffer(b"".join(prints), dtype=np.uint64).reshape(len(nodes), LANES)
        # pairs inside a tile belong to the part of that tile alone
        apart = None if part >> 32 == part & 0xFFFFFFFF else np.array(slots)
        return [(nodes[i], nodes[j]) for i, j in similar_forest(prints, np.concatenate(sets), sizes, radius, apart)]

    def verify(batches):
        at, held = None, ([], [], [], [])
        for batch in [*batches, None]:
            out = []
            columns = [] if batch is None else [c.to_pylist() for c in batch.columns]
            for block, part, *row in [*zip(*columns), *([(None, None)] if batch is None else [])]:
                if (block, part) != at:
                    if at is not None and len(held[1]) > 1:
                        out += links(*at, *held)
                    at, held = (block, part), ([], [], [], [])
                for into, value in zip(held, row):
                    into.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long")


def _open(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows with the ``root`` of what is joined, without groups of one class: these
    have nothing left to compare."""
    placed = groups.join(joined.toDF("node", "r"), "node", "left")
    placed = placed.withColumn("root", F.coalesce("r", "root")).drop("r")
    classes = placed.groupBy("key", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(classes.filter("low <> high").select("key", "part"), ["key", "part"], "left_semi")


def similar_links(rows: DataFrame, texts: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a``, ``b``: links that join exactly the texts (``node``) that steps of similarity
    ``SIMILAR`` or more within the radius join, from ``_scanned`` rows and their distinct texts."""
    frequent = _frequent(rows, texts.count())
    shared = written(_shared(rows, frequent), "shared")
    nodes = texts.select("digest", "node", "fp", "size", F.col("node").alias("root"))
    groups = _grouped(shared.join(nodes, "digest").drop("digest").withColumn("digest", F.col("node")), tile)
    groups = written(groups.drop("digest", "rows"), "groups")

    led = written(_compared(groups.filter("lead"), radius), "pairs")
    # the other groups join what the first shingles left apart
    met = written(_compared(_open(groups, written(components(led), "met")), radius), "pairs")
    return written(_verified(_blocks(rows, texts, led.unionByName(met), tile), radius), "similar")


def keep_one_similar(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of texts that steps of
    similarity ``SIMILAR`` or more join, the row with the smallest ``doc_id`` (NULL
    last) stays, exactly one even among ties. Equal words are equal texts; NULL,
    empty and blank texts are one class. An empty table stays empty.
    """
    rows = written(_scanned(docs), "rows")
    texts = rows.groupBy("digest").agg(
        F.min("n").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size")
    )
    texts = written(texts, "texts")
    roots = written(components(similar_links(rows, texts, radius, tile)), "roots").toDF("node", "root")
    named = texts.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    keys = rows.select("digest", F.col("row.doc_id").alias("doc_id"), "n").join(named, "digest")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "n")
    kept = keys.groupBy("root").agg(F.min_by("n", order).alias("n"))
    return rows.join(kept.select("n"), "n", "left_semi").select("row.*")
