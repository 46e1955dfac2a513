"""Phrase collocations by HAT-trie counting.

Three passes count words, word pairs and word triples of every language. A task
keeps its counts in a HAT-trie: a shallow trie over word ids whose leaves are hash
containers. A container that grows too large bursts into several, each for a range
of prefixes; when a task holds too many entries its largest subtrees are spilled
whole, as sorted runs, and counted anew from there. Spark shuffles the runs by
prefix and merges them, so no task holds more than a part of a language.

A phrase is frequent only if its parts are, so pairs are counted of frequent words
and triples of frequent pairs. Frequent parts are known to tasks by a bitmap of a
fixed size over their hashes: a false hit costs a little shuffle, never a wrong
count. Words are told apart by their bytes and phrases are merged by their text.
"""

from __future__ import annotations

from collections import _count_elements
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordering import with_rank
from packetloom.session import written

LEAST = 10
LONGEST = 3
TOP = 2000
#: percent of a phrase's places inside one longer candidate, from which it is dropped
INSIDE = 50
SCALE = 1_000_000
NO_LANGUAGE = "und"

#: bits of the bitmap of frequent parts: 16 MB, whatever the input
FILTER_BITS = 27
#: bytes of text that a task cuts into words at a time
_CHUNK = 1 << 22
#: bits of a word id; a task that has met half as many words starts its ids anew
_ID = 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: words and entries that a task holds, over all languages
_SPACE = 2_400_000
#: parts among which the phrases under one first word are dealt
_SLICES = 16

# A-Z to a-z, tabs to blanks, every separator of pieces to the full stop
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _b in _SEPARATORS:
    _FOLD[_b] = 46
_FOLD = bytes(_FOLD)


class HatTrie:
    """Counts of integer keys: word ids from the high bits down.

    ``lows`` are the first keys of the containers, ascending; a container is a hash
    table of the keys up to the next. A container with more than ``burst`` keys is
    cut where a prefix begins: at a first word if it holds several, else at a second
    one, and so on.
    """

    def __init__(self, burst: int = 1 << 15, limit: int = 1_200_000):
        self.burst, self.limit = burst, limit
        self.lows: list[int] = [0]
        self.tables: list[dict] = [{}]
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        """Count every occurrence of ``keys`` (int64)."""
        keys = np.sort(keys)
        edges = [0, *np.searchsorted(keys, self.lows[1:]).tolist(), len(keys)]
        large = []
        for at, (i, j) in enumerate(zip(edges, edges[1:])):
            if i < j:
                table = self.tables[at]
                before = len(table)
                _count_elements(table, keys[i:j].tolist())
                self.size += len(table) - before
                if len(table) > self.burst:
                    large.append(at)
        for at in reversed(large):
            self._burst(at)

    def _burst(self, at: int) -> None:
        keys = np.sort(np.fromiter(self.tables[at], dtype=np.int64, count=len(self.tables[at])))
        parts = 2 * len(keys) // self.burst + 1
        cuts: set[int] = set()
        for key in keys[np.linspace(0, len(keys), parts + 1, dtype=np.int64)[1:-1]].tolist():
            # the shallowest prefix that begins inside the container
            for level in (2 * _ID, _ID, 0):
                low = key >> level << level
                if low > keys[0]:
                    cuts.add(low)
                    break
        lows = [self.lows[at], *sorted(cuts)]
        tables: list[dict] = [{} for _ in lows]
        old = self.tables[at]
        edges = [0, *np.searchsorted(keys, lows[1:]).tolist(), len(keys)]
        for table, i, j in zip(tables, edges, edges[1:]):
            table.update((k, old[k]) for k in keys[i:j].tolist())
        self.lows[at : at + 1] = lows
        self.tables[at : at + 1] = tables

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The largest subtrees, emptied, as sorted runs (keys, counts), until at most
        ``keep`` keys are left."""
        for at in sorted(range(len(self.tables)), key=lambda i: -len(self.tables[i])):
            if self.size <= keep:
                return
            table = self.tables[at]
            self.tables[at] = {}
            self.size -= len(table)
            keys = np.fromiter(table, dtype=np.int64, count=len(table))
            counts = np.fromiter(table.values(), dtype=np.int64, count=len(table))
            order = np.argsort(keys)
            yield keys[order], counts[order]


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * _ODD) ^ (b + (a >> np.uint64(17)))
    out *= _ODD
    return out ^ (out >> np.uint64(32))


class _Words(dict):
    """Ids of one language's words, from 1; 0 for the end of a piece and for words
    that are not in the filter."""

    def __init__(self, lang: str, known: bytes | None):
        super().__init__({b".": 0})
        self.lang, self.known = lang, known
        self.names: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        if self.known is not None:
            at = h >> (64 - FILTER_BITS)
            if not self.known[at >> 3] >> (at & 7) & 1:
                self[word] = 0
                return 0
        self[word] = at = len(self.names)
        self.names.append(word)
        self.hashes.append(h)
        return at


def _known(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    bitmap = np.frombuffer(bitmap, dtype=np.uint8)
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Counter:
    """The words of one language as a task meets them: ids, trie, and the last ids
    of the text so far, with which the next chunk goes on."""

    def __init__(self, lang: str, length: int, known: bytes | None):
        self.lang, self.length, self.known = lang, length, known
        self.trie = HatTrie()
        self._renew()

    def _renew(self) -> None:
        words = self.known if self.length == 2 else None
        self.words = _Words(self.lang, words)
        self.tail = np.zeros(0, dtype=np.int64)

    def add(self, chunk: bytes) -> Iterator[pa.RecordBatch]:
        """Count a chunk (folded, cut between words); yields what had to be spilled."""
        tokens = chunk.replace(b".", b" . ").split()
        ids = np.array(list(map(self.words.__getitem__, tokens)), dtype=np.int64)
        ids = np.concatenate([self.tail, ids])
        self.tail = ids[len(ids) - min(self.length - 1, len(ids)) :]
        n = len(ids) - self.length + 1
        if n > 0:
            places = [ids[k : k + n] for k in range(self.length)]
            inside = np.logical_and.reduce([p > 0 for p in places])
            if self.length == 3:
                h = np.array(self.words.hashes, dtype=np.uint64)[ids]
                pair = _known(self.known, pair_hash(h[:-1], h[1:]))
                inside &= pair[:-1] & pair[1:]
            keys = np.zeros(int(inside.sum()), dtype=np.int64)
            for p in places:
                keys = (keys << _ID) | p[inside]
            self.trie.add(keys)
        if len(self.words) > 1 << (_ID - 1):
            last = [self.words.names[i] for i in self.tail]
            yield from self.close()
            self._renew()
            self.tail = np.array([self.words[w or b"."] for w in last], dtype=np.int64)
        elif self.trie.size > self.trie.limit:
            yield from self._runs(self.trie.limit // 2)

    def weight(self) -> int:
        return len(self.words) + self.trie.size

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._runs(0)

    def _runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        names, hashes = pa.array(self.words.names, pa.binary()), np.array(self.words.hashes, np.uint64)
        for keys, counts in self.trie.spill(keep):
            ids = [keys >> (_ID * k) & ((1 << _ID) - 1) for k in reversed(range(self.length))]
            words = [names.take(pa.array(i)) for i in ids]
            text = words[0] if self.length == 1 else pc.binary_join_element_wise(*words, b" ")
            second = hashes[ids[1]] % np.uint64(_SLICES) if self.length > 1 else np.uint64(0)
            prefix = (hashes[ids[0]] + second * _ODD).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.lang] * len(keys), pa.string()),
                    pa.array(prefix),
                    text.cast(pa.string()),
                    pa.array(counts),
                ],
                ["lang", "prefix", "phrase", "n"],
            )


def _chunks(texts: list[bytes]) -> Iterator[bytes]:
    """Texts, folded and each ended as a piece, in chunks of some size that are cut
    between words."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text.translate(_FOLD)
        at = 0
        while len(text) - at > _CHUNK:  # a long text: as far as a word ends
            end = max(text.rfind(b" ", at, at + _CHUNK), text.rfind(b".", at, at + _CHUNK)) + 1
            if not end:
                ends = [e for e in (text.find(b" ", at), text.find(b".", at)) if e >= 0]
                end = min(ends, default=len(text) - 1) + 1
            yield b"".join([*held, text[at:end]])
            held, size, at = [], 0, end
        held.append(text[at:])
        held.append(b".")
        size += len(text) - at
        if size >= _CHUNK:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def phrase_counts(docs: DataFrame, length: int, known=None) -> DataFrame:
    """``lang``, ``phrase`` (of ``length`` words) and ``n``, its occurrences, from
    ``text`` and ``lang``. ``known`` is a broadcast bitmap of frequent words (pairs)
    or of frequent pairs (triples): phrases with other parts are left out."""
    rows = docs.select(
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
    )

    def count(batches):
        bitmap = None if known is None else known.value
        found: dict[str, _Counter] = {}
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).fill_null(b"")
            langs = batch.column(1).dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in found:
                    found[lang] = _Counter(lang, length, bitmap)
                mine = (t.as_py() for t in texts.filter(pa.array(codes == code)))
                for chunk in _chunks(mine):
                    yield from found[lang].add(chunk)
                # the next batch may be any other text
                found[lang].tail = found[lang].tail[:0]
            while sum(c.weight() for c in found.values()) > _SPACE:
                largest = max(found, key=lambda k: found[k].weight())
                yield from found.pop(largest).close()
        for counter in found.values():
            yield from counter.close()

    runs = rows.mapInArrow(count, "lang string, prefix long, phrase string, n long")
    # by prefix, and all of a phrase together: the aggregation needs no other shuffle
    return (
        runs.repartition("lang", "prefix")
        .groupBy("lang", "prefix", "phrase")
        .agg(F.sum("n").alias("n"))
        .select("lang", "phrase", "n")
    )


def _bitmap(phrases: DataFrame):
    """A broadcast bitmap of the phrases' hashes: at most 2 ** FILTER_BITS bits."""

    def places(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = phrase.encode().split(b" ")
                hashes.append([word_hash(lang, w) for w in words])
            table = np.array(hashes, dtype=np.uint64).reshape(len(hashes), -1)
            h = table[:, 0] if table.shape[1] == 1 else pair_hash(table[:, 0], table[:, 1])
            at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    placed = phrases.select("lang", "phrase").mapInArrow(places, "at long")
    # Spark's bitmaps of 32,768 bits each
    at = F.col("at") + 1  # Spark counts positions from 1
    parts = placed.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    whole = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in parts.toLocalIterator():
        bits = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        first = (row["bucket"] - 1) * len(bits)
        whole[first : first + len(bits)] |= bits
    return phrases.sparkSession.sparkContext.broadcast(whole.tobytes())


def collocations(
    docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int | None = TOP
) -> DataFrame:
    """The phrases of two and three words that stand together more often than their
    parts explain: ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and
    ``r`` (those of the parts at its weakest cut), ``n`` (words of the language) and
    ``score``, floor(1000000 a a / (l r)).

    Every language's first ``top`` (None: all), by score, occurrences and text. NULL
    text is empty, NULL ``lang`` is ``und``; equal rows count each; ties are broken by
    the text's bytes. A language without candidates, or an empty table, gives no row.
    Other columns of ``docs`` are ignored.
    """
    ones = written(phrase_counts(docs, 1), "words")
    total = ones.groupBy("lang").agg(F.sum("n").alias("n"))
    ones = ones.filter(F.col("n") >= least)
    twos = phrase_counts(docs, 2, _bitmap(ones)).filter(F.col("n") >= least)
    twos = written(twos, "pairs")
    threes = phrase_counts(docs, 3, _bitmap(twos)).filter(F.col("n") >= least)
    threes = written(threes, "triples")

    def part(first, words):
        return F.concat_ws(" ", F.slice("w", first, words))

    def counted(rows, parts, name, key):
        return rows.join(parts.select("lang", F.col("phrase").alias(key), F.col("n").alias(name)), ["lang", key])

    pairs = twos.withColumn("w", F.split("phrase", " ", -1)).select(
        "lang", "phrase", F.col("n").alias("a"), part(1, 1).alias("p1"), part(2, 1).alias("p2")
    )
    pairs = counted(counted(pairs, ones, "l1", "p1"), ones, "r1", "p2")
    triples = threes.withColumn("w", F.split("phrase", " ", -1)).select(
        "lang", "phrase", F.col("n").alias("a"),
        part(1, 1).alias("p1"), part(2, 2).alias("p23"), part(1, 2).alias("p12"), part(3, 1).alias("p3"),
    )
    hosts = triples.select("lang", F.explode(F.array_distinct(F.array("p12", "p23"))).alias("phrase"), "a")
    hosts = hosts.groupBy("lang", "phrase").agg(F.max("a").alias("host"))
    pairs = pairs.join(hosts, ["lang", "phrase"], "left").filter(
        F.col("host").isNull() | (F.col("host") * 100 < F.col("a") * inside)
    )
    triples = counted(counted(triples, ones, "l1", "p1"), twos, "r1", "p23")
    triples = counted(counted(triples, twos, "l2", "p12"), ones, "r2", "p3")

    def cut(k):
        # exact: at most 38 digits, and Spark's integral division of decimals
        value = F.expr(
            f"cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast({SCALE} as decimal(7,0))"
            f" div (cast(l{k} as decimal(15,0)) * cast(r{k} as decimal(15,0)))"
        )
        return F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))

    scored = pairs.select("lang", "phrase", "a", cut(1).alias("c")).unionByName(
        triples.select("lang", "phrase", "a", F.least(cut(1), cut(2)).alias("c"))
    )
    scored = scored.select("lang", "phrase", "a", "c", (-F.col("c.score")).alias("_s"), (-F.col("a")).alias("_a"))
    order = ["_s", "_a", "phrase"]
    if top is None:
        ranked = with_rank(scored, order, ["lang"])
    else:
        # a language's first are first in their slot; slots spread a large language
        slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slot = F.pmod(F.xxhash64("phrase"), F.lit(slots))
        first = Window.partitionBy("lang", slot).orderBy(*order)
        ranked = scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        ranked = ranked.filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(total, "lang").select(
        "lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n",
        F.col("c.score").alias("score"),
    )
