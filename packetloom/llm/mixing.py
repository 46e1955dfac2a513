"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are summed by membership pattern;
a flow routes each pattern's words to the quotas of its sources, where repeating
a pattern costs more with every repetition. Then documents are selected in a
seeded hash order until each pattern's flow is met.

Only sums per pattern reach the driver. Their number is checked against
``MAX_PATTERNS``; it follows the sources of the mix, not the documents.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import written

MAX_PATTERNS = 50_000
MAX_REPEATS = 3
_KEY_BITS = 62
_SLICE_BITS = 12
#: documents that the last, exact step of a pattern looks at
_BOUNDARY = 1024
#: documents a pattern may add after it to end nearer to its flow
_NEAREST = 6

Source = str | None


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def ordered_sources(sources: Sequence[Source]) -> list[Source]:
    """By code point, NULL last."""
    return sorted(set(sources), key=lambda s: (s is None, s or ""))


def cyclic_weights(sources: Sequence[Source]) -> dict[Source, float]:
    """Weights 1, 2, 3, repeating, in source order."""
    return {s: float(1 + i % 3) for i, s in enumerate(ordered_sources(sources))}


def target_words(
    sizes: dict[Source, int], weights: dict[Source, float], total: float, repeats: int = MAX_REPEATS
) -> dict[Source, float]:
    """Shares of ``total`` by weight; none above ``repeats`` times its source,
    the excess is shared again by weight."""
    left, open_ = float(total), ordered_sources(list(sizes))
    out: dict[Source, float] = dict.fromkeys(open_, 0.0)
    while open_:
        whole = sum(weights[s] for s in open_)
        if whole <= 0:
            break
        share = {s: left * weights[s] / whole for s in open_}
        above = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in above]
    return out


class _Network:
    """Min-cost flow by successive cheapest paths; integer capacities."""

    def __init__(self):
        self.out: list[list[int]] = []
        self.ends: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.ends))
            self.ends.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.ends) - 2

    def _cheapest(self, source: int, sink: int) -> list[int] | None:
        best: dict[int, int] = {source: 0}
        via: dict[int, int] = {}
        queue, queued = deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for arc in self.out[a]:
                b = self.ends[arc]
                if self.room[arc] and best[a] + self.cost[arc] < best.get(b, 1 << 62):
                    best[b], via[b] = best[a] + self.cost[arc], arc
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if sink not in via:
            return None
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = self.ends[via[at] ^ 1]
        return path

    def fill(self, source: int, sink: int) -> None:
        while path := self._cheapest(source, sink):
            amount = min(self.room[a] for a in path)
            for a in path:
                self.room[a] -= amount
                self.room[a ^ 1] += amount


def route(
    patterns: dict[tuple[Source, ...], int], targets: dict[Source, float], repeats: int = MAX_REPEATS
) -> dict[tuple[Source, ...], dict[Source, int]]:
    """Words of each pattern that go to each of its sources.

    Repetition k of a pattern costs k squared a word, so words are repeated
    evenly before any is used again and again.
    """
    net = _Network()
    begin, end = net.node(), net.node()
    quota = {s: net.node() for s in targets}
    for s, node in quota.items():
        net.arc(node, end, round(targets[s]), 0)
    arcs: dict[tuple, dict[Source, int]] = {}
    for pattern in sorted(patterns, key=lambda p: [(s is None, s or "") for s in p]):
        node = net.node()
        for k in range(1, repeats + 1):
            net.arc(begin, node, patterns[pattern], k * k)
        arcs[pattern] = {s: net.arc(node, quota[s], repeats * patterns[pattern], 0) for s in pattern}
    net.fill(begin, end)
    return {p: {s: net.room[a ^ 1] for s, a in found.items()} for p, found in arcs.items()}


def _key(seed: int, unit: Sequence[str]) -> Column:
    """A fixed pseudo-random number of ``_KEY_BITS`` bits per document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *unit), 64 - _KEY_BITS)


def _prefix(bits: Column) -> Column:
    """The leading ``bits`` of the key."""
    return F.call_function("shiftright", F.col("_key"), F.lit(_KEY_BITS) - bits)


def _with_extra(units: DataFrame, rest: dict[str, int], counts: dict[str, int]) -> DataFrame:
    """Rows ``_pattern``, ``_key`` of the documents that fill ``rest`` words of
    their pattern, as ``_low`` (all keys below it) and ``_more`` (single keys).

    The hash order is cut like a number: slices of the leading bits are summed,
    and only the slice in which the words run out is looked at more closely,
    until it is small. It is then filled document by document, first fit.
    """
    spark = units.sparkSession
    state = [
        (p, 0, 0, r, min(_SLICE_BITS, max(0, (counts[p] // 256).bit_length() - 1)))
        for p, r in sorted(rest.items())
    ]
    # per pattern: bits fixed so far, their value, words left to fill, bits to add
    columns = "_pattern string, _bits int, _head long, _left long, _step int"
    while True:
        table = F.broadcast(spark.createDataFrame(state, columns))
        inside = units.join(table, "_pattern").filter(_prefix(F.col("_bits")) == F.col("_head"))
        if not any(s[4] for s in state):
            break
        sliced = inside.withColumn("_slice", _prefix(F.col("_bits") + F.col("_step")))
        sums = sliced.groupBy("_pattern", "_slice", "_left", "_bits", "_step").agg(
            F.sum("_size").alias("w"), F.count_distinct("_key").alias("n")
        )
        order = Window.partitionBy("_pattern").orderBy("_slice")
        upto = sums.withColumn("upto", F.sum("w").over(order))
        # the first slice that does not fit whole; at most one a pattern
        cut = upto.filter("upto > _left and upto - w <= _left").select(
            "_pattern", (F.col("_bits") + F.col("_step")).alias("b"), "_slice",
            (F.col("_left") - F.col("upto") + F.col("w")).alias("l"), "n",
        )
        state = [
            (r["_pattern"], r["b"], r["_slice"], r["l"],
             min(_SLICE_BITS, _KEY_BITS - r["b"]) if r["n"] > _BOUNDARY else 0)
            for r in sorted(cut.collect())
        ]
        if not state:
            break
    one = inside.groupBy("_pattern", "_left", "_bits", "_head", "_key").agg(F.sum("_size").alias("w"))
    lists = one.groupBy("_pattern", "_left", "_bits", "_head").agg(
        F.array_sort(F.collect_list(F.struct("_key", "w"))).alias("docs")
    )
    return lists.select(
        "_pattern",
        F.call_function("shiftleft", "_head", F.lit(_KEY_BITS) - F.col("_bits")).alias("_low"),
        F.expr(
            "aggregate(docs, named_struct('left', _left, 'keys', cast(array() as array<bigint>)), "
            "(s, d) -> case when d.w <= s.left then named_struct('left', s.left - d.w, "
            "'keys', concat(s.keys, array(d._key))) else s end)"
        ).alias("filled"),
    ).select("_pattern", "_low", F.col("filled.keys").alias("_more"), F.col("filled.left").alias("_left"))


def _filled() -> Column:
    """1 for the documents that the hash order and first fit take once more."""
    return F.when((F.col("_key") < F.col("_low")) | F.array_contains("_more", F.col("_key")), 1).otherwise(0)


def _nearest(units: DataFrame, extra: DataFrame, bases: dict[str, int], repeats: int) -> dict[str, list[int]]:
    """Keys of documents that each pattern takes once more, to end near its flow.

    Up to ``_NEAREST`` times the largest document that fits the words still missing
    is added. Before each of them, the smallest one that would pass the flow is a
    possible end; of all the ends seen the nearest is taken, above or below. A
    document that has been taken may be repeated, but not beyond ``repeats``. Per
    pattern and turn one row reaches the driver.
    """
    spark = units.sparkSession
    left = {r["_pattern"]: r["_left"] for r in extra.select("_pattern", "_left").collect() if r["_left"]}
    added: dict[str, list[int]] = {p: [] for p in left}
    ends = {p: (w, []) for p, w in left.items()}
    for _ in range(_NEAREST):
        if not left:
            break
        state = [(p, w, bases[p], added[p]) for p, w in sorted(left.items())]
        table = spark.createDataFrame(state, "_pattern string, _open long, _base int, _again array<long>")
        both = F.broadcast(extra.drop("_left").join(table, "_pattern"))
        times = F.col("_base") + _filled() + F.size(F.filter("_again", lambda k: k == F.col("_key")))
        free = units.join(both, "_pattern").filter(times < repeats).filter("_size > 0")
        whole = free.groupBy("_pattern", "_open", "_key").agg(F.sum("_size").alias("w"))
        best = whole.groupBy("_pattern").agg(
            F.max(F.when(F.col("w") <= F.col("_open"), F.struct("w", "_key"))).alias("below"),
            F.min(F.when(F.col("w") > F.col("_open"), F.struct("w", "_key"))).alias("above"),
        )
        before, left = left, {}
        for p, below, above in best.collect():
            if above:
                ends[p] = min(ends[p], (above[0] - before[p], [*added[p], above[1]]))
            if below:
                added[p] = [*added[p], below[1]]
                ends[p] = min(ends[p], (before[p] - below[0], added[p]))
                if before[p] > below[0]:
                    left[p] = before[p] - below[0]
    return {p: keys for p, (_, keys) in ends.items() if keys}


def mix(
    docs: DataFrame,
    size: Column,
    sources: Column,
    unit: Sequence[str],
    weights: Callable[[Sequence[Source]], dict[Source, float]] = cyclic_weights,
    total: float | None = None,
    repeats: int = MAX_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``) with what the mix takes of it.

    ``size`` is a document's words, ``sources`` the array of its sources (NULL may
    be one of them), ``unit`` names the columns of ``docs`` that identify it:
    rows that agree in them are taken alike. Adds ``size``, ``times`` (whole
    repetitions, 0 to ``repeats``), ``taken`` = size * times, and ``credit``:
    source, its size, its target, and the part of ``taken`` it gets. The default
    ``total`` is the words of all documents. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = docs.select(
        F.struct("*").alias("row"),
        _key(seed, unit).alias("_key"),
        size.cast("long").alias("_size"),
        F.to_json(F.array_sort(F.array_distinct(sources.cast("array<string>")))).alias("_pattern"),
    )
    table = written(table, "mixed")
    sums = (
        table.groupBy("_pattern")
        .agg(F.sum("_size").alias("w"), F.count(F.lit(1)).alias("n"))
        .limit(MAX_PATTERNS + 1)
        .collect()
    )
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(json.loads(r["_pattern"])): r["w"] for r in sums}
    named = {tuple(json.loads(r["_pattern"])): r["_pattern"] for r in sums}
    counts = {r["_pattern"]: r["n"] for r in sums}
    sizes: dict[Source, int] = {}
    for pattern, words in patterns.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    all_words = sum(patterns.values()) if total is None else total
    targets = target_words(sizes, weights(list(sizes)), all_words, repeats)
    flows = route(patterns, targets, repeats)

    plan, rest = [], {}
    for pattern, to in flows.items():
        flow, words = sum(to.values()), patterns[pattern]
        base, left = divmod(flow, words) if words else (0, 0)
        if base >= repeats:
            base, left = repeats, 0
        if left:
            rest[named[pattern]] = left
        credit = [(s, sizes[s], targets[s], f / flow if flow else 0.0) for s, f in to.items()]
        plan.append((named[pattern], base, credit))
    kind = "array<struct<source:string,source_size:long,target:double,share:double>>"
    # one row a pattern, at most MAX_PATTERNS of them
    plans = F.broadcast(spark.createDataFrame(plan, f"_pattern string, _base int, _credit {kind}"))
    extra = _with_extra(table.select("_pattern", "_key", "_size"), rest, counts)
    extra = written(extra, "extra")  # small or not, its size is known to Spark
    bases = {pattern: base for pattern, base, _ in plan}
    again = _nearest(table.select("_pattern", "_key", "_size"), extra, bases, repeats)
    # at most one row a pattern, of at most _NEAREST keys
    once = F.broadcast(spark.createDataFrame(sorted(again.items()), "_pattern string, _again array<long>"))
    more = F.coalesce(F.size(F.filter("_again", lambda k: k == F.col("_key"))), F.lit(0))
    times = F.col("_base") + _filled() + F.when(F.col("_again").isNull(), 0).otherwise(more)
    picked = (
        table.join(plans, "_pattern")
        .join(extra, "_pattern", "left")
        .join(once, "_pattern", "left")
        .select("row", F.col("_size").alias("size"), times.alias("times"), "_credit")
        .withColumn("taken", F.col("size") * F.col("times"))
    )
    credit = F.transform(
        "_credit",
        lambda c: F.struct(
            c["source"].alias("source"),
            c["source_size"].alias("source_size"),
            c["target"].alias("target"),
            (c["share"] * F.col("taken")).alias("words"),
        ),
    )
    return picked.select("row", "size", "times", "taken", credit.alias("credit"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, by ``source``."""
    chosen = mix(
        docs, word_count(F.col("text")), F.array("source"), ["doc_id", "text"], **options
    ).filter("times > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
