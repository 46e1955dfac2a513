"""Repair of conversation structure by lightest derivations.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles. An item
``(p, j, q)`` says that the first j rows of a stretch lead from state p to state q; its
weight is the cost of the edits and their text, the audit. Keeping, re-roling or
deleting the next row and inserting a turn are deductions from one item; two
neighbouring stretches are one deduction from two items. All of them are superior
functions: a result is never lighter than what it follows from, and lighter parts
give lighter results. So an agenda that pops the lightest item finalises it, and
stops when the goal is popped (Knuth's generalisation of Dijkstra's method).

Rows are dealt by range along (conversation, turn), so a conversation of any length
lies in several tasks; each reduces its stretch to the weights from every state to
every state. Only the first and last conversation of a task can go on elsewhere:
these are joined, two stretches a task at most.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordering import default_buckets
from packetloom.session import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: rows that one agenda takes
PIECE = 512

# states: nothing yet, after the system turn, after a user, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
COMPLETE = (START, ASSISTANT)

Row = tuple[str, bool, bool]  # initial, to be deleted, truncated
Weights = dict[int, tuple[int, str]]


def _deductions(item: tuple[int, int], rows: list[Row]) -> Iterator[tuple[int, str, int, int]]:
    """What follows from having read j rows in state q: cost, edit, rows read, state."""
    j, q = item
    for initial, state in NEXT[q].items():
        if initial in ROLES:
            yield INSERT_COST, INSERT, j, state
    if j < len(rows):
        initial, gone, truncated = rows[j]
        yield DELETE_COST, DELETE, j + 1, q
        if not gone:
            extra = TRUNCATED_COST * truncated
            if initial in NEXT[q]:
                yield extra, KEEP, j + 1, NEXT[q][initial]
            for role, state in NEXT[q].items():
                if role in ROLES:
                    yield REROLE_COST + extra, REROLE, j + 1, state


def lightest(rows: list[Row], start: int = START, goal: bool = False) -> Weights:
    """The lightest (cost, audit) from ``start`` over all rows to every state that can be
    reached; with ``goal`` only to the first complete one.

    Items of one cost are popped in the order of the rows read: a step without a
    cost reads one, so no item comes before what it follows from.
    """
    agenda = [(0, 0, "", start)]
    final: set[tuple[int, int]] = set()
    out: Weights = {}
    while agenda:
        cost, j, audit, q = heapq.heappop(agenda)
        if (j, q) in final:
            continue
        final.add((j, q))
        if j == len(rows):
            out[q] = (cost, audit)
            if goal and q in COMPLETE or len(out) == len(NEXT):
                break
        for more, edit, k, state in _deductions((j, q), rows):
            if (k, state) not in final:
                heapq.heappush(agenda, (cost + more, k, audit + edit, state))
    return {q: w for q, w in out.items() if not goal or q in COMPLETE}


def joined(left: Weights, right: dict[int, Weights]) -> Weights:
    """Weights over two neighbouring stretches; ``right`` by its first state."""
    out: Weights = {}
    for p, (cost, audit) in left.items():
        for q, (more, rest) in right.get(p, {}).items():
            weight = (cost + more, audit + rest)
            if q not in out or weight < out[q]:
                out[q] = weight
    return out


class _Stretch:
    """Consecutive rows of one conversation: its figures, and weights between states."""

    def __init__(self, whole: bool):
        self.weights = {p: {p: (0, "")} for p in ((START,) if whole else NEXT)}
        self.rows: list[Row] = []
        self.folded = False
        self.first, self.last, self.illegal = None, None, 0
        self.low, self.high, self.turns = None, None, 0
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.rows.append((initial, blank or duplicate, truncated))
        if len(self.rows) == PIECE:
            self.fold()

    def fold(self) -> None:
        table = {p: lightest(self.rows, p) for p in NEXT}
        self.weights = {p: joined(w, table) for p, w in self.weights.items()}
        self.rows, self.folded = [], True

    def close(self, more: bool) -> list[dict]:
        """The weights; ``more``: another stretch may follow or come before."""
        if self.folded or more:
            self.fold()
        else:
            self.weights = {START: lightest(self.rows, goal=True)}
        return [
            {"p": p, "q": q, "cost": cost, "audit": audit}
            for p, found in self.weights.items()
            for q, (cost, audit) in found.items()
        ]


_FIGURES = ("first", "last", "illegal", "low", "high", "turns", "blank", "duplicate", "truncated")
_WEIGHTS = "array<struct<p: int, q: int, cost: long, audit: string>>"
_STRETCH = (
    "first string, last string, illegal long, low long, high long, turns long, blank long, "
    f"duplicate long, truncated long, weights {_WEIGHTS}"
)


def _arrow(conv: pa.DataType) -> pa.Schema:
    text, whole = pa.string(), pa.int64()
    kinds = [text, text, *[whole] * 7]
    weights = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", whole), ("audit", text)]))
    return pa.schema(
        [("conv_id", conv), ("part", pa.int32()), ("edge", pa.bool_()), *zip(_FIGURES, kinds), ("weights", weights)]
    )


def with_faults(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (``conv_id``, ``turn``, ``role``, ``text``; NULL role or text: one
    space) with their place in order (``turn``, NULL first, ties by ``role``, ``digest``
    and ``n``) and their first fault: ``blank``, ``duplicate`` or ``truncated``. Written."""
    one = F.lit(" ")
    role, text = F.coalesce(F.col("role"), one), F.coalesce(F.col("text"), one)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = written(rows.withColumn("digest", digest).withColumn("n", F.monotonically_increasing_id()), "turns")
    # one row of each text is the first; joined by its own number, however often it is said
    first = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "n")).alias("f"))
    first = first.select(F.col("f.n").alias("n"), F.lit(True).alias("first"))
    shown = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", "")
    blank = F.length(shown) == 0
    duplicate = ~blank & F.col("first").isNull()
    truncated = ~blank & ~duplicate & ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    return rows.join(first, "n", "left").select(
        "conv_id", "turn", "role", "text", "digest", "n",
        blank.alias("blank"), duplicate.alias("duplicate"), truncated.alias("truncated"),
    )


def _stretches(faults: DataFrame, buckets: int | None) -> DataFrame:
    order = ["conv_id", "turn", "role", "digest", "n"]
    dealt = faults.select(*order, F.substring("role", 1, 1).alias("i"), "blank", "duplicate", "truncated")
    dealt = dealt.repartitionByRange(buckets or default_buckets(faults), *order).sortWithinPartitions(*order)
    dealt = dealt.select(
        "conv_id", F.spark_partition_id().alias("part"), "turn", "i", "blank", "duplicate", "truncated"
    )
    kind = faults.schema["conv_id"].dataType.simpleString()

    def reduce(batches):
        now, stretch, part, conv = None, None, None, None
        ready: list[dict] = []
        seen = 0

        def closed(last: bool) -> None:
            edge = last or seen == 1
            row = {name: getattr(stretch, name) for name in _FIGURES}
            ready.append({"conv_id": now[0], "part": part, "edge": edge, **row, "weights": stretch.close(edge)})

        for batch in batches:
            conv = batch.schema.field(0).type
            for key, part_, *rest in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if now is None or now[0] != key:
                    if now is not None:
                        closed(False)
                    now, part, seen = (key,), part_, seen + 1
                    # the first one may have begun in another task
                    stretch = _Stretch(whole=seen > 1)
                stretch.add(*rest)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, _arrow(conv))
                ready = []
        if now is not None:
            closed(True)
            yield pa.RecordBatch.from_pylist(ready, _arrow(conv))

    return dealt.mapInArrow(reduce, f"conv_id {kind}, part int, edge boolean, {_STRETCH}")


_REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _final(weights: Weights) -> tuple[int, str]:
    return min(w for q, w in weights.items() if q in COMPLETE)


def repairs(faults: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per ``conv_id`` of ``with_faults``: ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (pairs of neighbouring roles), and the ``cost`` and ``audit`` of the cheapest
    edits, ties to the least audit. A conversation without rows is absent."""
    parts = written(_stretches(faults, buckets), "stretches")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    # complete within one task: the lightest of the weights that end complete
    goal = F.filter("weights", lambda w: (w["p"] == START) & w["q"].isin(*COMPLETE))
    best = F.array_min(F.transform(goal, lambda w: F.struct(w["cost"], w["audit"])))
    inner = parts.filter("not edge").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        best["cost"].alias("cost"), best["audit"].alias("audit"),
    )
    kind = parts.schema["conv_id"].dataType.simpleString()

    def merge(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["part"])
        weights: Weights = {START: (0, "")}
        total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        last, low, high, distinct = None, None, None, 0
        for row in found:
            right: dict[int, Weights] = {}
            for w in row["weights"]:
                right.setdefault(w["p"], {})[w["q"]] = (w["cost"], w["audit"])
            weights = joined(weights, right)
            for name in total:
                total[name] += row[name]
            if last is not None and last + row["first"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            last = row["last"]
            if row["high"] is not None:
                distinct += row["turns"] - (row["low"] == high)
                low = row["low"] if low is None else low
                high = row["high"]
        cost, audit = _final(weights)
        gap = 0 if high is None else high - low + 1 - distinct
        out = {"conv_id": found[0]["conv_id"], "gaps": gap, **total, "cost": cost, "audit": audit}
        fields = [(n, pa.int64()) for n in ("gaps", *total, "cost")]
        schema = pa.schema([("conv_id", table.schema.field("conv_id").type), *fields, ("audit", pa.string())])
        return pa.Table.from_pylist([out], schema)

    # at most two rows a task come here
    edges = parts.filter("edge").groupBy("conv_id").applyInArrow(merge, f"conv_id {kind}, {_REPAIR}")
    return inner.unionByName(edges)


def repaired_turns(faults: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``position`` (from 0), ``role``, ``text`` and
    ``edit``. Inserted turns have no text. The rows of a conversation lie one after
    another in one partition and are passed through, not collected."""
    order = ["turn", "role", "digest", "n"]
    rows = faults.select("conv_id", F.lit(1).alias("kind"), *order, "text")
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order],
        F.col("audit").alias("text"),
    )
    # the audit stands before its conversation's rows
    dealt = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order)
    dealt = dealt.select("conv_id", "kind", "role", "text")
    kind = faults.schema["conv_id"].dataType.simpleString()

    def apply(batches):
        audit, at, position, odd, conv = "", 0, 0, 0, None
        for batch in batches:
            out: list[tuple] = []

            def put(role, text, edit):
                nonlocal position
                if role is None:
                    role = ROLES["ua"[(position - odd) % 2]]
                out.append((conv, position, role, text, edit))
                position += 1

            def inserts():
                nonlocal at
                while at < len(audit) and audit[at] == INSERT:
                    put(None, "", INSERT)
                    at += 1

            for key, what, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if what == 0:
                    conv, audit, at, position = key, text, 0, 0
                    # an odd number of turns begins with the system's
                    odd = (len(audit) - audit.count(DELETE)) % 2
                    inserts()
                    continue
                edit = audit[at]
                at += 1
                if edit != DELETE:
                    put(role if edit == KEEP else None, text, edit)
                inserts()
            names = ["conv_id", "position", "role", "text", "edit"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return dealt.mapInArrow(apply, f"conv_id {kind}, position long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``: the hash of each conversation's ``role:text``,
    joined by newlines, from ``repaired_turns``."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def hashed(batches):
        now, running, conv = None, None, None
        for batch in batches:
            conv = batch.schema.field(0).type
            keys, ready = [], []
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                line = f"{role}:{text}".encode()
                if now == (key,):
                    running.update(b"\n" + line)
                    continue
                if now is not None:
                    keys.append(now[0])
                    ready.append(running.hexdigest())
                now, running = (key,), hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, conv), pa.array(ready, pa.string())], ["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]], conv), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"]
            )

    return turns.select("conv_id", "role", "text").mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every ``conv_id`` of ``conversations`` (distinct, NULL among them) with the figures of
    ``repairs`` and ``repaired_sha256``. A conversation without a row in ``turns`` has
    zeros, an empty audit and the hash of the empty text. Empty tables give no row. Repeated rows are duplicates; other columns are ignored."""
    faults = written(with_faults(turns), "faults")
    found = written(repairs(faults, buckets), "repairs")
    texts = digests(repaired_turns(faults, found))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = conversations.select("conv_id").distinct()
    for table in (found, texts):
        renamed = table.withColumnRenamed("conv_id", "_conv")
        ids = ids.join(renamed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return ids.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
