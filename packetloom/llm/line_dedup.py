"""Line deduplication within a few edits, in DataFrame operations alone.

Two lines within ``edits`` edits share one of ``edits + 1`` segments of the shorter
one, at a place that moves by at most as many characters. So every line is entered
by its own segments, and probes, for the lengths it may be matched with, the
substrings that such a segment could be. All lengths of a span are cut alike, by its
least length, so one probe serves them all. Segments and probes meet by a 64-bit hash
of segment number, span and characters.

Segments of short lines would be a character or two. Pairs with a line below
``SPLIT`` characters meet by their deletion neighbourhoods instead: two lines within
``edits`` edits share a text that each gives by at most as many deletions.

Only hashes are shuffled for the search; texts follow for the few lines whose
hash met another line. Candidates must agree in letter counts (an edit moves each
by one at most), which also splits groups that one segment makes large, and are
verified by a banded bit-parallel edit distance: one bit a diagonal, one word of
bits for each number of edits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.session import written

EDITS = 2
#: a floor that callers may set: shorter lines (in characters) are equal or
#: different, never near; 0 links lines of any length
LEAST_CHARS = 24
#: pairs with a shorter line meet by deletions, the others by segments
SPLIT = 12
#: probe keys that are broadcast; beyond it they are joined by a shuffle
_BROADCAST_KEYS = 1_000_000
_BLANKS = " \t\x0b\x0c\r"
# Letters whose counts near lines nearly share, one by one: `replace` of
# a single letter is far cheaper than `translate` of a class.
_LETTERS = " etaoinr"
_SEGMENT, _PROBE = 1, 2
#: characters of the unequal middles that are stepped through first
_FIRST = 16


def _trimmed(raw: Column) -> Column:
    """The text without outer blanks. Few texts have any, and trimming by a set of
    characters lays out every text first."""
    outer = [f(raw, F.lit(c)) for c in _BLANKS for f in (F.startswith, F.endswith)]
    return F.when(reduce(or_, outer), F.btrim(raw, F.lit(_BLANKS))).otherwise(raw)


def with_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: ``doc_id``, ``doc_key``, ``line_no`` (from 0,
    counting all lines), ``line`` (without outer blanks)."""
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc_key"), text.alias("t"))
    # trimmed before they become rows: later filters would trim each line again
    parts = F.transform(F.split("t", "\n", -1), _trimmed)
    lines = keyed.select("doc_id", "doc_key", F.posexplode_outer(parts).alias("line_no", "line"))
    return lines.filter(F.col("line") != "")


def probe_offsets(edits: int, least: int = 0) -> list[tuple[int, int]]:
    """(segment, shift) of every substring that a line has to probe among the segments
    of lines shorter by ``least`` to ``edits`` characters. Segments of the first half lie
    at a distance from the beginning, those of the second half from the end."""
    out = set()
    for less in range(least, edits + 1):
        for i in range(edits + 1):
            low = max(-i, less - (edits - i))
            high = min(i, less + (edits - i))
            out |= {(i, shift - (less if 2 * i > edits else 0)) for shift in range(low, high + 1)}
    return sorted(out, key=lambda x: (x[1] != 0, x))


def _span(size: Column, edits: int, least: int) -> Column:
    """The least length of the span that ``size`` lies in. Lines of a span are cut alike,
    so a line probes once for all lengths of a span."""
    unit = max(edits, 1)
    width = F.when(size < 32 * unit, 2 * unit).otherwise(8 * unit)
    return F.greatest(size - size % width, F.lit(least))


def _keys(line: Column, size: Column, span: Column, edits: int, least: int = 0) -> list[Column]:
    """Hashes of the substrings of ``probe_offsets``; the line's own segments come first."""
    made = []
    for i, shift in probe_offsets(edits, least):
        begin, end = (F.floor(span * j / (edits + 1)).cast("int") for j in (i, i + 1))
        at = begin + (size - span if 2 * i > edits else F.lit(0)) + (shift + 1)
        made.append(F.xxhash64(F.lit(i), span, F.substring(line, at, end - begin)))
    return made


def _entered(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """``id`` (hash of the line), ``line``, ``key``, ``role`` of all lines that can
    be near another."""
    line, size, span, before = (F.col(c) for c in ("line", "size", "span", "before"))
    long = lines.select("line", F.length("line").alias("size")).filter(size >= least)
    long = long.withColumn("span", _span(size, edits, least))
    long = long.withColumn("before", _span(span - 1, edits, least))
    own = _keys(line, size, span, edits)
    # the first lengths of a span also meet the last ones of the span before
    keys = F.array(*own)
    for less in range(1, edits + 1):
        both = F.array(*own, *_keys(line, size, before, edits, less))
        keys = F.when((size - span == less - 1) & (span > least), both).otherwise(keys)
    keyed = long.select(F.xxhash64("line").alias("id"), "line", keys.alias("keys"))
    role = F.when(F.col("i") <= edits, _SEGMENT | _PROBE).otherwise(_PROBE)
    return keyed.select("id", "line", F.posexplode_outer("keys").alias("i", "key")).select(
        "id", "line", "key", role.alias("role")
    )


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether the texts of two columns are at most ``edits`` edits apart.

    Bit ``edits + d`` of word e is set if, after j characters of ``b``, the first
    j + d characters of ``a`` can be reached with e edits. Per character the
    words move at once: a match keeps a diagonal; a changed character keeps it
    at one edit more; one only in ``b`` moves down a bit, one only in ``a`` up.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = [(full >> (edits - e)) & ~((1 << edits) - 1) & full for e in range(edits + 1)]
    match = " + ".join(
        f"case when get(t.x, q.j + {d}) = q.c then {1 << (d + edits)} else 0 end"
        for d in range(-edits, edits + 1)
    )
    # words r0..rk before the character, m the diagonals on which it matches
    words = ["s.r0 & m"] + [
        f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1)) & {full}"
        for e in range(1, edits + 1)
    ]
    moved = _bound(f"array({match})", "m", _struct(words))
    # a character only in a: the word with one edit more takes the next bit up
    for e in range(1, edits + 1):
        fields = [f"n.r{k}" for k in range(edits + 1)]
        fields[e] = f"(n.r{e} | shiftleft(n.r{e - 1}, 1)) & {full}"
        moved = _bound(f"array({moved})", "n", _struct(fields))
    # without a diagonal left nothing can be reached any more
    reached = (
        "aggregate(transform(t.y, (c, j) -> struct(c, j)), "
        f"{_struct(start)}, (s, q) -> if(s.r{edits} = 0, s, {moved})).r{edits}"
    )
    end = f"shiftleft(1, size(t.x) - size(t.y) + {edits})"
    close = f"abs(size(t.x) - size(t.y)) <= {edits} and ({reached} & {end}) > 0"
    # equal beginnings and ends cost no edits and need no steps; their length is found
    # by halving steps
    step = "h + shiftleft(1, p)"
    shared = (
        f"aggregate(sequence(30, 0), 0, (h, p) -> if({step} <= w.n, "
        f"if({{side}}(w.x, {step}) = {{side}}(w.y, {step}), {step}, h), h))"
    )
    measured = (
        f"struct(w.x as x, w.y as y, {shared.format(side='left')} as head, "
        f"{shared.format(side='right')} as tail, w.n as n)"
    )
    rest = "length(v.{0}) - v.head - least(v.tail, v.n - v.head)"

    def cut(name: str, most: str) -> str:
        # a split by '' ends with an empty string
        part = f"substring(v.{name}, v.head + 1, {most.format(rest.format(name))})"
        return _bound(f"array({part})", "p", "slice(split(p, ''), 1, length(p))")

    middle = f"struct({cut('x', '{0}')} as x, {cut('y', '{0}')} as y)"
    # most pairs leave every diagonal within a few characters
    few = f"struct({cut('x', f'least({{0}}, {_FIRST + edits})')} as x, {cut('y', f'least({{0}}, {_FIRST})')} as y)"
    alive = _bound(f"array({few})", "t", reached)
    verdict = f"if({alive} > 0, {_bound(f'array({middle})', 't', close)}, false)"
    texts = _bound(f"array(struct({a} as x, {b} as y, least(length({a}), length({b})) as n))", "w", measured)
    return F.expr(_bound(f"array({texts})", "v", verdict))


def _struct(values: list) -> str:
    return "named_struct(" + ", ".join(f"'r{e}', {v}" for e, v in enumerate(values)) + ")"


def _bound(array: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for the only element of ``array``."""
    return f"transform({array}, {name} -> {body})[0]"


def _deletions(line: str, edits: int) -> str:
    """SQL for the distinct texts that at most ``edits`` deletions leave of a line."""
    one = "transform(sequence(1, length({0})), i -> concat(left({0}, i - 1), substring({0}, i + 1)))"
    out = f"array({line})"
    for _ in range(edits):
        fewer = f"flatten(transform({out}, w -> if(w = '', array(w), {one.format('w')})))"
        out = f"array_distinct(concat({out}, {fewer}))"
    return out


def short_links(lines: DataFrame, edits: int, least: int, split: int) -> DataFrame:
    """``a``, ``b``: distinct lines (a < b) at most ``edits`` edits apart, both of ``least``
    characters or more and one of fewer than ``split``. Every such pair, once."""
    short = lines.select("line").filter(F.length("line").between(least, split - 1 + edits)).distinct()
    entered = short.select("line", F.explode(F.expr(_deletions("line", edits))).alias("left")).select(
        F.xxhash64("left").alias("key"), "line"
    )
    met = entered.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    live = written(entered.join(met.filter("low <> high").select("key"), "key", "left_semi"), "short")
    pairs = live.withColumnRenamed("line", "a").join(live.withColumnRenamed("line", "b"), "key")
    near = (
        (F.col("a") < F.col("b"))
        & (F.abs(F.length("a") - F.length("b")) <= edits)
        & (F.least(F.length("a"), F.length("b")) < split)
    )
    return pairs.filter(near).select("a", "b").distinct().filter(within_edits("a", "b", edits))


def near_links(lines: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """``a``, ``b``: distinct lines (texts, a < b) at most ``edits`` edits apart, both
    of ``least`` characters or more (0: of any length). Every such pair, once."""
    # segments keep a few characters
    split = max(SPLIT, 3 * (edits + 1))
    if least >= split:
        return _long_links(lines, edits, least)
    long = _long_links(lines, edits, split)
    return long.unionByName(short_links(lines, edits, least, split))


def _long_links(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """Links of lines of ``least`` characters or more, by segments."""
    entered = _entered(lines, edits, least)
    met = (
        entered.groupBy("key")
        .agg(
            F.min("id").alias("low"),
            F.max("id").alias("high"),
            F.bit_or("role").alias("roles"),
        )
        .filter(f"low <> high and roles & {_SEGMENT} > 0")
        .select("key")
    )
    met = written(met, "met")
    if met.count() <= _BROADCAST_KEYS:
        live = entered.join(F.broadcast(met), "key", "left_semi").distinct()
    else:
        # keys are shuffled alone; each line's text follows once, not once a key
        hits = entered.select("key", "id", "role").join(met, "key", "left_semi").distinct()
        hits = written(hits, "hits")
        texts = lines.select(F.xxhash64("line").alias("id"), "line").filter(F.length("line") >= least)
        live = hits.join(texts.join(hits.select("id"), "id", "left_semi").distinct(), "id")
    counts = [
        (F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))).alias(f"n{i}")
        for i, c in enumerate(_LETTERS)
    ]
    # counted once a row, before the table is read for both sides
    live = live.select("key", "id", "line", "role", F.length("line").alias("size"), *counts)
    live = written(live, "live")
    # a longer or equally long line looks for shorter ones; letter counts may differ by
    # an edit each, so segments are laid out for all neighbouring counts
    left = live.filter(F.col("role") == (_SEGMENT | _PROBE)).select(
        "key", F.explode(F.sequence(F.col("n0") - edits, F.col("n0") + edits)).alias("n0"),
        F.col("line").alias("a"), F.col("size").alias("a_size"),
        *[F.col(f"n{i}").alias(f"a{i}") for i in range(1, len(_LETTERS))],
    )
    right = live.select(
        "key", "n0", F.col("line").alias("b"), F.col("size").alias("b_size"),
        *[F.col(f"n{i}").alias(f"b{i}") for i in range(1, len(_LETTERS))],
    )
    close = [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= edits for i in range(1, len(_LETTERS))]
    condition = (
        (left["key"] == right["key"])
        & (left["n0"] == right["n0"])
        & (F.col("b_size") - F.col("a_size")).between(0, edits)
        & (F.col("a") != F.col("b"))
    )
    for c in close:
        condition = condition & c
    # the distance stands last, so it is taken only where all counts agree; pairs that
    # are too far apart do not leave the join
    pairs = left.join(right, condition & within_edits("a", "b", edits))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _line_id(line: str) -> Column:
    return F.md5(F.encode(line, "UTF-8"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = 0) -> DataFrame:
    """Lines that are repeated or near another: ``line_id``, ``first`` (smallest
    document, key and line number of its class), ``n_links`` (near lines)."""
    lines = with_lines(docs)
    links = written(near_links(lines, edits, least), "near").select(
        _line_id("a").alias("a"), _line_id("b").alias("b")
    )
    degree = (
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .groupBy(F.col("a").alias("line_id"))
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    roots = components(links).withColumnRenamed("node", "line_id")
    near = written(roots.join(degree, "line_id"), "near-lines")
    place = F.struct(F.col("doc_id").alias("d"), F.col("doc_key").alias("k"), F.col("line_no").alias("n"))
    each = lines.groupBy(_line_id("line").alias("line_id")).agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")
    )
    beside = each.join(near, "line_id", "left").filter("n > 1 or root is not null")
    beside = written(beside.withColumn("root", F.coalesce("root", "line_id")), "classes")
    least_place = beside.groupBy("root").agg(F.min("first").alias("first"))
    return beside.drop("first").join(least_place, "root").select(
        "line_id", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def line_verdicts(docs: DataFrame, edits: int = EDITS, least: int = 0) -> DataFrame:
    """Per document (``doc_id``, ``doc_key``): ``removed``, the numbers of lines
    that repeat or nearly repeat an earlier one, and ``n_links`` of its lines.
    Documents without repeated or near lines are absent."""
    classes = written(line_classes(docs, edits, least), "line-classes")
    occurrences = with_lines(docs).select(
        "doc_id", "doc_key", "line_no", _line_id("line").alias("line_id")
    )
    found = occurrences.join(classes, "line_id")
    again = ~(
        F.col("first.d").eqNullSafe(F.col("doc_id"))
        & (F.col("first.k") == F.col("doc_key"))
        & (F.col("first.n") == F.col("line_no"))
    )
    return found.groupBy("doc_id", "doc_key").agg(
        F.array_sort(F.collect_set(F.when(again, F.col("line_no")))).alias("removed"),
        F.sum("n_links").alias("n_links"),
    )


def with_removed_lines(
    docs: DataFrame, edits: int = EDITS, least: int = 0, keep: Sequence[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` (as the struct ``row``, of the columns in ``keep`` if
    given) with ``removed`` and ``n_links``.

    A line is removed if an earlier one (by ``doc_id``, NULL first, then text
    hash and line number) is equal or connected to it by steps of ``edits`` edits
    or less. Lines without a word are neither counted nor removed. Rows equal in
    ``doc_id`` and ``text`` are one document. NULL and empty texts have no lines.
    """
    verdicts = line_verdicts(docs.select("doc_id", "text"), edits, least)
    named = verdicts.select(F.col("doc_key").alias("_key"), F.col("doc_id").alias("_id"), "removed", "n_links")
    held = F.struct(*([F.col(f"`{c}`") for c in keep] if keep else ["*"]))
    rows = docs.select(
        held.alias("row"),
        F.col("doc_id").alias("_doc"),
        F.xxhash64("doc_id", F.col("text").cast("string")).alias("_k"),
    )
    joined = rows.join(named, (F.col("_k") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        "row",
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """The documents without their removed lines; all rows stay."""
    found = with_removed_lines(docs, edits, least)
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    return found.select(
        *[kept if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    ).toDF(*docs.columns)
