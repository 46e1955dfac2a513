"""Lines of any length are linked when no floor is given."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.llm import line_dedup
from packetloom.llm.line_dedup import near_links, with_removed_lines


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("broadcast_keys", [line_dedup._BROADCAST_KEYS, 0])
def test_short_lines_are_linked(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(line_dedup, "_BROADCAST_KEYS", broadcast_keys)
    rng = random.Random(3)
    lines = {"a", "b", "ab", "\u00e9t\u00e9"}
    for _ in range(60):
        base = [rng.choice("abcdefgh \u00e9") for _ in range(rng.randint(1, 27))]
        for _ in range(4):
            copy = base[:]
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
            lines.add("".join(copy).strip())
    lines = sorted(lines - {""})
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    want = {(a, b) for i, b in enumerate(lines) for a in lines[:i] if _distance(a, b) <= 2}
    got = [(r.a, r.b) for r in near_links(frame, least=0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_short_line_with_one_letter_changed_is_removed(make_docs):
    line = "all rights are reserved"
    docs = make_docs([line, line.replace("all", "alt")])
    assert {r.row.doc_id: r.removed for r in with_removed_lines(docs).collect()} == {0: [], 1: [0]}


def test_distance_of_long_lines_that_begin_and_end_alike(spark):
    rng = random.Random(8)
    pairs = [("", ""), ("", "ab"), ("aaaa", "aa"), ("abab", "ab"), ("a" * 300, "a" * 302), ("a" * 300, "a" * 303)]
    for _ in range(150):
        a = [rng.choice("ab é漢😀") for _ in range(rng.randint(0, 300))]
        b = a[:]
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "😀"])
        pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    near = F.levenshtein("a", "b") <= 2
    both = frame.select(line_dedup.within_edits("a", "b", 2).alias("got"), near.alias("want")).collect()
    assert [r.got for r in both] == [r.want for r in both]
    assert 20 < sum(r.want for r in both) < len(pairs) - 20


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_around_the_bounds_of_spans_are_linked(spark, edits):
    rng = random.Random(edits)
    lines = set()
    for size in [*range(10, 27), *range(32 * edits - 4, 32 * edits + 4), *range(40 * edits - 4, 40 * edits + 4)]:
        base = [rng.choice("abcdefgh é漢") for _ in range(size)]
        lines.add("".join(base))
        # edits at both ends, in the middle and anywhere, that lengthen, keep or shorten
        for spots in ([0, -1], [0, 0], [-1, -1], [size // 2, -1], [0, size // 2], [None, None, None, None]):
            copy = base[:]
            for spot in spots[: edits + 1]:
                at = rng.randrange(len(copy)) if spot is None else spot % len(copy)
                copy[at : at + rng.randrange(2)] = rng.choice(["", "x", "漢"])
            lines.add("".join(copy))
    lines = sorted(x for x in lines if x)
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    want = {(a, b) for i, b in enumerate(lines) for a in lines[:i] if _distance(a, b) <= edits}
    got = [(r.a, r.b) for r in near_links(frame, edits, least=0).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_a_line_probes_once_for_a_span_of_lengths(spark):
    lines = spark.range(12, 400).select(F.repeat(F.lit("é"), F.col("id").cast("int")).alias("line"))
    entered = line_dedup._entered(lines, 2, 12)
    # a probe for each length and shift made 12 keys a line
    counts = [r["count"] for r in entered.groupBy("id").count().collect()]
    assert len(counts) == 388 and min(counts) == 5 and max(counts) <= 9 and sum(counts) < 7 * len(counts)
    assert entered.filter("key is null").isEmpty()


def test_lines_are_trimmed_once_and_keep_their_numbers(spark):
    blanks = " \t\x0b\x0c\r"
    texts = ["", None, "\n", " a \n\n\tb", "\x0bc\x0c\r\n  d  \n  ", "e f", "　"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = line_dedup.with_lines(docs)
    want = {
        (i, n, x.strip(blanks)) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip(blanks)
    }
    assert {(r.doc_id, r.line_no, r.line) for r in frame.collect()} == want
    # a length filter does not trim again
    plan = frame.filter(F.length("line") > 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1


def test_rows_hold_only_the_columns_asked_for(make_docs):
    found = with_removed_lines(make_docs(["one line\none line", None]), keep=("doc_id",))
    assert {tuple(r.row.asDict().items()): r.removed for r in found.collect()} == {
        (("doc_id", 0),): [1], (("doc_id", 1),): []
    }
