"""Conversation repair against a plain search over all positions and states."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from packetloom.llm import conversation_repair as C
from packetloom.llm import queries

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("audit", T.StringType()),
    ]
)


def cheapest(rows):
    """(cost, audit, turns): rows are (role, text, gone, truncated), by dynamic programming
    over every output text that a state allows."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def closed(best):
        for _ in range(3):
            for q, (c, e, out) in list(best.items()):
                for r in step[q]:
                    if r in names:
                        new = (c + 2, e + "I", [*out, names[r] + ":"])
                        if r not in best or new[:2] < best[r][:2]:
                            best[r] = new
        return best

    best = closed({"": (0, "", [])})
    for role, text, gone, truncated in rows:
        now = {}
        for q, (c, e, out) in best.items():
            ways = [(q, (c + 3, e + "D", out))]
            if not gone:
                for r in step[q]:
                    if role[:1] == r:
                        ways.append((r, (c + truncated, e + "K", [*out, f"{role}:{text}"])))
                    if r in names:
                        ways.append((r, (c + 2 + truncated, e + "R", [*out, f"{names[r]}:{text}"])))
            for r, new in ways:
                if r not in now or new[:2] < now[r][:2]:
                    now[r] = new
        best = closed(now)
    return min(best[q] for q in ("", "a") if q in best)


def plain(table):
    """The contract's rows from (conv_id, turn, role, text)."""
    after = {conv: [] for conv, *_ in table}
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        after[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, faults, edits = set(), [0, 0, 0], []
        for _, role, text in rows:
            shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            edits.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = cheapest(edits)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *faults, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in table])
    assert got(queries.op11_conversation_repair(spark, sf_dir)) == want
    assert {e for r in want for e in r[7]} == set("KDIR")


def odd_table():
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "u2"]
    texts = ["Fine.", "And then", "Why?  \n", "", " \t", None, "Zürich!", "é", "So.\x1c", "Fine."]
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "user", "A."), (7, None, "assistant", "B.")]
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), rng.choice(roles), rng.choice(texts)))
    # one conversation holds most rows; it also says the same again and again
    rows += [(99, i // 2, rng.choice(roles[:3]), f"line {i % 700}.") for i in range(2500)]
    rows += [(100, i, "user", "x" * 20_000 + ".") for i in range(3)]
    return rows


@pytest.mark.parametrize("buckets", [None, 37])
def test_odd_rows_and_long_conversations(spark, buckets):
    rows = odd_table()
    df = spark.createDataFrame([(*r, "z") for r in rows], TURNS).repartition(3)
    assert got(C.repair(queries.damaged(df), df, buckets)) == plain(rows)
    if buckets is None:
        assert C.repair(queries.damaged(df.limit(0)), df.limit(0)).collect() == []


def test_repaired_turns_read_as_they_should(spark):
    df = spark.createDataFrame([(*r, "z") for r in odd_table()], TURNS)
    faults = C.with_faults(df)
    turns = C.repaired_turns(faults, C.repairs(faults)).collect()
    assert {r.edit for r in turns} == {"K", "R", "I"}
    by_conv: dict = {}
    for r in sorted(turns, key=lambda r: (r.conv_id or -1, r.position)):
        by_conv.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(i)) for i in by_conv.values())


def test_stretches_join_to_the_whole():
    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(rows))
        left = C.lightest(rows[:cut])
        right = {p: C.lightest(rows[cut:], p) for p in C.NEXT}
        whole = C.lightest(rows)
        assert C.joined(left, right) == whole
        best = min(w for q, w in whole.items() if q in C.COMPLETE)
        assert list(C.lightest(rows, goal=True).values()) == [best]
        want = cheapest([(i, "", g, t) for i, g, t in rows])
        assert best == want[:2]
