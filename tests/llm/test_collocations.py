"""Collocations against plain counting, and the trie on its own."""

import collections
import random
import re

import numpy as np
import pytest

from packetloom.llm import collocations as C
from packetloom.llm import queries

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(rows, least=10, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(
                    tuple(w[i : i + k]) for i in range(len(w) - k + 1)
                )
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        hosts = collections.Counter()
        for k, v in found.items():
            if len(k) == 3:
                for part in (k[:2], k[1:]):
                    hosts[part] = max(hosts[part], v)
        ranked = []
        for k, a in found.items():
            if k not in hosts or 100 * hosts[k] < 50 * a:
                cuts = [(1_000_000 * a * a // (f[k[:i]] * f[k[i:]]), i) for i in range(1, len(k))]
                score, i = min(cuts)
                ranked.append((-score, -a, " ".join(k).encode(), f[k[:i]], f[k[i:]], n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()
    want = plain(docs)
    assert len(want) > 50
    assert got(queries.op13_collocations(spark, sf_dir)) == want


def test_odd_rows(spark, make_docs):
    rng = random.Random(3)
    words = ["new", "York", "city", "hall", "über", "日本", "\x00x", "the\x1cend", "a", "b"]
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, " \t\n.", "en", "s"), (1, "one", "", "s")]
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", ""]) for _ in range(80))
        rows.append((i, text, rng.choice(["en", "de", None]), "s"))
    rows += [(5, "ab cd ef " * 30, "fr", "s")] * 3  # repeats, all ties
    docs = make_docs(rows, 3).withColumnsRenamed({"n_chars": "n", "source": "phrase", "doc_id": "rank"})
    plain_rows = [(r.text, r.lang) for r in docs.collect()]
    assert got(C.collocations(docs)) == plain(plain_rows)
    assert got(C.collocations(docs, least=3, top=5)) == plain(plain_rows, 3, 5)
    assert got(C.collocations(docs, least=2, top=None)) == plain(plain_rows, 2, 10**9)
    assert C.collocations(docs.limit(0)).collect() == []


def test_long_texts_are_cut_between_words(spark, make_docs):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(900_000))
    rows = [(0, text, "en", "s"), (1, "x" * (C._CHUNK + 10) + " beta gamma", "en", "s")]
    assert got(C.collocations(make_docs(rows, 1))) == plain([(r[1], r[2]) for r in rows])


@pytest.mark.parametrize("least", [1, 40])
def test_trie_bursts_and_spills_whole_subtrees(least):
    rng = np.random.default_rng(least)
    trie, merged = C.HatTrie(burst=50, limit=10**9), collections.Counter()
    every = []
    for _ in range(40):
        ids = rng.integers(1, 60, size=(300, 3)) ** 2 // least + 1
        keys = (ids[:, 0] << 2 * C._ID) | (ids[:, 1] << C._ID) | ids[:, 2]
        every += keys.tolist()
        trie.add(keys)
        assert trie.lows == sorted(set(trie.lows)) and trie.size == sum(map(len, trie.tables))
        if trie.size > 3000:
            for run, counts in trie.spill(1500):
                assert (np.diff(run) > 0).all()
                merged.update(dict(zip(run.tolist(), counts.tolist())))
            assert trie.size <= 1500
    assert len(trie.lows) > 20 and max(map(len, trie.tables)) <= 350
    for run, counts in trie.spill(0):
        merged.update(dict(zip(run.tolist(), counts.tolist())))
    assert merged == collections.Counter(every)


def test_ids_start_anew_without_losing_phrases(monkeypatch):
    monkeypatch.setattr(C, "_ID", 6)
    rng = random.Random(9)
    words = [f"w{i}".encode() for i in range(200)]
    texts = [b" ".join(rng.choice(words) for _ in range(40)) + b"." for _ in range(200)]
    monkeypatch.setattr(C, "_CHUNK", 90)
    counter, found = C._Counter("en", 2, b"\xff" * (1 << (C.FILTER_BITS - 3))), collections.Counter()
    batches = [b for chunk in C._chunks(texts) for b in counter.add(chunk)]
    for b in [*batches, *counter.close()]:
        found.update(dict(zip(b.column(2).to_pylist(), b.column(3).to_pylist())))
    want = collections.Counter()
    for t in texts:
        w = t.rstrip(b".").decode().split(" ")
        want.update(" ".join(p) for p in zip(w, w[1:]))
    assert found == want
