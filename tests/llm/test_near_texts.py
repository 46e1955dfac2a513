"""The pipeline's near-copy stage on planted near copies and against all pairs."""

import random

import corpus_pipeline
import numpy as np

from packetloom.llm import near_texts
from tests.llm.brute import similar_kept


def test_planted_near_copies_are_removed(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (40, 90, 200, 400):
        for _ in range(12):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for changed in (1, n // 50, n // 25):  # similar, at the edge, beyond it
                copy = base[:]
                for at in rng.sample(range(n), changed):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    texts += ["", "  ", "one two", "one two", "ONE  two"]
    out = corpus_pipeline.near_duplicates(spark, make_docs(texts), "")
    got = sorted(r.doc_id for r in out.collect())
    want = similar_kept(texts)
    assert len(want) < len(texts) * 0.75
    assert got == want


def _near(n, seed):
    """Copies of one text, each with two words of its own: a dense group."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(n):
        copy = base[:]
        for at in rng.sample(range(200), 2):
            copy[at] = f"x{i}-{at}"
        out.append(" ".join(copy))
    return out


def test_dense_groups_in_tiles_and_common_passages(spark, make_docs):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = _near(150, 1)
    for i in range(120):
        own = " ".join(f"o{i}-{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 30, 90])))
        texts.append(f"{own} {passage}" if i % 2 else f"{passage} {own}")
    texts += [texts[0]] * 40
    got = near_texts.keep_one_similar(make_docs(texts, 4), tile=32)
    assert sorted(r.doc_id for r in got.collect()) == similar_kept(texts)


def test_odd_rows(spark, make_docs):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (None, None), (4, None), (2, ""), (2, " \t"), (None, "one two three four five six"),
        (9, "ONE two three  four five six"), (9, "one two three four five six"), (7, long), (6, long + " end"),
        (5, "a b"), (5, "a b c"), (8, "a b c d e"),
    ]
    docs = make_docs(rows).withColumnsRenamed({"source": "digest", "n_chars": "n", "lang": "row"})
    out = near_texts.keep_one_similar(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in out.collect()) == [
        (2, out.filter("doc_id = 2").first().text[:3]), (5, "a b"), (5, "a b"), (6, "w0 "), (8, "a b"), (9, out.filter("doc_id = 9").first().text[:3]),
    ]
    assert near_texts.keep_one_similar(docs.limit(0)).collect() == []


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    often = np.sort(rng.integers(0, 400, 60).astype(np.uint64))
    met = 0
    for _ in range(4000):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0.05, 0.15, 0.25])]
        b = np.unique(np.concatenate([b, rng.integers(0, 400, rng.integers(0, 4)).astype(np.uint64)]))
        if len(b) and near_texts.similar(a, b):
            met += 1
            assert len(np.intersect1d(near_texts.prefix(a, often), near_texts.prefix(b, often)))
    assert met > 500


def test_signatures_follow_the_similarity():
    rng = np.random.default_rng(9)
    for n in (5, 40, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
        same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree = (near_texts.signature(a) == near_texts.signature(b)).sum() / near_texts.SIGNATURE
        assert abs(agree - same) < 0.11
        assert (near_texts.signature(a) == near_texts.signature(a[::-1])).all()


def test_forest_joins_what_is_joined_already_by_no_pair():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64).repeat(40, axis=0)
    prints[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64)
    sizes = np.full(40, 100)
    assert len(near_texts.near_forest(prints, sizes, 56)) == 39
    roots = np.arange(40) % 3
    links = near_texts.near_forest(prints, sizes, 56, roots)
    assert len(links) == 2 and len({frozenset(int(roots[i]) for i in link) for link in links}) == 2
    assert near_texts.near_forest(prints, sizes, 56, np.zeros(40, dtype=np.int64)) == []


def test_hashes_are_handed_over_in_parts():
    sets = [np.arange(n) for n in (3, 4, 0, 9, 1)]
    assert [[len(s) for s in part] for part in near_texts._filled(sets, 6)] == [[3, 4], [0, 9], [1]]


def _apart(n, seed):
    """Sets of 200 of which each keeps most of one base: many pairs on both sides of the limit."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    out = []
    for i in range(n):
        own = rng.integers(0, 1 << 63, int(rng.integers(2, 45)), dtype=np.uint64)
        out.append(np.unique(np.concatenate([rng.permutation(base)[: 200 - len(own)], own])))
    return out


def test_verified_forest_joins_what_all_similar_pairs_join():
    for seed, slots in ((1, None), (2, np.arange(120) % 2)):
        sets = _apart(120, seed)
        prints = np.stack([near_texts.fingerprint(s) for s in sets])
        sizes = np.array([len(s) for s in sets])
        got = near_texts.similar_forest(prints, np.concatenate(sets), sizes, 256, slots)
        want = [
            (i, j) for i in range(120) for j in range(i)
            if near_texts.similar(sets[i], sets[j]) and (slots is None or slots[i] != slots[j])
        ]
        assert len(got) < 120 < len(want)
        assert all(near_texts.similar(sets[i], sets[j]) for i, j in got)
        assert _classes(got, 120) == _classes(want, 120)


def _classes(links, n):
    of = list(range(n))
    for a, b in links:
        low, high = sorted((of[a], of[b]))
        of = [low if x == high else x for x in of]
    return of


def _loose(n, seed):
    """Copies of one text with one to six words changed: many pairs come near and are not similar."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for i in range(n):
        copy = base[:]
        for at in rng.sample(range(150), rng.randint(1, 6)):
            copy[at] = f"x{i}-{at}"
        out.append(" ".join(copy))
    return out


def test_a_loose_group_passes_on_a_link_a_text(spark, make_docs, monkeypatch):
    made = []

    def counted(df, name):
        out = written(df, name)
        made.append((name, out.count()))
        return out

    texts = _loose(300, 3)
    written = near_texts.written
    monkeypatch.setattr(near_texts, "written", counted)
    got = near_texts.keep_one_similar(make_docs(texts, 4))
    assert sorted(r.doc_id for r in got.collect()) == similar_kept(texts)
    assert max(rows for name, rows in made if name in ("pairs", "similar")) < 2 * len(texts)


def test_loose_groups_in_tiles(spark, make_docs):
    texts = _loose(150, 4)
    got = near_texts.keep_one_similar(make_docs(texts, 4), tile=32)
    assert sorted(r.doc_id for r in got.collect()) == similar_kept(texts)
